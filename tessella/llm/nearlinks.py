"""Components of sets whose Jaccard similarity reaches a threshold.

The shared engine of the near-duplicate operators.  It works on *classes*:
distinct sets, each named by a 128-bit digest of its members.  Equal sets are
one class, so a group of copies of any size is one row here.

1. Band keys are counted (aggregated before the exchange); keys held by one
   class only are dropped.
2. Star links: each class of a bucket is compared with the bucket's least
   class only, never with all others.  Signatures are compared batch by batch
   and pairs pruned by the posterior; survivors are verified on the full sets.
   Verified links give components.
3. Buckets that still hold several components get their missing comparisons:
   pairs of classes from different components, compared inside a task in
   blocks, a pair only in the first band whose whole key both share.  No pair is
   emitted: a first pass names the classes with a survivor, a second one
   verifies these on the full sets and emits links of a spanning forest.  A
   bucket is first split by set size: sets whose sizes differ by more than the
   threshold allows can't be linked, so a size step meets itself and the next
   one only.  What is left of more than BLOCK_ROWS classes, or of larger sets
   than BLOCK_BYTES, is dealt out as pairs of blocks, by ranges of about equal
   numbers of rows.

So the links that decide components are those of all banded pairs whose
posterior passed and whose sets reach the threshold.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.components import connected_components
from tessella.llm.minhash import MinHasher, Posterior
from tessella.llm.scratch import Scratch

#: Classes of a bucket that one task compares with each other, and bytes of their sets.
BLOCK_ROWS, BLOCK_BYTES = 768, 8 << 20
#: Pairs whose signatures are gathered at once.
PAIRS = 8192


def similar(left: np.ndarray, right: np.ndarray, threshold: tuple[int, int]) -> bool:
    """Whether intersection / union of two sorted sets is at least threshold[0] / threshold[1]."""
    num, den = threshold
    small, large = sorted((len(left), len(right)))
    if small * den < num * large or not small:
        return False
    both = np.concatenate((left, right))
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return common * den >= num * (small + large - common)


def whole_units(batches: Iterator[pa.RecordBatch], key: str, rows: int = 4096) -> Iterator[pa.Table]:
    """Tables of about ``rows`` rows that split no unit; rows come sorted by ``key``."""
    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(key)
        codes = column.dictionary_encode().indices.to_numpy()
        opens = np.flatnonzero(codes[1:] != codes[:-1]) + 1
        if held and held[-1].column(key)[-1].as_py() != column[0].as_py():
            opens = np.concatenate(([0], opens))
        start = 0
        for at in opens.tolist():
            if count + at - start >= rows or at == opens[-1]:
                if at > start:
                    held.append(batch.slice(start, at - start))
                if held and count + at - start >= rows:
                    yield pa.Table.from_batches(held)
                    held, count = [], 0
                else:
                    count += at - start
                start = at
        held.append(batch.slice(start))
        count += batch.num_rows - start
    if held:
        yield pa.Table.from_batches(held)


def _matrix(column: pa.ChunkedArray, size: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), size)


def _prune(hasher: MinHasher, test: Posterior) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = test.alive(_matrix(batch.column("sig_u"), hasher.size), _matrix(batch.column("sig_v"), hasher.size))
            yield batch.select(["u", "v"]).take(pa.array(keep))

    return run


def _verify(threshold: tuple[int, int]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column("set_u"), batch.column("set_v")
            keep = [i for i in range(len(left)) if similar(np.frombuffer(left[i].as_buffer(), np.uint64), np.frombuffer(right[i].as_buffer(), np.uint64), threshold)]
            yield batch.select(["u", "v"]).take(pa.array(keep, pa.int64()))

    return run


#: Rows of a unit up to which its pairs are listed together with those of other small units.
SMALL = 32


def _candidates(unit: np.ndarray, split: np.ndarray, root: np.ndarray, part: np.ndarray, sig: np.ndarray, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row pairs of one unit and two components with ``least`` matches in ``sig``, the first values of the signatures."""

    def meet(u, v):
        return (root[u] != root[v]) & (~split[u] | (part[u] != part[v]))

    at = np.flatnonzero(np.concatenate(([True], unit[1:] != unit[:-1])))
    size = np.diff(np.append(at, len(unit)))
    small = np.repeat(size <= SMALL, size)
    for d in range(1, min(SMALL, int(size.max(initial=0)))):
        u = np.flatnonzero((unit[:-d] == unit[d:]) & small[d:])
        u = u[meet(u, u + d)]
        for j in range(0, len(u), PAIRS):
            w = u[j : j + PAIRS]
            w = w[(sig[w] == sig[w + d]).sum(1) >= least]
            yield w, w + d
    for a, n in zip(at[size > SMALL].tolist(), size[size > SMALL].tolist()):
        rows = np.arange(a, a + n)
        step = max(1, (1 << 18) // n)
        for i in range(a, a + n, step):
            some = np.arange(i, min(i + step, a + n))
            matches = np.zeros((len(some), n), np.uint8)
            for k in range(sig.shape[1]):
                matches += sig[some, k][:, None] == sig[rows, k][None, :]
            u, v = np.nonzero((matches >= least) & (some[:, None] < rows[None, :]))
            u, v = some[u], rows[v]
            keep = meet(u, v)
            yield u[keep], v[keep]


def _across(table: pa.Table, hasher: MinHasher, test: Posterior) -> tuple[np.ndarray, np.ndarray]:
    """Row pairs of units that belong to their unit's band, join two components and pass the posterior."""
    n = table.num_rows
    sig = _matrix(table.column("sig"), hasher.size)
    keys = table.column("keys").combine_chunks().flatten().to_numpy().reshape(n, hasher.bands)
    unit, root = (table.column(x).combine_chunks().dictionary_encode().indices.to_numpy() for x in ("unit", "root"))
    part, band = (table.column(x).to_numpy() for x in ("part", "band"))
    at = np.flatnonzero(np.concatenate(([True], unit[1:] != unit[:-1])))
    # a unit of two blocks compares one with the other, a unit of one block all of its rows
    split = np.repeat(np.minimum.reduceat(part, at) != np.maximum.reduceat(part, at), np.diff(np.append(at, n)))
    first = min(test.least)
    found_u, found_v = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for u, v in _candidates(unit, split, root, part, np.ascontiguousarray(sig[:, :first]), test.least[first]):
        for j in range(0, len(u), PAIRS):
            a, b = u[j : j + PAIRS], v[j : j + PAIRS]
            keep = test.alive(sig[a], sig[b])
            a, b = a[keep], b[keep]
            own = (keys[a] == keys[b]).argmax(1) == band[a]
            found_u.append(a[own])
            found_v.append(b[own])
    return np.concatenate(found_u), np.concatenate(found_v)


def _survivors(hasher: MinHasher, test: Posterior) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_units(batches, "unit"):
            u, v = _across(table, hasher, test)
            if len(u):
                yield from table.take(pa.array(np.union1d(u, v))).to_batches()

    return run


def _forest(hasher: MinHasher, test: Posterior, threshold: tuple[int, int]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a unit's sets are at most BLOCK_BYTES a block; rows a table are few, as each has its set
        for table in whole_units(batches, "unit", 256):
            u, v = _across(table, hasher, test)
            names = table.column("root").to_pylist()
            over = {name: name for name in names}

            def top(x, over=over):
                while over[x] != x:
                    over[x] = x = over[over[x]]
                return x

            sets = table.column("set")
            left, right = [], []
            for a, b in zip(u.tolist(), v.tolist()):
                x, y = top(names[a]), top(names[b])
                if x != y and similar(np.frombuffer(sets[a].as_buffer(), np.uint64), np.frombuffer(sets[b].as_buffer(), np.uint64), threshold):
                    over[max(x, y)] = min(x, y)
                    left.append(names[a])
                    right.append(names[b])
            if left:
                yield pa.RecordBatch.from_arrays([pa.array(left, pa.binary()), pa.array(right, pa.binary())], ["u", "v"])

    return run


def near_components(
    classes: DataFrame,
    sets_of: Callable[[DataFrame], DataFrame],
    hasher: MinHasher,
    threshold: tuple[int, int],
    miss: float,
    scratch: Scratch,
) -> DataFrame:
    """``(digest, root)`` for the classes that have a link; root is the component's least digest.

    classes: ``digest binary, n long, sig binary, keys array<long>``, one row per
    distinct set that isn't empty.  sets_of: given a frame of digests, a frame
    ``(digest, set)`` with the sorted members of at least those classes.
    """
    spark = classes.sparkSession
    test = Posterior(hasher.size, threshold[0] / threshold[1], miss)
    banded = classes.select("digest", F.posexplode("keys").alias("band", "key"))
    # keys and centres are cut, so that Spark can split a hot bucket on the other side of their joins
    shared = scratch.cut(banded.groupBy("key").agg(F.count(F.lit(1)).alias("held")).where("held > 1").select("key"), "shared")
    members = scratch.cut(banded.join(shared, "key"), "members")
    scratch.drop(shared)

    # 2. star links
    centres = scratch.cut(members.groupBy("key").agg(F.min("digest").alias("v")), "centres")
    star = members.join(centres, "key").where("digest <> v").select(F.col("digest").alias("u"), "v").distinct()
    signed = classes.select("digest", "sig")
    star = star.join(signed.toDF("u", "sig_u"), "u").join(signed.toDF("v", "sig_v"), "v").select("u", "v", "sig_u", "sig_v")
    likely = scratch.cut(star.mapInArrow(_prune(hasher, test), "u binary, v binary"), "likely")

    wanted = scratch.cut(members.select("digest").distinct(), "wanted")
    sets = scratch.cut(sets_of(wanted).join(wanted, "digest", "left_semi").dropDuplicates(["digest"]), "sets")
    both = likely.join(sets.toDF("u", "set_u"), "u").join(sets.toDF("v", "set_v"), "v").select("u", "v", "set_u", "set_v")
    links = scratch.cut(both.mapInArrow(_verify(threshold), "u binary, v binary"), "links")
    rooted = scratch.cut(connected_components(links, scratch), "rooted")
    scratch.drop(centres, likely, links, wanted)

    # 3. pairs across components
    step = max(math.log(threshold[1] / threshold[0]), 1e-9)
    placed_ = placed = scratch.cut(members.join(rooted.toDF("digest", "root"), "digest", "left").withColumn("root", F.coalesce("root", "digest")), "placed")
    several = scratch.cut(placed.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key"), "several")
    # linked sets are at most one step of size apart; the margin is for rounding
    steps = F.floor(F.log(F.col("n").cast("double")) / (step * 1.000001)).cast("int")
    placed = placed.join(several, "key").join(classes.select("digest", "n"), "digest").select("key", "band", "digest", "root", "n", F.explode(F.array(steps, steps + 1)).alias("level"), steps.alias("own"))
    # sums per bucket and step, over the sets of the step and of the one below: least and greatest component, rows, bytes of the sets
    mine = F.col("own") == F.col("level")
    size = placed.groupBy("key", "level").agg(
        F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.when(mine, 1)).alias("upper"), F.count(F.when(~mine, 1)).alias("lower"),
        F.sum(F.when(mine, F.col("n") * 8).otherwise(0)).alias("upper_bytes"), F.sum(F.when(mine, 0).otherwise(F.col("n") * 8)).alias("lower_bytes"),
    ).where("lo <> hi and upper > 0")

    def blocks(rows: str, size_: str):
        return F.greatest(F.ceil(F.col(rows) / BLOCK_ROWS), F.ceil(F.col(size_) / BLOCK_BYTES)).cast("int")

    # parts 0 to b - 1 are the step's own blocks, parts b to b + c - 1 those of the step below
    size = size.select("key", "level", blocks("upper", "upper_bytes").alias("b"), blocks("lower", "lower_bytes").alias("c"))
    open_ = placed.join(size, ["key", "level"]).withColumn("part", F.expr("cast(if(own = level, pmod(xxhash64(digest), b), b + pmod(xxhash64(digest), c)) as int)"))
    meets = "if(part < b, sequence(0, b + c - 1), sequence(0, b - 1))"
    units = open_.select("key", "band", "level", "digest", "root", "part", F.expr(f"explode(transform({meets}, j -> struct(least(part, j) as i, greatest(part, j) as j)))").alias("of"))
    units = units.select(F.concat_ws(":", "key", "level", "of.i", "of.j").alias("unit"), "band", "digest", "root", "part")
    # a unit with one component has nothing to compare
    units = scratch.cut(units, "units")
    worth = scratch.cut(units.groupBy("unit").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("unit"), "worth")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    schema = "unit string, band int, digest binary, root binary, sig binary, keys array<long>, part int"
    signed = units.join(worth, "unit", "left_semi").join(classes.select("digest", "sig", "keys"), "digest").select("unit", "band", "digest", "root", "sig", "keys", "part")
    survivors = scratch.cut(signed.repartitionByRange(n, "unit").sortWithinPartitions("unit", "digest").mapInArrow(_survivors(hasher, test), schema), "survivors")
    held = survivors.join(sets, "digest").select("unit", "band", "digest", "root", "sig", "keys", "part", "set")
    more = scratch.cut(held.repartition(n, "unit").sortWithinPartitions("unit", "digest").mapInArrow(_forest(hasher, test, threshold), "u binary, v binary"), "more")
    scratch.drop(members, placed_, several, sets, units, worth, survivors)

    if more.isEmpty():
        return rooted.toDF("digest", "root")
    # these links are between components, which take part by their roots only
    higher = scratch.cut(connected_components(more, scratch), "joined").toDF("root", "top")
    lower = rooted.toDF("digest", "root").join(higher, "root", "left").select("digest", F.coalesce("top", "root").alias("root"))
    alone = higher.join(rooted.select(F.col("id").alias("root")), "root", "left_anti").select(F.col("root").alias("digest"), F.col("top").alias("root"))
    return scratch.cut(lower.unionByName(alone), "components")
