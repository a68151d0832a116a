"""Sharding by histogram sort: near-equal bytes, one exchange.

Rows are ordered by (hash of the text, doc_id), so that equal texts are
neighbours.  The boundaries between shards are found without sorting: each
round counts the exact bytes below evenly spaced probe keys in the key ranges
that are still open, over all partitions, and narrows every range to the probe
interval that holds its target.  A range is closed when it holds one key.  Then
rows are exchanged once.  Only DataFrame functions are used.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.scratch import Scratch

LOW, HIGH = -(1 << 63), (1 << 63) - 1
#: Probes in each open range and round.
PROBES = 64
#: Pieces of a shard that are ordered by one task each, at most.
MAX_PIECES = 8


def _below(bounds: list[tuple[int, int]], count: int = 0) -> Column:
    """The number of bounds (h, d) that are at most the row's (h, d): nested comparisons, of logarithmic depth."""
    if not bounds:
        return F.lit(count)
    middle = len(bounds) // 2
    h, d = bounds[middle]
    under = (F.col("h") < F.lit(h)) | ((F.col("h") == F.lit(h)) & (F.col("d") < F.lit(d)))
    return F.when(under, _below(bounds[:middle], count)).otherwise(_below(bounds[middle + 1 :], count + middle + 1))


def _inside(ranges: list[tuple[int, int]], column: str) -> tuple[Column, Column, Column, Column]:
    """For disjoint sorted ranges [lo, hi]: whether the row is in one; which; its lo and its probe width."""

    def pick(part: list[int], leaf) -> Column:
        if len(part) == 1:
            return leaf(part[0])
        middle = len(part) // 2
        return F.when(F.col(column) < F.lit(ranges[part[middle]][0]), pick(part[:middle], leaf)).otherwise(pick(part[middle:], leaf))

    every = list(range(len(ranges)))
    inside = pick(every, lambda i: F.col(column).between(F.lit(ranges[i][0]), F.lit(ranges[i][1])))
    return inside, pick(every, F.lit), pick(every, lambda i: F.lit(ranges[i][0])), pick(every, lambda i: F.lit((ranges[i][1] - ranges[i][0]) // PROBES + 1))


@dataclass
class _Target:
    """One boundary that is looked for: bytes that lie below the open range, and the target."""

    bytes: int
    before: int
    lo: int
    hi: int
    at: int | None = None  # the one key left
    held: int = 0  # bytes of that key


def _search(keys: DataFrame, column: str, targets: list[_Target]) -> None:
    """Narrow all targets to single values of ``column``."""
    while open_ := [t for t in targets if t.at is None]:
        ranges = sorted({(t.lo, t.hi) for t in open_})
        inside, which, low, width = _inside(ranges, column)
        # column - lo may exceed a long; decimals hold it
        wide = F.col(column).cast("decimal(20,0)") - low.cast("decimal(20,0)")
        probe = F.floor(wide / width.cast("decimal(20,0)")).cast("int")
        rows = keys.where(inside).groupBy(which.alias("i"), probe.alias("p")).agg(F.sum("size").alias("bytes"), F.min(column).alias("lo"), F.max(column).alias("hi")).collect()  # PROBES rows a range at most
        found: dict[int, list] = {}
        for row in sorted(rows, key=lambda r: (r.i, r.p)):
            found.setdefault(row.i, []).append(row)
        for t in open_:
            for row in found[ranges.index((t.lo, t.hi))]:
                if t.before + row.bytes >= t.bytes or row is found[ranges.index((t.lo, t.hi))][-1]:
                    if row.lo == row.hi:
                        t.at, t.held = row.lo, row.bytes
                    t.lo, t.hi = row.lo, row.hi
                    break
                t.before += row.bytes


def splitters(keys: DataFrame, shards: int, whole_groups_within: float) -> list[tuple[int, int]]:
    """The first keys (h, d) of shards 1 to ``shards`` - 1.

    keys: ``h long, d long, size long``.  A boundary goes to the edge of a
    group of equal h that is nearest to its target, if that is off by at most
    ``whole_groups_within`` of a shard's bytes; else it goes between two values
    of d inside the group, as near to the target as possible.
    """
    total = keys.agg(F.sum("size").alias("s")).first().s or 0
    if not total:
        return [(HIGH, HIGH)] * (shards - 1)
    groups = [_Target(total * i // shards, 0, LOW, HIGH) for i in range(1, shards)]
    _search(keys, "h", groups)
    out: list[tuple[int, int] | None] = [None] * len(groups)
    inner: dict[int, list[tuple[int, _Target]]] = {}
    slack = whole_groups_within * total / shards
    for i, t in enumerate(groups):
        below, above = t.bytes - t.before, t.before + t.held - t.bytes
        if min(below, above) <= slack:
            out[i] = (t.at, LOW) if below <= above else (t.at, HIGH)
        else:
            inner.setdefault(t.at, []).append((i, _Target(t.bytes, t.before, LOW, HIGH)))
    for h, wanted in inner.items():  # groups that hold a boundary: fewer than shards
        _search(keys.where(F.col("h") == F.lit(h)), "d", [t for _, t in wanted])
        for i, t in wanted:
            below, above = t.bytes - t.before, t.before + t.held - t.bytes
            out[i] = (h, t.at) if below <= above or t.at == HIGH else (h, t.at + 1)
    return sorted(out)


def shard(docs: DataFrame, shards: int = 40, whole_groups_within: float = 0.01) -> DataFrame:
    """docs with ``size, text_crc32, law, shard, slot, grown_shard``.

    docs: ``doc_id long, text string`` and any other columns, which pass
    through (those that a caller does not select are not exchanged).  size:
    UTF-8 bytes of the text and 16 more.  law is "bytes": shards of near-equal
    sizes, and so grown_shard is null.  shard: 0 to ``shards`` - 1; slot: the
    row's place in its shard, without gaps from 0.  Equal texts stay in one
    shard, unless that puts a boundary off by more than ``whole_groups_within``
    of a shard's bytes.

    Defined cases: a null text counts 0 bytes and has the checksum of no bytes,
    0; a null doc_id orders before all others; rows with equal text and doc_id
    share a shard and take slots in any order; with fewer rows than shards
    some shards are empty; columns of docs with the names of the results are
    replaced.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "sharding")
    made = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    docs = docs.drop(*made)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = docs.withColumns(
        {"h": F.xxhash64(text), "d": F.coalesce(F.col("doc_id").cast("long"), F.lit(LOW)), "size": F.octet_length(text).cast("long") + 16, "text_crc32": F.crc32(text.cast("binary"))}
    )
    keys = scratch.cut(keyed.select("h", "d", "size"), "keys")
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    pieces = max(1, min(MAX_PIECES, partitions // (4 * shards)))
    outer = splitters(keys, shards, whole_groups_within)
    # shards are cut into pieces for the exchange, at any key
    bounds = sorted({*outer, *(splitters(keys, shards * pieces, 0.0) if pieces > 1 else [])})
    piece = _below(bounds).cast("int")
    placed = {"shard": _below(outer).cast("int"), "piece": piece}
    counts = keys.select(placed["shard"].alias("shard"), piece.alias("piece")).groupBy("shard", "piece").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    # a row for each piece, shards * MAX_PIECES at most: safe to broadcast
    offsets = scratch.cut(counts.select("piece", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset")), "offsets")
    rows = keyed.withColumns(placed)
    inside = Window.partitionBy("piece").orderBy("h", "d", "text_crc32")
    rows = rows.withColumn("rank", F.row_number().over(inside)).join(F.broadcast(offsets), "piece")
    return rows.select(*docs.columns, "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("offset") + F.col("rank") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
