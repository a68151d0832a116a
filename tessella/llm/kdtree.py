"""Exact top-k inner products with a KD-tree in every shard.

Vectors are dealt to cells by the top splits of one tree, whose medians come
from a bounded sample, and cells of more than ``SHARD_ROWS`` vectors are dealt
on by a hash of the id, so that shards are small whatever is in them; a shard's
box is the tight box of its vectors.  A shard's tree halves its vectors at the
median of the widest dimension and gives every node the tight box of its
vectors.  No vector in a box [lo, hi] scores more with query q than the sum over
dimensions of max(q * lo, q * hi).  A traversal visits a query's nodes by
falling bound and ends when the bound falls below the query's kth score.

Blocks of queries visit shards in waves: first the shard of the highest bound,
then the next WAVE, then WAVE times as many, and so on.  After each wave the kth
scores have risen, and only shards whose box some query of the block could still
gain from are visited by the next one; the others' trees never meet the block.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.scratch import Scratch

#: Vectors in a shard, in a leaf; queries that travel together.
SHARD_ROWS, LEAF, BLOCK = 8192, 256, 512
#: Vectors that the top splits are fitted on, about; vectors of the sample in a cell; growth of waves; boxes handled at once.
SAMPLE, CELL, WAVE, BOXES = 16384, 64, 4, 2048


def once(ids: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ordered by id; of rows that repeat an id the least vector stays."""
    order = np.lexsort((*vectors.T[::-1], ids))
    ids, vectors = ids[order], vectors[order]
    first = np.concatenate(([True], ids[1:] != ids[:-1])) if len(ids) else np.zeros(0, bool)
    return ids[first], vectors[first]


def products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Inner products of all rows, exact: in doubles while sums stay below 2**53, else in whole numbers."""
    size = max(1, left.shape[1])
    if np.abs(left).max(initial=0) * np.abs(right).max(initial=0) * size < 2.0**53:
        return left @ right.T
    whole = [[int(x) for x in row] for row in left], [[int(x) for x in row] for row in right]
    return np.array([[sum(map(int.__mul__, a, b)) for b in whole[1]] for a in whole[0]], dtype=object).reshape(len(left), len(right))


class Tree:
    """Nodes in arrays: tight boxes, children (-1 in a leaf), row ranges of the ordered vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = once(ids, vectors)
        ids = self.ids
        lo, hi, left, right, rows, least = [], [], [], [], [], []
        place = np.arange(len(ids))

        def build(part: np.ndarray, start: int) -> int:
            node = len(lo)
            box = self.vectors[part]
            low, high = box.min(0), box.max(0)
            for column, value in ((lo, low), (hi, high), (left, -1), (right, -1), (rows, (start, start + len(part))), (least, self.ids[part].min())):
                column.append(value)
            if len(part) > LEAF and (high > low).any():
                dimension = int((high - low).argmax())
                middle = len(part) // 2
                halves = np.argpartition(box[:, dimension], middle)
                left[node] = build(part[halves[:middle]], start)
                right[node] = build(part[halves[middle:]], start + middle)
            else:
                place[start : start + len(part)] = np.sort(part)
            return node

        if len(ids):
            build(np.arange(len(ids)), 0)
            self.ids, self.vectors = self.ids[place], self.vectors[place]
        self.lo, self.hi = np.array(lo), np.array(hi)
        self.left, self.right = np.array(left), np.array(right)
        self.rows, self.least = np.array(rows).reshape(-1, 2), np.array(least)

    @classmethod
    def load(cls, blob: pa.BinaryScalar) -> Tree:
        tree = cls.__new__(cls)
        tree.__dict__.update(pickle.loads(blob.as_buffer()))
        return tree

    def search(self, queries: np.ndarray, names: np.ndarray, k: int, best: list[list[tuple[int, int]]]) -> list[list[tuple[int, int]]]:
        """Best-first traversal for a block of queries.

        best: for each query its (score, -id) so far, at most k, ascending.
        Returns the same with this tree's vectors taken in; a query never
        meets the vector of its own id.
        """
        if not len(self.ids):
            return best
        positive, negative = np.maximum(queries, 0), np.minimum(queries, 0)
        bounds = products(positive, self.hi) + products(negative, self.lo)
        waiting: list[list[tuple]] = [[(-bounds[i, 0], 0)] for i in range(len(queries))]
        active = list(range(len(queries)))
        while active:
            # each query opens nodes down to its next leaf; queries at one leaf are scored together
            at_leaf: dict[int, list[int]] = {}
            for i in active:
                heap = waiting[i]
                while heap:
                    bound, node = heapq.heappop(heap)
                    if len(best[i]) == k:
                        score, name = best[i][0]
                        # at an equal bound only a smaller id could still enter
                        if -bound < score or (-bound == score and self.least[node] > -name):
                            if -bound < score:
                                heap.clear()
                            continue
                    if self.left[node] < 0:
                        at_leaf.setdefault(node, []).append(i)
                        break
                    for child in (self.left[node], self.right[node]):
                        heapq.heappush(heap, (-bounds[i, child], child))
            active = []
            for node, those in at_leaf.items():
                a, b = self.rows[node]
                ids = self.ids[a:b]
                scores = products(queries[those], self.vectors[a:b])
                for row, i in zip(scores, those):
                    near = best[i]
                    keep = row >= near[0][0] if len(near) == k else np.ones(b - a, bool)
                    hits = np.flatnonzero(keep & (ids != names[i]))
                    if len(hits):
                        if len(hits) > k:
                            hits = hits[np.lexsort((ids[hits], -row[hits]))[:k]]
                        found = near + [(int(s), -int(n)) for s, n in zip(row[hits], ids[hits])]
                        found.sort()
                        best[i] = found[-k:]
                    if waiting[i]:
                        active.append(i)
        return best


def exact_floor(x: Column, scale: int) -> Column:
    """floor(scale * x), x as double: an integer, held as a double."""
    return F.floor(x.cast("double") * F.lit(float(scale))).cast("double")


def integer_vectors(table: DataFrame, scale: int, name: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``vec_id, v array<double>``; vectors that are null or hold a component that is null or not finite are left out."""
    sound = F.col(vector).isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = table.where(F.col(name).isNotNull()).where(sound)
    return rows.select(F.col(name).cast("long").alias("vec_id"), F.transform(vector, lambda x: exact_floor(x, scale)).alias("v"))


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


class Cuts:
    """The top of a tree over a sample: medians of the widest dimension down to cells of CELL vectors."""

    def __init__(self, sample: np.ndarray, cells: int):
        self.dimension, self.value, self.child = [], [], []
        self.cells = 0

        def build(part: np.ndarray, left: int) -> int:
            spread = part.max(0) - part.min(0) if len(part) else np.zeros(0)
            if left < 2 or len(part) < 2 * CELL or not spread.max(initial=0):
                self.cells += 1
                return -self.cells
            dimension = int(spread.argmax())
            value = float(np.median(part[:, dimension]))
            below = part[:, dimension] < value
            if not below.any():
                value = float(part[part[:, dimension] > value, dimension].min())
                below = part[:, dimension] < value
            node = len(self.value)
            self.dimension.append(dimension)
            self.value.append(value)
            self.child.append(None)
            self.child[node] = build(part[below], left // 2), build(part[~below], left - left // 2)
            return node

        build(sample, cells)

    def place(self, vectors: np.ndarray) -> np.ndarray:
        """The cell of each vector, from 0."""
        if not self.value:
            return np.zeros(len(vectors), np.int64)
        dimension, value, child = np.array(self.dimension), np.array(self.value), np.array(self.child)
        node = np.zeros(len(vectors), np.int64)
        going = np.arange(len(vectors))
        while len(going):
            at = node[going]
            node[going] = child[at, (vectors[going, dimension[at]] >= value[at]).astype(int)]
            going = going[node[going] >= 0]
        return -node - 1


def _placed(cuts: dict[int, Cuts]) -> Callable:
    """``vec_id, v`` with ``dim, cell``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("v").value_lengths().to_numpy(zero_copy_only=False)
            cell = np.zeros(len(dims), np.int64)
            for d in np.unique(dims).tolist():
                rows = np.flatnonzero(dims == d)
                if d in cuts and d:
                    cell[rows] = cuts[d].place(_matrix(batch.column("v").take(pa.array(rows))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(dims, pa.int32()), pa.array(cell)], [*batch.schema.names, "dim", "cell"])

    return run


PACKED = "part long, dim int, blob binary, box binary"


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], pa.Table]]:
    """The rows of each (part, dim); rows come sorted by them."""
    held: list[pa.RecordBatch] = []
    key = None
    for batch in batches:
        parts, dims = batch.column("part").to_numpy(), batch.column("dim").to_numpy()
        cuts = [0, *(np.flatnonzero((parts[1:] != parts[:-1]) | (dims[1:] != dims[:-1])) + 1).tolist(), len(parts)]
        for a, b in zip(cuts, cuts[1:]):
            if a == b:
                continue
            if held and (int(parts[a]), int(dims[a])) != key:
                yield key, pa.Table.from_batches(held)
                held = []
            key = (int(parts[a]), int(dims[a]))
            held.append(batch.slice(a, b - a))
    if held:
        yield key, pa.Table.from_batches(held)


def _row(key: tuple[int, int], blob: bytes, box: bytes | None = None) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int64()), pa.array([key[1]], pa.int32()), pa.array([blob], pa.binary()), pa.array([box], pa.binary())], ["part", "dim", "blob", "box"])


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A tree for each (part, dim), and its root's box with the least id."""
    for key, table in _grouped(batches):
        tree = Tree(table.column("vec_id").to_numpy(), _matrix(table.column("v").combine_chunks()))
        yield _row(key, pickle.dumps(vars(tree), protocol=5), pickle.dumps((key[0], tree.lo[0], tree.hi[0], int(tree.least[0])), protocol=5))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Queries that travel together: names, vectors, (score, -id) so far, shards visited."""
    for key, table in _grouped(batches):
        names, queries = once(table.column("vec_id").to_numpy(), _matrix(table.column("v").combine_chunks()))
        yield _row(key, pickle.dumps((names, queries, [[] for _ in names], []), protocol=5))


def _box_sheets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The boxes of each (part, dim) in one value: shards, least and greatest corners, least ids."""
    for key, table in _grouped(batches):
        boxes = [pickle.loads(x) for x in table.column("box").to_pylist()]
        shards, lo, hi, least = (np.array(x) for x in zip(*boxes))
        yield _row(key, pickle.dumps((shards, lo, hi, least), protocol=5))


def _wanted(k: int) -> Callable:
    """``part, dim, shard, bound``: the shards that some query of a block can still gain from, with the highest bound of such queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, dim, block, sheet in zip(*(batch.column(x) for x in ("part", "dim", "blob", "sheet"))):
                _, queries, best, visited = pickle.loads(block.as_buffer())
                shards, lo, hi, least = pickle.loads(sheet.as_buffer())
                bounds = products(np.maximum(queries, 0), hi) + products(np.minimum(queries, 0), lo)
                full = np.array([len(x) == k for x in best])
                score, name = (np.array([x[0][j] if len(x) == k else 0 for x in best], dtype=object if bounds.dtype == object else float) for j in (0, 1))
                gain = ~full[:, None] | (bounds > score[:, None]) | ((bounds == score[:, None]) & (least[None, :] < -name[:, None]))
                gain = gain.astype(bool) & ~np.isin(shards, visited)[None, :]
                some = np.flatnonzero(gain.any(0))
                top = [float(bounds[gain[:, j], j].max()) for j in some]
                n = len(some)
                yield pa.RecordBatch.from_arrays([pa.array([part.as_py()] * n, pa.int64()), pa.array([dim.as_py()] * n, pa.int32()), pa.array(shards[some].astype(np.int64)), pa.array(top, pa.float64())], ["part", "dim", "shard", "bound"])

    return run


def _visit(k: int) -> Callable:
    """What a shard adds to a block that knows its kth scores so far."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, dim, shard, block, tree in zip(*(batch.column(x) for x in ("part", "dim", "shard", "blob", "tree"))):
                names, queries, known, _ = pickle.loads(block.as_buffer())
                best = Tree.load(tree).search(queries, names, k, [list(x) for x in known])
                # of a wave's shards each one's finds are kept apart from what was known
                news = [[x for x in now if x not in before] for now, before in zip(best, map(set, known))]
                yield _row((part.as_py(), dim.as_py()), pickle.dumps((shard.as_py(), news), protocol=5))

    return run


def _merge(k: int) -> Callable:
    """Blocks with the finds of a wave; a block's own row (``old``) comes first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, table in _grouped(batches):
            blobs = table.column("blob")
            names, queries, best, visited = pickle.loads(blobs[0].as_buffer())
            for blob in blobs[1:]:
                shard, news = pickle.loads(blob.as_buffer())
                visited.append(shard)
                best = [sorted(old + new)[-k:] for old, new in zip(best, news)]
            yield _row(key, pickle.dumps((names, queries, best, visited), protocol=5))

    return run


def _finds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in batch.column("blob"):
            names, _, best, _ = pickle.loads(block.as_buffer())
            rows = [(int(q), place, -n, s) for q, own in zip(names, best) for place, (s, n) in enumerate(reversed(own), 1)]
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate((pa.int64(), pa.int32(), pa.int64(), pa.int64()))], ["query_id", "rank", "vec_id", "score"])


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """The k highest inner products of each query with all vectors but its own.

    vectors, queries: ``vec_id long, v array<double>`` of whole numbers, as
    integer_vectors makes them.  Returns ``query_id, rank, vec_id, score``, rank
    from 1, ties to the smaller vec_id; all if there are fewer than k.

    Defined cases: only vectors of the query's length are candidates; rows that
    repeat a vec_id count once, with the least vector; equal vectors are ranked
    by vec_id; empty tables give no rows; scores have to fit a long.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "kdtree")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = vectors.count()
    # about SAMPLE vectors, by a hash of their ids; the limit holds where an id is repeated very often
    share = F.pmod(F.xxhash64("vec_id", F.lit("sample")), F.lit(1 << 30)) < F.lit(int(min(1.0, SAMPLE / max(1, rows)) * (1 << 30)))
    sample = vectors.where(share).limit(2 * SAMPLE).select("v").toArrow().column("v").combine_chunks()
    sample = sample.chunk(0) if isinstance(sample, pa.ChunkedArray) and sample.num_chunks else sample
    dims = sample.value_lengths().to_numpy(zero_copy_only=False) if len(sample) else np.zeros(0, np.int64)
    cells = -(-rows // SHARD_ROWS)
    cuts = {d: Cuts(_matrix(sample.take(pa.array(np.flatnonzero(dims == d)))), cells) for d in np.unique(dims).tolist() if d}

    def packed(table: DataFrame, size: int, build: Callable, name: str) -> DataFrame:
        """Rows of one cell together, at most about ``size``, as one value."""
        placed = scratch.cut(table.select("vec_id", "v").mapInArrow(_placed(cuts), "vec_id long, v array<double>, dim int, cell long"), f"{name}-placed")
        # a row for each cell and length: the cells are SAMPLE / CELL at most
        pieces = placed.groupBy("dim", "cell").agg(F.ceil(F.count(F.lit(1)) / size).alias("pieces"))
        part = F.expr("cell * 16777216 + pmod(xxhash64(vec_id), pieces)")
        dealt = placed.join(pieces, ["dim", "cell"]).select(part.alias("part"), "dim", "vec_id", "v")
        out = scratch.cut(dealt.repartition(n, "part", "dim").sortWithinPartitions("part", "dim").mapInArrow(build, PACKED), name)
        scratch.drop(placed)
        return out

    trees = packed(vectors, SHARD_ROWS, _trees, "trees")
    state = packed(queries, BLOCK, _blocks, "blocks").select("part", "dim", "blob")
    sheet = F.pmod(F.xxhash64("part"), F.greatest(F.lit(1), F.ceil(F.lit(trees.count()) / BOXES))).alias("part")
    sheets = trees.select(sheet, "dim", "box").repartition(n, "part", "dim").sortWithinPartitions("part", "dim").mapInArrow(_box_sheets, PACKED)
    sheets = scratch.cut(sheets.select("dim", F.col("blob").alias("sheet")), "boxes")
    trees = trees.select(F.col("part").alias("shard"), "dim", F.col("blob").alias("tree"))

    width, at_once = 1, Window.partitionBy("part", "dim").orderBy(F.desc("bound"), "shard")
    while True:
        # blocks meet sheets of boxes of their length: a sheet is BOXES shards
        wanted = state.repartition(n, "part", "dim").join(sheets, "dim").select("part", "dim", "blob", "sheet").mapInArrow(_wanted(k), "part long, dim int, shard long, bound double")
        plan = scratch.cut(wanted.withColumn("_r", F.row_number().over(at_once)).where(F.col("_r") <= width).select("part", "dim", "shard"), "plan")
        if plan.isEmpty():
            break
        pairs = plan.join(state, ["part", "dim"]).repartition(n, "part", "dim", "shard").join(trees, ["shard", "dim"]).select("part", "dim", "shard", "blob", "tree")
        finds = scratch.cut(pairs.mapInArrow(_visit(k), PACKED).select("part", "dim", "blob"), "finds")
        both = state.withColumn("old", F.lit(0)).unionByName(finds.withColumn("old", F.lit(1)))
        merged = scratch.cut(both.repartition(n, "part", "dim").sortWithinPartitions("part", "dim", "old").mapInArrow(_merge(k), PACKED).select("part", "dim", "blob"), "merged")
        scratch.drop(plan, finds)
        state, width = merged, width * WAVE
    return state.mapInArrow(_finds, "query_id long, rank int, vec_id long, score long")
