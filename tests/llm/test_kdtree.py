import numpy as np
import pytest

from tessella.llm import kdtree
from tessella.llm.kdtree import Tree, integer_vectors, top_k


def brute(ids, vectors, queries, k):
    out = {}
    for q in queries:
        i = ids.index(q)
        scored = sorted((-int(sum(int(a) * int(b) for a, b in zip(vectors[i], v))), n) for n, v in zip(ids, vectors) if n != q)[:k]
        out[q] = [(n, -s) for s, n in scored]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


@pytest.fixture
def shards(monkeypatch):
    monkeypatch.setattr(kdtree, "SHARD_ROWS", 100)
    monkeypatch.setattr(kdtree, "LEAF", 16)
    monkeypatch.setattr(kdtree, "BLOCK", 8)
    monkeypatch.setattr(kdtree, "CELL", 8)
    monkeypatch.setattr(kdtree, "BOXES", 3)


def test_equals_brute_force_with_ties_and_copies(spark, shards):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 6)) / 4
    x[50:120] = x[50]
    ids = list(range(400))
    v = integer_vectors(spark.createDataFrame([(i, [float(a) for a in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>"), 64)
    out = found(top_k(v, v.where("vec_id % 20 = 0"), 20))
    assert out == brute(ids, np.floor(64 * x).astype(int).tolist(), list(range(0, 400, 20)), 20)


def test_boxes_save_visits():
    rng = np.random.default_rng(2)
    v = np.floor(64 * np.concatenate([rng.normal(c * 5, 0.05, size=(1000, 4)) for c in (-1, 0, 1)]))
    tree = Tree(np.arange(3000), v)
    opened = []
    plain = kdtree.products
    kdtree.products = lambda a, b: opened.append(len(b)) or plain(a, b)
    try:
        tree.search(v[:4], np.arange(4), 5, [[] for _ in range(4)])
    finally:
        kdtree.products = plain
    assert sum(opened[2:]) < 3 * 3000


def test_cells_hold_what_was_cut(spark):
    rng = np.random.default_rng(3)
    v = np.floor(rng.normal(size=(4000, 5)) * 64)
    v[1000:3000] = v[0]
    cuts = kdtree.Cuts(v, 16)
    cell = cuts.place(v)
    assert 1 < cuts.cells <= 16 and set(cell) <= set(range(cuts.cells)) and len(set(cell[1000:3000])) == 1


def test_most_shards_are_never_visited_where_boxes_are_apart(spark, shards, monkeypatch):
    """Twenty clusters on a line: a query's best are in the last ones, so a block's tree visits stay few."""
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal((c, 1, 1), 0.01, size=(100, 3)) for c in range(20)])
    v = integer_vectors(spark.createDataFrame([(i, [float(a) for a in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>"), 64)
    asked = v.where("vec_id % 20 = 0")
    plans = []
    cut = kdtree.Scratch.cut

    def seen(self, df, name="t"):
        out = cut(self, df, name)
        if name in ("plan", "blocks", "trees"):
            plans.append((name, out.count()))
        return out

    monkeypatch.setattr(kdtree.Scratch, "cut", seen)
    out = found(top_k(v, asked, 5))
    assert out == brute(list(range(2000)), np.floor(64 * x).astype(int).tolist(), list(range(0, 2000, 20)), 5)
    count = {name: sum(c for n, c in plans if n == name) for name in ("plan", "blocks", "trees")}
    assert count["trees"] >= 16 and count["plan"] <= 0.3 * count["blocks"] * count["trees"]


def test_defined_cases(spark):
    rows = [(1, [1.0, 0.0], "x"), (2, None, "x"), (3, [None, 1.0], "x"), (4, [float("nan"), 1.0], "x"), (5, [float("inf"), 0.0], "x"), (20, [1.0, 1.0], "x"), (20, [1.0, 1.0], "x"), (6, [1.0, 2.0, 3.0], "x"), (None, [1.0, 1.0], "x"), (7, [-0.01, 1e-9], "x"), (40, [1.0], "x")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    v = integer_vectors(table, 64)
    assert found(top_k(v, v.where("vec_id % 20 = 0"), 20)) == {20: [(1, 4096), (7, -64)]}
    assert top_k(v.where("false"), v.where("false"), 20).collect() == []
    assert top_k(v, v.where("false"), 20).collect() == []


def test_large_numbers_are_exact(spark):
    rows = [(0, [2.0**40, 3.0]), (1, [2.0**21, 1.0]), (2, [2.0**21, 2.0])]
    v = integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 1)
    assert found(top_k(v, v.where("vec_id = 0"), 2)) == {0: [(2, 2**61 + 6), (1, 2**61 + 3)]}
