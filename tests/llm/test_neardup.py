import random

import numpy as np
import pytest

from tessella.llm import nearlinks
from tessella.llm.components import connected_components
from tessella.llm.minhash import MinHasher, Posterior
from tessella.llm.neardup import drop_near_duplicates, near_duplicates
from tessella.llm.scratch import Scratch
from tests.llm.brute import components, shingle_set


def check(spark, rows, width=3, threshold=(85, 100)):
    out = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width, threshold).collect()
    sets = {i: shingle_set(t, width) for i, t in rows}
    wanted = components(sets, *threshold)
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in out) == sorted((i, len(sets[i]), wanted[i], wanted[i] == i) for i in sets)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_equals_brute_force_on_documents(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").collect()]
    check(spark, rows)
    if sf == "sf0.001":
        check(spark, rows, 5, (80, 100))


def near_copies(n, seed, edits):
    rng = random.Random(seed)
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(120)]
    rows = []
    for i in range(n):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = f"e{rng.randint(0, 10**6)}"
        rows.append((i, " ".join(w)))
    return rows


def test_a_large_group_just_around_the_threshold(spark, monkeypatch):
    monkeypatch.setattr(nearlinks, "BLOCK_ROWS", 16)
    check(spark, near_copies(150, 1, 9))


def test_defined_cases(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "a b"), (5, "A  b"), (6, "a b c d e"), (7, "x " * 3000), (8, "x x x"), (9, "x x x x")]
    check(spark, rows)
    twice = spark.createDataFrame([(5, "p q r s"), (5, "p q r s"), (None, "p q r s"), (None, "z z")], "doc_id long, text string")
    out = near_duplicates(twice, 3, (85, 100)).collect()
    assert sorted(((r.doc_id, r.component_id, r.kept) for r in out), key=repr) == sorted([(5, 5, True), (5, 5, True), (None, 5, False), (None, None, True)], key=repr)
    assert near_duplicates(twice.where("false")).collect() == []


def test_the_posterior_drops_few_true_pairs():
    rng = np.random.default_rng(7)
    test = Posterior(128, 0.85, 1e-4)
    for similarity, least, most in ((0.9, 0.999, 1), (0.85, 0.995, 1), (0.5, 0, 0.001)):
        same = rng.random((20_000, 128)) < similarity
        kept = len(test.alive(np.zeros_like(same, np.uint16), (~same).astype(np.uint16))) / len(same)
        assert least <= kept <= most


def test_signatures_estimate_similarity():
    hasher, rng = MinHasher(128, 32, 4), np.random.default_rng(3)
    pool = rng.integers(0, 2**63, 1500).astype(np.uint64)
    a, b = hasher.minima(pool[:1000]), hasher.minima(pool[500:])
    assert abs((a == b).mean() - 1 / 3) < 0.15


def test_components_of_long_paths_and_stars(spark):
    links = [(i, i + 1) for i in range(0, 100)] + [(200, i) for i in range(201, 260)] + [(300, 300), (None, 1)]
    out = connected_components(spark.createDataFrame(links, "u long, v long"), Scratch(spark, "test"))
    found = {r.id: r.root for r in out.collect()}
    assert found == {**{i: 0 for i in range(101)}, **{i: 200 for i in range(200, 260)}}
    assert connected_components(spark.createDataFrame([], "u long, v long"), Scratch(spark, "test")).collect() == []


def test_sets_of_many_sizes_in_one_bucket(spark, monkeypatch):
    # sizes over several steps of the threshold, all sharing a long start
    monkeypatch.setattr(nearlinks, "BLOCK_ROWS", 8)
    rng = random.Random(5)
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(400)]
    rows = [(i, " ".join(base[: rng.randint(60, 400)])) for i in range(120)]
    check(spark, rows)


def test_a_forged_agreement_of_low_bits_keeps_its_link():
    """An earlier band that agrees in the compared 16 bits only is not the pair's first shared band."""
    import pyarrow as pa

    hasher, test = MinHasher(128, 32, 4), Posterior(128, 0.85, 1e-6)
    members = np.random.default_rng(2).integers(0, 2**63, 500).astype(np.uint64)
    minima = hasher.minima(members)
    other = minima.copy()
    other[:4] ^= np.uint32(1 << 20)  # band 0 differs above the low 16 bits
    rows = [(b"a" * 16, minima), (b"b" * 16, other)]
    for band in (1, 2):
        table = pa.table(
            {"unit": ["u", "u"], "band": pa.array([band, band], pa.int32()), "digest": [d for d, _ in rows], "root": [d for d, _ in rows], "sig": [hasher.packed(m) for _, m in rows],
             "keys": pa.array([hasher.keys(m) for _, m in rows], pa.list_(pa.int64())), "part": pa.array([0, 0], pa.int32())}
        )
        u, v = nearlinks._across(table, hasher, test)
        # the two meet in the buckets of bands 1 and up, and band 1 has to claim the pair
        assert (u.tolist(), v.tolist()) == (([0], [1]) if band == 1 else ([], []))


def test_one_row_of_each_component_stays(spark):
    p, q = near_copies(1, 11, 0)[0][1], near_copies(1, 12, 0)[0][1]
    rows = [(1, p), (5, p), (5, q), (7, q), (8, q), (5, q), (9, None), (9, None), (None, p), (2, " "), (2, " ")]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, row long")
    out = drop_near_duplicates(df)
    assert out.columns == df.columns
    got = [(r.doc_id, r.text) for r in out.collect()]
    assert sorted(got, key=repr) == sorted([(1, p), (5, q), (9, None), (9, None), (2, " "), (2, " ")], key=repr)
    assert drop_near_duplicates(df.where("false")).collect() == []


@pytest.mark.parametrize("rows", [1, 3, 7, 100])
def test_whole_units_are_never_split(rows):
    import pyarrow as pa

    rng = random.Random(rows)
    names = [f"u{i:03d}" for i in range(40) for _ in range(rng.choice([1, 1, 2, 9]))]
    batches, at = [], 0
    while at < len(names):
        n = rng.choice([0, 1, 2, 5, 30])
        batches.append(pa.RecordBatch.from_arrays([pa.array(names[at : at + n], pa.string())], ["unit"]))
        at += n
    tables = [t.column("unit").to_pylist() for t in nearlinks.whole_units(iter(batches), "unit", rows)]
    assert sum(tables, []) == names
    assert all(not set(a) & set(b) for i, a in enumerate(tables) for b in tables[i + 1 :])
    assert all(len(set(t)) <= rows + 1 for t in tables)
