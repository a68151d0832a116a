import hashlib
import random

import numpy as np

from tessella.llm.fingerprints import _of, fingerprints, likeness, neighbour_fingerprints, unpacked
from tests.llm.brute import shingle_set


def jaccard(a, b):
    a, b = shingle_set(a, 5), shingle_set(b, 5)
    return len(a & b) / len(a | b) if a | b else 1.0


def check(spark, rows, partitions=None):
    df = spark.createDataFrame(rows, "doc_id long, text string, near_next string")
    out = neighbour_fingerprints(df.repartition(partitions) if partitions else df).collect()
    assert len(out) == len(rows)
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    wanted = []
    for i, (doc, text, _) in enumerate(order):
        text, after = text or "", order[(i + 1) % len(order)][1] or ""
        half = len(text) // 2
        changed = text[: len(text) - half] + after[:half]
        wanted.append((doc, len(text), hashlib.sha256(changed.encode()).hexdigest(), jaccard(text, changed), jaccard(text, after)))
    key = lambda r: (str(r[0]), r[1], r[2])
    for r, w in zip(sorted(((r.doc_id, r.n_chars, r.edited_sha256, r.near_edited, r.near_next) for r in out), key=key), sorted(wanted, key=key)):
        assert r[:3] == w[:3]
        assert abs(r[3] - w[3]) < 0.12 and abs(r[4] - w[4]) < 0.12
    return out


def test_documents_in_descending_order(spark, small):
    rows = [(r.doc_id, r.text, "x") for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    out = check(spark, rows)
    by_text = {}
    for r in out:
        text = next(t for d, t, _ in rows if d == r.doc_id)
        assert by_text.setdefault(text, r.fingerprint) == r.fingerprint


def test_defined_cases(spark):
    check(spark, [(3, None, ""), (2, "", ""), (5, "a b c d e f g", ""), (5, "a b", ""), (None, "n n n", ""), (9, "é" * 5, ""), (1, "w " * 9000, "")])
    check(spark, [(1, "alone in the table", "")])
    check(spark, [(1, "one text", ""), (1, "one text", "")])
    assert neighbour_fingerprints(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_likeness_is_close_to_similarity():
    rng = random.Random(4)
    errors = []
    for share in (0.1, 0.5, 0.9):
        for n in (30, 400):
            a = [f"w{rng.randint(0, 10**6)}" for _ in range(n)]
            b = a[: int(n * share)] + [f"v{rng.randint(0, 10**6)}" for _ in range(n - int(n * share))]
            left, right = _of([" ".join(a), " ".join(b)], 5)
            errors.append(likeness(left, right) - jaccard(" ".join(a), " ".join(b)))
    assert max(map(abs, errors)) < 0.1 and abs(np.mean(errors)) < 0.04


def test_packed_form_reads_back(spark):
    rows = fingerprints(spark.createDataFrame([(1, "a b c d e f"), (2, None)], "doc_id long, text string")).orderBy("doc_id").collect()
    assert np.array_equal(unpacked(rows[0].fingerprint), _of(["a b c d e f"], 5)[0]) and rows[1].fingerprint == ""
