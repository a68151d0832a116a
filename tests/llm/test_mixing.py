import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessella.llm import mixing
from tessella.llm.mixing import leaf_budgets, mix_sources
from tessella.llm.queries import QUERIES, SQL
from tests.oracle import assert_same, connect

def levels():
    return {"domain": F.col("domain"), "lang": F.col("lang")}


@pytest.mark.parametrize("rows", [256, 4])
def test_equals_its_sql(spark, small, monkeypatch, rows):
    monkeypatch.setattr(mixing, "FINAL_ROWS", rows)
    monkeypatch.setattr(mixing, "STEP_BITS", 2 if rows == 4 else 10)
    assert_same(QUERIES["op10_source_mix"](spark, small), connect(small), SQL["op10_source_mix"])


def fill(caps, weights, budget):
    """Water filling by steps: siblings share what full ones cannot take."""
    out, open_ = {}, dict(caps)
    while open_:
        left, w = budget - sum(out.values()), sum(weights[k] for k in open_)
        full = [k for k in open_ if w and left * weights[k] / w >= open_[k]]
        if not full:
            return out | {k: left * weights[k] / w if w else 0 for k in open_}
        k = min(full, key=lambda k: open_[k] / weights[k])
        out[k] = open_.pop(k)
    return out


def test_shortages_go_to_siblings_before_ancestors(spark):
    rng = random.Random(5)
    leaves = [(d, x, rng.randint(1, 4000), 3) for d in "pq" for x in "abc"]
    weights = [{"p": 70, "q": 30}, {"a": 50, "b": 30, "c": 20}]
    out = leaf_budgets(spark.createDataFrame(leaves, "domain string, lang string, tokens long, docs long"), ["domain", "lang"], weights, F.lit(9000).cast("long"), 2)
    found = {(r.domain, r.lang): r.budget for r in out.collect()}
    caps = {(d, x): 2 * t for d, x, t, _ in leaves}
    top = fill({d: sum(c for (e, _), c in caps.items() if e == d) for d in "pq"}, weights[0], 9000)
    for d in "pq":
        for x, wanted in fill({x: caps[d, x] for x in "abc"}, weights[1], top[d]).items():
            assert abs(found[d, x] - wanted) <= 2


def test_prefixes_keep_to_the_budget(spark):
    rows = [(i, "d", "x" if i % 3 else "y", "w " * (1 + i % 7)) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, domain string, lang string, text string")
    total = sum(len(t.split()) for *_, t in rows)
    out = mix_sources(docs, levels(), [{}, {"x": 1, "y": 3}], max_epochs=3).collect()
    tokens = Counter()
    for r in out:
        tokens[r.lang] += r.tokens
    assert total - 14 <= sum(tokens.values()) <= total and abs(tokens["y"] / total - 0.75) < 0.02
    assert max(Counter((r.doc_id, r.epoch) for r in out).values()) == 1
    again = mix_sources(docs.repartition(5), levels(), [{}, {"x": 1, "y": 3}], max_epochs=3).collect()
    assert sorted((r.doc_id, r.epoch) for r in out) == sorted((r.doc_id, r.epoch) for r in again)


def test_defined_cases(spark):
    rows = [(1, None, None, "a b", 1), (2, "d", "x", None, 1), (3, "d", "x", "", 1), (None, "d", "x", "a", 1), (4, "d", "y", "w " * 5000, 1), (4, "d", "y", "w " * 5000, 1), (5, "e", "z", "", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, domain string, lang string, text string, epoch int")
    out = mix_sources(docs, levels(), [{"d": 1, "": 1, "e": 0}, {}], max_epochs=2).collect()
    assert {r.doc_id for r in out} <= {1, 2, 3, None, 4} and sum(r.tokens for r in out) <= 10_003
    assert Counter(r.doc_id for r in out)[4] % 2 == 0
    assert mix_sources(docs.where("false"), levels(), [{}, {}]).collect() == []
