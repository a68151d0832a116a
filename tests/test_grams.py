"""N-grams counted row by row, and banks of heavy grams, against brute force."""

import inspect
import math
import random
from collections import Counter

import pytest

from tessella.operators import captions, ranker, slots
from tessella.operators.grams import with_gram_f1
from tests.test_whole_tables import gram_f1, up_to


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


CAPTIONS = "source string, scenario_id string, row_idx int, phase string, caption_pedestrian string, caption_vehicle string"


def rows(spark):
    said = random.Random(3)
    made = [(s, f"s{i}", 0, str(i % 2), " ".join(said.choices(["he", "walks", "road", "red", "on"], k=9)) + ".", "The vehicle stops.") for i in range(8) for s in ("base", "new")]
    return spark.createDataFrame(made, CAPTIONS)


def test_f1_of_a_row_is_that_of_counted_grams(spark):
    said = random.Random(1)
    texts = [tuple(" ".join(said.choices("abcd", k=said.randrange(40))) for _ in range(2)) for _ in range(50)] + [("", "a b"), ("", ""), (None, "a")]
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(texts)], "i int, x string, y string")
    for r in with_gram_f1(df, "x", "y", {"one": 1, "two": 2, "four": 4}).collect():
        assert (r.one, r.two, r.four) == pytest.approx(tuple(gram_f1(r.x or "", r.y or "", n) for n in (1, 2, 4)))


def test_slot_scores_explode_no_grams(spark):
    facts = spark.createDataFrame([("s1", None, "k", "red")], "scenario_id string, phase string, key string, value string")
    df = slots.slot_scores(rows(spark), rows(spark).where("source = 'base'"), facts, "base")
    assert "Generate" not in plan(df) and df.count() == 16


def test_bank_scores_explode_no_grams(spark):
    bank = spark.createDataFrame([("global:role:pedestrian", "he walks", 2.0), ("phase:1:role:pedestrian", "road", 3.0)], "bank string, gram string, weight double")
    df = ranker.bank_scores(rows(spark), "base", bank)
    assert "Generate" not in plan(df) and df.count() == 16


def test_the_ranker_is_not_fitted_on_the_driver(spark):
    seen = spark.createDataFrame([(f"s{i}", 0, s, t, {"bias": 1.0, s: 1.0}) for i in range(5) for s, t in (("a", 0.2), ("b", 0.9))], "scenario_id string, row_idx int, source string, target double, f map<string,double>")
    assert ranker.train_ranker(seen) == pytest.approx({"bias": 0.0, "a": -0.1, "b": 0.1})
    assert "toLocalIterator" not in inspect.getsource(ranker.train_ranker)


def texts(spark):
    said = random.Random(2)
    made = [(i % 40, "ab"[i % 2], " ".join(said.choices([f"w{k}" for k in range(30)], k=20))) for i in range(60)]
    return made, spark.createDataFrame(made, "doc long, bank string, text string")


def test_a_bank_writes_only_grams_of_full_buckets(spark, monkeypatch):
    made, df = texts(spark)
    seen = []
    count = captions.gram_counts
    monkeypatch.setattr(captions, "gram_counts", lambda docs, wanted, n: seen.append(wanted) or count(docs, wanted, n))
    found = {(r.bank, r.gram): r.weight for r in captions.phrase_bank(df, 3, 5).collect()}
    for bank in "ab":
        df_, all_, docs = Counter(), Counter(), {}
        for i, b, t in made:
            if b == bank:
                docs.setdefault(i, Counter()).update(up_to(t, 3))
        for c in docs.values():
            df_.update(c.keys())
            all_.update(c)
        weight = {g: round(n * max(math.log((len(docs) + 1) / (df_[g] + 0.5)), 0.05), 6) for g, n in all_.items()}
        want = sorted(weight.items(), key=lambda x: (-x[1], x[0]))[:5]
        assert {g: w for (b, g), w in found.items() if b == bank} == pytest.approx(dict(want))
    grams = {(b, g) for _, b, t in made for g in up_to(t, 3)}
    assert sum(int(x.sum()) for wanted in seen for x in wanted.values()) < len(grams)


def test_overlap_explodes_only_ids_of_several_rows(spark):
    made, df = texts(spark)
    bank = spark.createDataFrame([("a", "w1", 2.0), ("b", "w2 w3", 5.0), ("b", "w7", 1.0)], "bank string, gram string, weight double")
    whole = df.where("doc >= 20").withColumnRenamed("doc", "id")
    assert "Generate" not in plan(captions.bank_overlap(whole, bank))
    weights = {(r.bank, r.gram): r.weight for r in bank.collect()}
    found = {r.id: r.overlap for r in captions.bank_overlap(df.withColumnRenamed("doc", "id"), bank).collect()}
    for i in range(40):
        c = Counter()
        for j, b, t in made:
            if j == i:
                c.update({(b, g): n for g, n in up_to(t, 4).items()})
        c = {k: min(n, 3) for k, n in c.items()}
        assert found[i] == pytest.approx(sum(n * weights.get(k, 0.0) for k, n in c.items()) / sum(c.values()))
