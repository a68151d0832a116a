"""The pipeline, its stages' contract, and cases that are planted for each."""

import pytest

import corpus_pipeline
from tests.llm.brute import components, shingle_set

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def kept(spark, small):
    docs, out = spark.read.parquet(f"{small}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, small)
        rows = made.collect()
        out[name] = rows
        if name != corpus_pipeline.STAGES[-1][0]:
            assert made.columns == COLUMNS
            docs = spark.createDataFrame(rows, made.schema)
    return out


def test_stages_are_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near-duplicates", "repeated passages", "mix", "encode"]


def test_one_document_of_each_group_stays(kept):
    before = {r.doc_id: shingle_set(r.text, 5) for r in kept["toxicity"]}
    wanted = components(before, 80, 100)
    assert {r.doc_id for r in kept["near-duplicates"]} == {i for i in wanted if wanted[i] == i}


def test_passages_are_cut_and_rows_stay(kept):
    assert [r.doc_id for r in sorted(kept["repeated passages"])] == [r.doc_id for r in sorted(kept["near-duplicates"])]
    assert all(r.n_chars == len(r.text) for r in kept["repeated passages"])


def test_the_mix_takes_from_what_is_there(kept):
    there = {r.doc_id: r.text for r in kept["repeated passages"]}
    assert all(there[r.doc_id] == r.text for r in kept["mix"])
    assert len(kept["encode"]) == len(kept["mix"])


def test_run_gives_the_last_stage(spark, small, kept):
    out = corpus_pipeline.run(spark, small)
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, kept["encode"]))


def test_every_stage_takes_nulls_repeats_extra_columns_and_no_rows(spark, small):
    text = " ".join(f"word{i}" for i in range(70))
    other = " ".join(f"term{i}" for i in range(70))
    rows = [
        (1, text, "en", "s1", 1, "a", 0), (5, text, "en", "s1", 1, "b", 1), (5, other, None, None, None, "c", 2), (5, other, None, None, None, "d", 3), (7, other, "en", "s1", 1, "e", 4),
        (None, None, None, None, None, "f", 5), (8, None, "en", "s1", 1, "g", 6), (8, "", "en", "s1", 1, "h", 7), (None, "lone words here", "xx", "", 1, None, None),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, rejected string, removed long")
    stages = dict(corpus_pipeline.STAGES)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, small)
        assert out.columns == docs.columns
        got = [(r.doc_id, r.text, r.rejected) for r in out.collect()]
        if name != "mix":
            assert {t for _, t, _ in got} >= {None, "", "lone words here"}
        if name == "near-duplicates":
            # one row of each component, not one doc_id
            assert sorted(t for _, t, _ in got if t in (text, other)) == sorted([text, other])
            assert {(i, t) for i, t, _ in got if t in (text, other)} == {(1, text), (5, other)}
        if name == "repeated passages":
            assert sorted((t, x) for i, t, x in got if x and x in "abcde") == sorted([(text, "a"), ("", "b"), (other, "c"), (other, "d"), ("", "e")])
        assert stage(spark, docs.where("false"), small).collect() == []
    assert len(stages["encode"](spark, docs, small).collect()) == len(rows)
