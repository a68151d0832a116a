"""Queries over odd texts against their SQL."""

import re

from pyspark.sql import functions as F

from tessella.functions import text
from tessella.functions.fixed import PROTECTED_PATTERNS, PROTECTED_TERMS
from tessella.plans.oracles import SQL
from tessella.plans.queries import QUERIES
from tests.oracle import assert_same, connect
from tests.test_operators import one

ODD = (None, "", "...", " . ", "!!! a", "0997 | x. 1 two 1. 2. Three ", "\r\n a.  b ", "İstanbul is big. Yes.", "x\x00y. z", "😀 b.\tc")


def test_sentences_of_odd_texts_match_sql(spark, tmp_path):
    spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/d")
    next((tmp_path / "d").glob("part-*")).rename(tmp_path / "documents.parquet")
    assert_same(QUERIES["sentence_split"](spark, str(tmp_path)), connect(tmp_path), SQL["sentence_split"])


def test_sentences_keep_digits_and_lose_blanks(spark):
    given = "0 km/h was told. 1 lane 1.  Two. "
    assert one(spark, text.sentences_kept(F.lit(given))) == ["0 km/h was told.", "1 lane 1.", "Two."]
    assert one(spark, text.sentences_split(F.lit("0 is 0\n. 1 lane 1!  2"))) == ["0 is 0\n.", "1 lane 1!", "2"]


def test_protected_items_are_compiled_and_the_same(spark):
    texts = ("", "At 20 km/h, 30  km/h and 20km/h on a wet, dry Asphalt road.", "2 meters\n in \t height, 1 meter in width, 170 cm.", "Two-way traffic; heavy\ttraffic  volume, usual traffic.", "street lights")
    rows = spark.createDataFrame([(t,) for t in (*texts, None)], "t string")
    items = rows.select("t", text.protected_items(F.col("t")).alias("x"))
    assert "lambda" not in items._jdf.queryExecution().toString()
    for t, found in items.collect():
        low = (t or "").lower()
        assert set(found) == {w for w in PROTECTED_TERMS if w in low} | {re.sub(r"\s+", " ", m.group()) for p in PROTECTED_PATTERNS for m in re.finditer(p, low)}
        assert len(set(found)) == len(found)
