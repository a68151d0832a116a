"""A training-data pipeline over ``documents``: filter, deduplicate, mix, encode.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is
written as Parquet and read again as the next stage's ``docs``.  All stages but
the last return the columns of their docs, in their order.

Defined cases, for each stage: an empty table gives an empty one; a null text is
kept, as a text without words is linked with nothing and has nothing to reject
or cut; rows with a null or repeated doc_id are rows like others, and of a
component of near-duplicates one row stays, not one doc_id; columns beyond those
of documents pass through, whatever their names; the mix may leave out any row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import neardup
from tessella.llm.paragraphs import dedup_passages
from tessella.llm.queries import encoded, mixed
from tessella.llm.scratch import Scratch
from tessella.llm.toxicity import toxicity


COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _apart(docs: DataFrame) -> DataFrame:
    """docs with its extra columns under names that no operator uses."""
    return docs.select(*(F.col(f"`{c}`").alias(c if c in COLUMNS else f"_extra_{i}") for i, c in enumerate(docs.columns)))


def _back(out: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs under their own names."""
    return out.select(*(F.col(c if c in COLUMNS else f"_extra_{i}").alias(c) for i, c in enumerate(docs.columns)))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain does not reject; the chain is fitted on the labelled ones."""
    scored = toxicity(_apart(docs), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _back(scored.where(~F.col("rejected")), docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near-duplicates: one of the least doc_id."""
    return neardup.drop_near_duplicates(docs, width=5, threshold=(80, 100))


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that an earlier document holds; n_chars follows."""
    cut = dedup_passages(_apart(docs))
    return _back(cut.withColumn("n_chars", F.when(F.size("removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars").cast("long"))), docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many tokens as there are, by target weights of domain, language and source."""
    return _back(mixed(_apart(docs)), docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of what they decode to."""
    return encoded(docs.select("doc_id", "text")).drop("text")


STAGES = [
    ("toxicity", drop_toxic),
    ("near-duplicates", drop_near_duplicates),
    ("repeated passages", cut_repeated_passages),
    ("mix", mix),
    ("encode", encode),
]

#: The stages hold a fitted model, a banded component search and BPE: no SQL expresses them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
