"""Scoring that can be stopped and resumed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def resumable(spark: SparkSession, source: str, schema: str, score: Callable[[DataFrame], DataFrame], output: str, checkpoint: str, key: str = "id") -> StreamingQuery:
    """Score the files that arrive in a folder, each id once, appended to Parquet.

    The checkpoint holds which files and ids are done; started again with it,
    the query goes on where it was.  It ends when all files there are scored.
    """
    rows = spark.readStream.schema(schema).parquet(source).dropDuplicates([key])
    return score(rows).writeStream.format("parquet").option("path", output).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def retried(candidates: DataFrame, scored: DataFrame, key: str = "id") -> DataFrame:
    """Candidates without a row that has scores: failed ones come again."""
    return candidates.join(scored.where(F.col("scores").isNotNull()).select(key), key, "left_anti")


def shard_rows(rows: DataFrame, count: int, index: int, order: str = "ord") -> DataFrame:
    """Every ``count``-th row from ``index``."""
    return rows.where(F.pmod(F.col(order), F.lit(count)) == index)
