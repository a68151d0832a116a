"""Checks of submissions, as rows of errors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.text import blank


def answer_errors(rows: DataFrame) -> DataFrame:
    """``ord, error`` for answers (``ord, id, correct``): no id, an id seen before, a letter that isn't a to e."""
    first = Window.partitionBy(blank(F.col("id"))).orderBy("ord")
    checked = rows.withColumn("_n", F.row_number().over(first))
    errors = F.array(
        F.when(blank(F.col("id")) == "", "missing id"),
        F.when(F.col("_n") > 1, "duplicate id"),
        F.when(~F.lower(blank(F.col("correct"))).isin("a", "b", "c", "d", "e"), "correct must be one of a/b/c/d/e"),
    )
    return checked.select("ord", F.explode(F.filter(errors, lambda e: e.isNotNull())).alias("error"))


def caption_errors(rows: DataFrame) -> DataFrame:
    """``scenario_id, row_idx, error`` for captions (with ``label``): no label, a label seen before, a missing caption."""
    first = Window.partitionBy("scenario_id", "label").orderBy("row_idx")
    checked = rows.withColumn("_n", F.row_number().over(first))
    errors = F.array(
        F.when(F.col("label").isNull(), "labels must be a non-empty list"),
        F.when(F.col("label").isNotNull() & (F.col("_n") > 1), "duplicate label"),
        F.when(F.col("label").isNotNull() & F.col("caption_pedestrian").isNull(), "missing caption_pedestrian"),
        F.when(F.col("label").isNotNull() & F.col("caption_vehicle").isNull(), "missing caption_vehicle"),
    )
    return checked.select("scenario_id", "row_idx", F.explode(F.filter(errors, lambda e: e.isNotNull())).alias("error"))
