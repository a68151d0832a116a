"""Joins that list-shaped data needs: by position, strict, with defaults, by key or else position."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def zipped(left: DataFrame, right: DataFrame, order: str = "ord") -> DataFrame:
    """Rows of equal position; different lengths are an error."""
    n, m = (t.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max(order) + 1, F.lit(0)).alias("top")).first() for t in (left, right))
    if n.n != m.n:
        raise ValueError(f"{n.n} rows meet {m.n} predictions")
    return left.join(right, order)


def strict(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join; a left row without a partner is an error."""
    lone = left.join(right, list(keys), "left_anti").select(*keys).limit(1).collect()
    if lone:
        raise ValueError(f"no partner for {lone[0].asDict()}")
    return left.join(right, list(keys))


def with_default(left: DataFrame, right: DataFrame, keys: Sequence[str], defaults: dict[str, Column]) -> DataFrame:
    """Left join; missing values of the right side's columns take defaults."""
    joined = left.join(right, list(keys), "left")
    return joined.withColumns({name: F.coalesce(F.col(name), default) for name, default in defaults.items()})


def by_key_or_place(left: DataFrame, right: DataFrame, group: str, key: str, place: str, values: Sequence[str]) -> DataFrame:
    """left with the values of the right row of its group that has its key, else of the one at its place.

    Of several rows with the key the first by place counts.
    """
    keyed = right.groupBy(group, key).agg(F.min_by(F.struct(*values), place).alias("_key"))
    placed = right.groupBy(group, place).agg(F.first(F.struct(*values)).alias("_place"))
    joined = left.join(keyed, [group, key], "left").join(placed, [group, place], "left")
    return joined.select(*left.columns, *(F.coalesce(F.col(f"_key.{v}"), F.col(f"_place.{v}")).alias(f"other_{v}") for v in values))


def unfinished(candidates: DataFrame, done: DataFrame, key: str, valid: Column | None = None) -> DataFrame:
    """Candidates without a finished row; rows of ``done`` that aren't valid don't count."""
    return candidates.join((done if valid is None else done.where(valid)).select(key), key, "left_anti")


def first_other(rows: DataFrame, group: Sequence[str], order: str, value: str) -> DataFrame:
    """rows with ``other``: the first value of the group, by order, that differs from the row's own.

    Only a group's first row and the first that differs from it can be the
    answer, so the group is two values.
    """
    first = rows.groupBy(*group).agg(F.min_by(value, order).alias("_first"))
    second = rows.join(first, list(group)).where(~F.col(value).eqNullSafe(F.col("_first"))).groupBy(*group).agg(F.min_by(value, order).alias("_second"))
    joined = rows.join(first, list(group)).join(second, list(group), "left")
    return joined.withColumn("other", F.when(F.col(value).eqNullSafe(F.col("_first")), F.col("_second")).otherwise(F.col("_first"))).drop("_first", "_second")


def retrieve(queries: DataFrame, bank: DataFrame, k: int, score: Column, steps: Sequence[Sequence[str]], exclude: str | None = None) -> DataFrame:
    """The k best rows of a bank for each query, looked up in steps of fewer equal columns.

    queries: ``query_id`` and the columns named in steps (prefix ``q_``); bank:
    ``style_id`` and those columns.  score may use columns of both.  steps go
    from the most equal columns to the fewest, and any match in one step must
    score higher than all in later ones.  A query only goes to the next step
    while it has fewer than k rows, so the whole bank is met by the few queries
    that need it.  Of equal scores the smaller style_id.
    """
    found, waiting = None, queries
    for columns in steps:
        condition = F.lit(True)
        for c in columns:
            condition = condition & (F.col(f"q_{c}") == F.col(c))
        if exclude:
            condition = condition & (F.col(f"q_{exclude}") != F.col(exclude))
        met = waiting.join(bank, condition).select("query_id", "style_id", score.alias("score"))
        found = met if found is None else found.unionByName(met).dropDuplicates(["query_id", "style_id"])
        enough = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= k)
        waiting = waiting.join(enough, "query_id", "left_anti")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "style_id")
    return found.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)
