"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.scratch import Scratch


def _settled(edges: DataFrame) -> bool:
    """Whether the links are stars: every greater end has one link and is no link's least end."""
    ends = edges.select(F.col("u").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("id"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    open_ = ends.groupBy("id").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where((F.col("up") > 1) | ((F.col("up") == 1) & (F.col("down") == 1)))
    return not open_.agg(F.count(F.lit(1)).alias("n")).first().n


def connected_components(links: DataFrame, scratch: Scratch, max_rounds: int = 60) -> DataFrame:
    """``(id, root)`` for every end of a link; root is the least id it can reach.

    links: columns ``u`` and ``v`` of one ordered type; loops and repeats are
    allowed, nulls are dropped.  Each round turns stars towards smaller ids and
    is cut to a table; minima are aggregated before they are exchanged, so a
    vertex with very many links costs a row per task.  Ends when all components
    are stars, after a number of rounds that grows with the logarithm of the
    component's diameter.
    """
    edges = scratch.cut(links.select("u", "v").where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    for _ in range(max_rounds):
        if _settled(edges):
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # repeats among these links change no minimum; the next exchange drops them
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        near = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(near, "u")
        small = joined.select("u", F.col("m").alias("v")).unionByName(joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()
        turned = scratch.cut(small, "stars")
        scratch.drop(edges)
        edges = turned
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return edges.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())
