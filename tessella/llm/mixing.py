"""Mixing sources to target weights by hierarchical budgeting.

Leaves are the distinct values of the levels, such as (domain, language,
source).  A budget of tokens goes down the tree: a node's budget is dealt to
its children in proportion to their weights, no child getting more than its
leaves can give (their tokens times ``max_epochs``).  What a full child cannot
take goes to its siblings first; only what a whole node cannot take goes to
the node's own siblings.  A leaf gives whole epochs, then the prefix of one
more epoch in that epoch's seeded order.  Only DataFrame functions are used.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.scratch import Scratch

#: Bits of the seeded order that are resolved in a round, and rows below which rows are ordered themselves.
STEP_BITS, FINAL_ROWS = 10, 256
KEY_BITS = 60


def words_in(text: Column) -> Column:
    """Runs of bytes outside [\\x20\\x09-\\x0D], as a long; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def seeded_key(seed: str, epoch: Column, doc_id: Column) -> Column:
    """A 60-bit key that orders an epoch: the first 15 hex digits of an MD5."""
    digest = F.md5(F.concat(F.lit(f"{seed}|"), epoch.cast("string"), F.lit("|"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def _weight(level: Column, weights: Mapping[str, int], default: int) -> Column:
    chain = None
    for name, weight in weights.items():
        chain = F.when(level == name, weight) if chain is None else chain.when(level == name, weight)
    return (F.lit(default) if chain is None else chain.otherwise(default)).cast("long")


def _deal(nodes: DataFrame, parent: list[str], name: str, given: str) -> DataFrame:
    """Adds ``budget``: the part of the parent's budget ``given`` that each node takes.

    nodes: one row a node with ``cap`` and ``w``.  Nodes are filled in the order of
    cap / w; a node is full if, with those before it full, its share would be
    at least its cap.  The others share the rest by weight, rounded down.
    """
    among = Window.partitionBy(*parent)
    order = among.orderBy(F.when(F.col("w") > 0, F.col("cap") / F.col("w")).asc_nulls_last(), name)
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    onward = F.sum("w").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    full = (F.col("w") > 0) & ((F.col(given) - F.col("_before")) * F.col("w") >= F.col("cap") * F.col("_onward"))
    nodes = nodes.withColumns({"_before": before, "_onward": onward}).withColumn("_full", full)
    taken = F.sum(F.when(F.col("_full"), F.col("cap")).otherwise(0)).over(among)
    open_ = F.sum(F.when(F.col("_full"), 0).otherwise(F.col("w"))).over(among)
    nodes = nodes.withColumns({"_taken": taken, "_open": open_})
    share = F.when(F.col("_open") > 0, F.expr(f"(w * ({given} - _taken)) div _open")).otherwise(0)
    return nodes.withColumn("budget", F.when(F.col("_full"), F.col("cap")).otherwise(share).cast("long")).drop("_before", "_onward", "_full", "_taken", "_open")


def leaf_budgets(leaves: DataFrame, levels: list[str], weights: list[Mapping[str, int]], total: Column, max_epochs: int, default_weight: int = 1) -> DataFrame:
    """leaves (levels, ``tokens``, ``docs``) with ``budget``."""
    table = leaves.withColumn("cap", F.col("tokens") * max_epochs)
    above = table.agg(total.alias("_given")).withColumn("_root", F.lit(0))
    parents: list[str] = ["_root"]
    for depth, level in enumerate(levels):
        keys = levels[: depth + 1]
        nodes = table.withColumn("_root", F.lit(0)).groupBy("_root", *keys).agg(F.sum("cap").alias("cap")).withColumn("w", _weight(F.col(level), weights[depth], default_weight))
        nodes = _deal(nodes.join(above, parents), parents, level, "_given")
        above = nodes.select("_root", *keys, F.col("budget").alias("_given"))
        parents = ["_root", *keys]
    return leaves.join(above.drop("_root").withColumnRenamed("_given", "budget"), levels)


def mix_sources(
    docs: DataFrame,
    levels: Mapping[str, Column],
    weights: list[Mapping[str, int]],
    total: Column | None = None,
    max_epochs: int = 4,
    seed: str = "mix",
    tokens: Column | None = None,
    default_weight: int = 1,
) -> DataFrame:
    """Rows of docs, each as often as the mix takes it, with the levels, ``tokens`` and ``epoch``.

    docs: ``doc_id long``, what the expressions need, and any other columns,
    which pass through.  levels: name to expression, from the root down; a null
    value is the level's value "".  weights: for each level, integer weights by
    value; values that are not named weigh ``default_weight``, and a weight of
    0 takes nothing.  total: an aggregate over the leaves' ``tokens`` and
    ``docs``; all tokens if None.  tokens: tokens of a row; words of ``text`` if
    None.

    A leaf's budget is rounded down.  Of an epoch that is not whole the mix
    takes the longest prefix, in the order of a seeded key and doc_id, whose
    tokens are within what is left of the budget.  Defined cases: rows with one
    doc_id are taken together; rows without tokens come with the prefix that
    reaches them and with every whole epoch; a leaf without tokens has no
    budget and gives nothing; an empty table gives nothing; columns of docs
    with the names of the results are replaced.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mixing")
    names = list(levels)
    passed = [c for c in docs.columns if c not in (*names, "tokens", "epoch")]
    tokens = words_in(F.col("text").cast("string")) if tokens is None else tokens
    rows = docs.withColumns({**{x: F.coalesce(c.cast("string"), F.lit("")) for x, c in levels.items()}, "tokens": tokens})
    slim = scratch.cut(rows.select(F.col("doc_id").cast("long").alias("doc_id"), *names, "tokens"), "slim")
    leaves = scratch.cut(slim.groupBy(*names).agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("docs")), "leaves")
    budgets = leaf_budgets(leaves, names, weights, F.coalesce(F.sum("tokens"), F.lit(0)).cast("long") if total is None else total, max_epochs, default_weight)
    whole = F.when(F.col("tokens") > 0, F.expr("budget div tokens")).otherwise(0)
    plan = budgets.select(*names, "docs", whole.cast("int").alias("whole"), F.when(F.col("tokens") > 0, F.expr("budget % tokens")).otherwise(0).alias("rest"))
    plan = scratch.cut(plan, "plan")

    # the cut of the last epoch: narrow each leaf to the range of keys that holds it, STEP_BITS a round
    largest = plan.where("rest > 0").agg(F.max("docs").alias("n")).first().n or 0
    open_ = plan.where("rest > 0").select(*names, "whole", "rest").withColumns({"low": F.lit(0).cast("long"), "under": F.lit(0).cast("long")})
    bits = 0
    keyed = slim.join(plan.where("rest > 0").select(*names, "whole"), names).withColumn("u", seeded_key(seed, F.col("whole"), F.col("doc_id")))
    keyed = scratch.cut(keyed.select(*names, "doc_id", "tokens", "u"), "keyed")
    while largest >> bits > FINAL_ROWS:
        open_ = scratch.cut(open_, "open")
        inside = keyed.join(open_, names).where(F.shiftright(F.col("u"), KEY_BITS - bits) == F.shiftright(F.col("low"), KEY_BITS - bits) if bits else F.lit(True))
        bits += STEP_BITS
        step = inside.groupBy(*names, F.shiftright("u", KEY_BITS - bits).alias("part")).agg(F.sum("tokens").alias("held"))
        # at most 2 ** STEP_BITS parts in a leaf
        over = Window.partitionBy(*names).orderBy("part")
        step = step.join(open_, names).withColumn("reach", F.col("under") + F.sum("held").over(over))
        # the first part that goes beyond the rest, or the last one
        first = step.groupBy(*names).agg(F.min(F.when(F.col("reach") > F.col("rest"), F.struct("part", F.col("reach") - F.col("held")))).alias("a"), F.max(F.struct("part", F.col("reach") - F.col("held"))).alias("z"))
        first = first.select(*names, F.coalesce("a", "z").alias("at")).select(*names, F.expr(f"shiftleft(at.part, {KEY_BITS - bits})").alias("low"), F.col("at.col2").alias("under"))
        open_ = open_.select(*names, "whole", "rest").join(first, names)
    open_ = scratch.cut(open_, "open")
    inside = keyed.join(open_, names).where(F.shiftright(F.col("u"), KEY_BITS - bits) == F.shiftright(F.col("low"), KEY_BITS - bits) if bits else F.lit(True))
    # about FINAL_ROWS rows of each leaf
    reach = F.col("under") + F.sum("tokens").over(Window.partitionBy(*names).orderBy("u", "doc_id"))
    last = inside.withColumn("reach", reach).where("reach <= rest").groupBy(*names).agg(F.max(F.struct("u", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("d"))).alias("last"))
    cut = open_.join(last, names, "left").select(*names, "low", F.col("last.u").alias("last_u"), F.col("last.d").alias("last_d"))
    # a row for each leaf; Spark broadcasts it if its size allows
    decided = scratch.cut(plan.select(*names, "whole").join(cut, names, "left"), "decided")

    u = seeded_key(seed, F.col("whole"), F.col("doc_id"))
    d = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    # rows before the range that holds the cut, and those of the range up to the last one taken
    partly = F.coalesce((F.col("_u") < F.col("low")) | (F.col("_u") < F.col("last_u")) | ((F.col("_u") == F.col("last_u")) & (d <= F.col("last_d"))), F.col("_u") < F.col("low"), F.lit(False))
    taken = rows.drop("epoch").join(decided, names).withColumn("_u", u).withColumn("_epochs", F.col("whole") + F.when(partly, 1).otherwise(0)).where("_epochs > 0")
    return taken.withColumn("epoch", F.explode(F.expr("sequence(0, _epochs - 1)"))).select(*passed, *names, "tokens", "epoch")
