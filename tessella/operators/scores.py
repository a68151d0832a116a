"""Option scores: normalising, combining, hard negatives.

Scores are rows ``id, source, letter, score``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def normalised(scores: DataFrame, mode: str = "center", letters: DataFrame | None = None) -> DataFrame:
    """Scores of each id and source, as they are, less their mean, or also over their deviation.

    mode: none, center or zscore (population deviation; centred only, if that is
    at most 1e-12).  letters: ``id, letter`` of the options; an id and source
    that lacks one, or has a score that isn't finite, is left out.
    """
    if mode not in ("none", "center", "zscore"):
        raise ValueError(f"mode {mode}")
    every = Window.partitionBy("id", "source")
    rows = scores
    if letters is not None:
        many = letters.groupBy("id").agg(F.count(F.lit(1)).alias("_options"))
        rows = scores.join(letters, ["id", "letter"], "left_semi").join(many, "id")
        rows = rows.where(F.lit(True)).withColumn("_held", F.count(F.lit(1)).over(every)).where("_held = _options").drop("_held", "_options")
    rows = rows.withColumn("_bad", F.max((~finite(F.col("score"))).cast("int")).over(every)).where("_bad = 0").drop("_bad")
    if mode == "none":
        return rows
    rows = rows.withColumn("score", F.col("score") - F.avg("score").over(every))
    if mode == "center":
        return rows
    spread = F.stddev_pop("score").over(every)
    return rows.withColumn("_s", spread).withColumn("score", F.when(F.col("_s") <= 1e-12, F.col("score")).otherwise(F.col("score") / F.col("_s"))).drop("_s")


def combined(scores: DataFrame, weights: Mapping[str, float], candidates: DataFrame, fallback: DataFrame | None = None, mode: str = "center") -> DataFrame:
    """``id, letter, origin``: the option with the highest weighted sum of normalised scores.

    candidates: ``id, letter`` of all options.  Of equals the smallest letter.
    An id without scores takes the fallback's letter, else its first option;
    origin says which.  Weights must be finite, none negative, one positive.
    """
    values = list(weights.values())
    if any(not w >= 0 or w == float("inf") for w in values) or not any(w > 0 for w in values):
        raise ValueError("weights must be finite, none negative and one positive")
    weight = F.when(F.lit(False), 0.0)
    for source, w in weights.items():
        weight = weight.when(F.col("source") == source, float(w))
    rows = normalised(scores.where(F.col("source").isin(*(s for s, w in weights.items() if w > 0))), mode, candidates)
    # sources in the order of their names, so that sums don't depend on the order of rows
    sums = rows.groupBy("id", "letter").agg(F.aggregate(F.array_sort(F.collect_list(F.struct("source", (weight * F.col("score")).alias("part")))), F.lit(0.0), lambda total, x: total + x.part).alias("total"))
    # equal but for the last bits of a sum is equal
    sums = sums.withColumn("total", F.round("total", 9))
    best = sums.groupBy("id").agg(F.max(F.struct("total", (-F.ascii("letter")).alias("small"), "letter")).alias("best"))
    out = candidates.groupBy("id").agg(F.min("letter").alias("first")).join(best, "id", "left")
    own = fallback.select("id", F.col("letter").alias("own")) if fallback is not None else None
    out = out.join(own, "id", "left") if own is not None else out.withColumn("own", F.lit(None).cast("string"))
    origin = F.when(F.col("best").isNotNull(), "scores").when(F.col("own").isNotNull(), "fallback").otherwise("default_first_option")
    return out.select("id", F.coalesce("best.letter", "own", "first").alias("letter"), origin.alias("origin"))


def hard_negatives(scores: DataFrame, correct: DataFrame) -> DataFrame:
    """The hardest wrong option of each question.

    scores: ``id, letter, score``; correct: ``id, correct``.  Returns ``id,
    correct, rejected, predicted, is_model_error, gold_score,
    hard_negative_score, gold_margin``; of equal scores the smaller letter.
    Questions without a finite score for every option they list, without the
    correct option, or without a wrong one are left out; invalid_scores has them.
    """
    grouped = scores.join(correct, "id").groupBy("id", "correct").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "letter"))).alias("ranked"), F.min(finite(F.col("score")).cast("int")).alias("sound"))
    gold = F.filter("ranked", lambda x: x.letter == F.col("correct"))
    wrong = F.filter("ranked", lambda x: x.letter != F.col("correct"))
    rows = grouped.where("sound = 1").where((F.size(gold) > 0) & (F.size(wrong) > 0))
    g, r = -gold[0].s, -wrong[0].s
    predicted = F.col("ranked")[0].letter
    return rows.select("id", "correct", wrong[0].letter.alias("rejected"), predicted.alias("predicted"), (predicted != F.col("correct")).alias("is_model_error"), g.alias("gold_score"), r.alias("hard_negative_score"), (g - r).alias("gold_margin"))


def invalid_scores(scores: DataFrame, correct: DataFrame) -> DataFrame:
    """``id, reason`` for questions that hard_negatives leaves out."""
    held = scores.groupBy("id").agg(F.min(finite(F.col("score")).cast("int")).alias("sound"), F.collect_set("letter").alias("letters"))
    joined = correct.join(held, "id", "left")
    reason = F.when(F.col("letters").isNull(), "missing scores").when(~F.array_contains("letters", F.col("correct")), "correct option is absent").when(F.col("sound") == 0, "non-finite score").when(F.size("letters") < 2, "no incorrect options")
    return joined.select("id", reason.alias("reason")).where("reason is not null")


def eligible(rows: DataFrame, selection: str = "errors_and_margin", max_margin: float = 2.0) -> DataFrame:
    """Hard negatives by selection: all, errors, margin, or errors_and_margin (either)."""
    near = F.col("gold_margin") <= max_margin
    rule = {"all": F.lit(True), "errors": F.col("is_model_error"), "margin": near, "errors_and_margin": F.col("is_model_error") | near}
    return rows.where(rule[selection])


def margin_summary(rows: DataFrame, value: str = "gold_margin", by: Sequence[str] = ()) -> DataFrame:
    """``n, min, median, mean, max`` of a value, in all or by keys; nulls if there is none."""
    aggregates = [F.count(value).cast("long").alias("n"), F.min(value).alias("min"), F.median(value).alias("median"), F.avg(value).alias("mean"), F.max(value).alias("max")]
    return rows.groupBy(*by).agg(*aggregates) if by else rows.agg(*aggregates)


def distributions(rows: DataFrame, fields: Sequence[str]) -> DataFrame:
    """``field, value, n`` for each value of each field."""
    pairs = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.coalesce(F.col(f).cast("string"), F.lit("")).alias("value")) for f in fields)))
    return rows.select(pairs.alias("p")).groupBy("p.field", "p.value").agg(F.count(F.lit(1)).cast("long").alias("n"))
