"""Evaluation of predictions, and audits of answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions.text import blank
from tessella.operators.captions import ROLES
from tessella.operators.metrics import accuracy, caption_metrics
from tessella.operators.repair import entropy, prior_question
from tessella.operators.votes import pairwise_disagreement


def preferred_captions(phases: DataFrame) -> DataFrame:
    """The captions of each scenario's preferred view: overhead, else the first view by name."""
    order = F.struct((F.col("view") != "overhead_view").alias("other"), "view")
    best = phases.groupBy("scenario_id").agg(F.min(order).alias("v")).select("scenario_id", F.col("v.view").alias("view"))
    return phases.join(best, ["scenario_id", "view"], "left_semi")


def caption_pairs(references: DataFrame, predictions: DataFrame) -> DataFrame:
    """``pair, candidate, reference, missing`` for each role of each reference; a missing prediction is an empty text.

    references, predictions: ``scenario_id, phase`` and captions.
    """
    predicted = predictions.select("scenario_id", "phase", *(F.col(f"caption_{r}").alias(f"_{r}") for r in ROLES), F.lit(True).alias("_there")).dropDuplicates(["scenario_id", "phase"])
    joined = references.join(predicted, ["scenario_id", "phase"], "left")
    pair = F.explode(F.array(*(F.struct(F.lit(r).alias("role"), blank(F.col(f"_{r}")).alias("candidate"), blank(F.col(f"caption_{r}")).alias("reference")) for r in ROLES)))
    rows = joined.select("scenario_id", "phase", F.col("_there").isNull().alias("missing"), pair.alias("p"))
    return rows.select(F.concat_ws("|", "scenario_id", "phase", "p.role").alias("pair"), "p.candidate", "p.reference", "missing")


def evaluate_captions(phases: DataFrame, predictions: DataFrame) -> DataFrame:
    """One row of caption metrics over the preferred views, with the number of phases that have no prediction."""
    pairs = caption_pairs(preferred_captions(phases), predictions)
    # one row each
    return caption_metrics(pairs.select("pair", "candidate", "reference")).crossJoin(pairs.agg((F.count_if("missing") / len(ROLES)).cast("long").alias("missing")))


def evaluate_answers(questions: DataFrame, predictions: DataFrame) -> DataFrame:
    """One row ``correct, total, accuracy`` over the questions."""
    return accuracy(predictions, questions.select("id", "correct"))


def gold_answers(questions: DataFrame) -> DataFrame:
    """The right answers as predictions."""
    return questions.select("id", F.col("correct").alias("letter"))


def question_overlap(train: DataFrame, asked: DataFrame) -> DataFrame:
    """One row: rows and distinct questions on both sides, and how many of those asked were seen in training."""
    known = train.select(prior_question(F.col("question")).alias("q")).distinct()
    rows = asked.select(prior_question(F.col("question")).alias("q"))
    seen = rows.join(known, "q", "left_semi")
    sides = [t.agg(F.count(F.lit(1)).alias(f"{n}_rows"), F.countDistinct("q").alias(f"{n}_questions")) for n, t in (("train", train.select(prior_question(F.col("question")).alias("q"))), ("asked", rows), ("seen", seen))]
    return sides[0].crossJoin(sides[1]).crossJoin(sides[2])


def answer_audit(questions: DataFrame) -> DataFrame:
    """``question_type, n, values, entropy`` of the right answers."""
    return entropy(questions, ["question_type"], "correct")


def submission_audit(votes: DataFrame) -> DataFrame:
    """How far each two submissions differ."""
    return pairwise_disagreement(votes)
