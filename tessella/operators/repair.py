"""Repairing answers by consensus, priors and calibration."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.classify import question_type, stable_question
from tessella.functions.fixed import ANSWER_ALIASES, DYNAMIC_PATTERNS, LETTERS, PRIOR_TYPES, QUESTION_TYPOS, STABLE_TYPES
from tessella.functions.text import holds_any, question_key, squash
from tessella.operators.selection import capped, change_cap
from tessella.operators.votes import majority


def option_letter(options: Column, text: Column, normal) -> Column:
    """The first letter, in order, whose option reads like ``text`` after ``normal``."""
    entries = F.array_sort(F.map_entries(options))
    return F.get(F.filter(entries, lambda e: normal(e["value"]) == text), F.lit(0))["key"]


def _stable(questions: DataFrame, types: Sequence[str]) -> DataFrame:
    rows = questions.withColumn("question_type", question_type(F.col("question"), F.col("scope")))
    return rows.where(stable_question(F.col("question"), F.col("question_type"), tuple(types))).withColumn("question_norm", question_key(F.col("question")))


def consistent_answers(questions: DataFrame, answers: DataFrame, stable_types: Sequence[str] = STABLE_TYPES, min_size: int = 2, min_top: int = 2, min_share: float = 0.75, max_changes: int = 0) -> DataFrame:
    """``id, old, new`` for answers that go with the majority of their scenario's stable question.

    questions: ``id, ord, scenario_id, question, scope, options``; answers:
    ``id, letter``.  The majority's letter must be an option of every question
    in the group.  max_changes counts in the order of groups, then ord.
    """
    keys = ["scenario_id", "question_type", "question_norm"]
    rows = _stable(questions, stable_types).where((F.trim("scenario_id") != "") & (F.trim("question") != "")).join(answers, "id")
    best = majority(rows, keys, "letter", min_size, min_top, min_share)
    joined = rows.join(best, keys)
    # the share of members that have the option must be all of them
    valid = joined.groupBy(*keys).agg(F.bool_and(F.map_contains_key("options", F.col("top"))).alias("valid")).where("valid").select(*keys)
    changes = joined.join(valid, keys, "left_semi").where("letter <> top").select("id", *keys, "ord", F.col("letter").alias("old"), F.col("top").alias("new"))
    return capped(changes, [*keys, "ord"], max_changes).select("id", "old", "new")


def text_key(text: Column) -> Column:
    """An option's text in lower case, "gray" for "grey", "km/h" for "km / h", without periods, colons and dashes at its ends."""
    low = F.regexp_replace(F.lower(F.trim(text)), "grey", "gray")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(low, r"\bkm / h\b", "km/h"), r"\s+", " "), r"^[.:-]+|[.:-]+$", "")


def family(scenario: Column) -> Column:
    """The first three parts of a normal clip's scenario name; other names as they are."""
    parts = F.split(scenario, "_")
    return F.when(F.contains(scenario, F.lit("_normal_")) & (F.size(parts) >= 3), F.array_join(F.slice(parts, 1, 3), "_")).otherwise(scenario)


def consistent_texts(questions: DataFrame, answers: DataFrame, min_size: int = 2, min_top: int = 2, min_share: float = 0.75, max_changes: int = 0, include_scope: bool = False, family_types: Sequence[str] = ()) -> DataFrame:
    """As consistent_answers, by the texts of the answers: ``id, old, new``.

    Stable here are environment questions and stable wording.  Of equal texts
    the smallest is the top.  A question takes the first option with the top
    text; one that has none is left alone.  Questions of ``family_types`` are
    grouped over a normal clip's family.
    """
    rows = questions.withColumn("question_type", question_type(F.col("question"), F.col("scope")))
    q = question_key(F.col("question"))
    rows = rows.where((F.col("scope") == "environment") & ~holds_any(q, DYNAMIC_PATTERNS) | stable_question(F.col("question"), F.lit(""), ("-",)))
    group = F.when(F.col("question_type").isin(*family_types), family(F.col("scenario_id"))).otherwise(F.col("scenario_id")) if family_types else F.col("scenario_id")
    rows = rows.withColumns({"group": group, "question_norm": q, "part": F.col("scope") if include_scope else F.lit("")}).join(answers, "id")
    keys = ["group", "part", "question_type", "question_norm"]
    said = rows.withColumn("said", text_key(F.element_at("options", F.col("letter")))).where("said <> ''")
    counts = said.groupBy(*keys, "said").agg(F.count(F.lit(1)).alias("n"))
    # greatest count, then the smallest text
    best = counts.groupBy(*keys).agg(F.min(F.struct((-F.col("n")).alias("m"), "said")).alias("b"), F.sum("n").alias("size"))
    best = best.select(*keys, F.col("b.said").alias("top"), (-F.col("b.m")).alias("top_count"), "size").where((F.col("size") >= min_size) & (F.col("top_count") >= min_top) & (F.col("top_count") / F.col("size") >= min_share))
    changes = rows.join(best, keys).withColumn("new", option_letter(F.col("options"), F.col("top"), text_key)).where("new is not null and new <> letter")
    return capped(changes.select("id", *keys, "ord", F.col("letter").alias("old"), "new"), [*keys, "ord"], max_changes).select("id", "old", "new")


def prior_question(text: Column) -> Column:
    """A question's key with its known typos mended."""
    q = question_key(text)
    for wrong, right in QUESTION_TYPOS:
        q = F.replace(q, F.lit(wrong), F.lit(right))
    return q


def prior_answer(text: Column) -> Column:
    """A lower-case answer with its alias put in."""
    low = F.lower(squash(text))
    out = F.when(F.lit(False), low)
    for alias, name in ANSWER_ALIASES.items():
        out = out.when(low == alias, name)
    return out.otherwise(low)


def answer_priors(train: DataFrame) -> DataFrame:
    """``question_norm, top, top_count, count``: the commonest answer to each question; of equals the first seen.

    train: ``ord, question, answer``.
    """
    counts = train.select("ord", prior_question(F.col("question")).alias("question_norm"), prior_answer(F.col("answer")).alias("answer"))
    counts = counts.groupBy("question_norm", "answer").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("first"))
    best = counts.groupBy("question_norm").agg(F.max(F.struct("n", (-F.col("first")).alias("early"), "answer")).alias("b"), F.sum("n").alias("count"))
    return best.select("question_norm", F.col("b.answer").alias("top"), F.col("b.n").cast("long").alias("top_count"), F.col("count").cast("long").alias("count"))


def prior_decisions(train: DataFrame, questions: DataFrame, answers: DataFrame, min_count: int = 20, min_share: float = 0.95, types: Sequence[str] | None = PRIOR_TYPES) -> DataFrame:
    """Each question's ``decision``: why it keeps its answer, or "change" with ``old, new, share, count``."""
    rows = questions.withColumns({"question_type": question_type(F.col("question"), F.col("scope")), "question_norm": prior_question(F.col("question"))})
    rows = rows.join(answer_priors(train), "question_norm", "left").join(answers, "id", "left")
    share = F.col("top_count") / F.greatest("count", F.lit(1))
    new = option_letter(F.col("options"), F.col("top"), prior_answer)
    rows = rows.withColumns({"share": share, "new": new})
    blocked = ~F.col("question_type").isin(*types) if types is not None else F.lit(False)
    decision = (
        F.when(blocked, "type_block").when(F.col("count").isNull(), "unseen_question").when(F.col("count") < min_count, "low_count").when(F.col("share") < min_share, "low_share")
        .when(F.col("new").isNull(), "answer_not_option").when(F.coalesce("letter", F.lit("")) == "", "missing_base").when(F.col("letter") == F.col("new"), "already_same").otherwise("change")
    )
    return rows.select("id", "question_type", decision.alias("decision"), F.col("letter").alias("old"), "new", "share", "count")


def prior_changes(decisions: DataFrame, max_changes: int = 0) -> DataFrame:
    """``id, old, new``: the changes with the surest priors first, ``max_changes`` at most."""
    rows = decisions.where("decision = 'change'")
    return capped(rows, [F.desc(F.round("share", 4)), F.desc("count"), "question_type", "id"], max_changes).select("id", "old", "new")


def applied(answers: DataFrame, changes: DataFrame) -> DataFrame:
    """answers with the changes put in."""
    return answers.join(changes.select("id", "new"), "id", "left").select("id", F.coalesce("new", "letter").alias("letter"))


def chosen_models(validation: DataFrame, mode: Mapping[str, float], models: Sequence[str], baselines: Sequence[str]) -> DataFrame:
    """``question_type, model, accepted, best_acc, baseline_acc``: the best model of each type that has enough rows.

    validation: ``question_type, source, correct, letter``.  Of equal
    accuracies the one with more rows, then the first in ``models``.
    """
    same = F.coalesce(F.col("letter") == F.col("correct"), F.lit(False))
    rates = validation.groupBy("question_type", "source").agg(F.count(F.lit(1)).alias("n"), F.round(F.count_if(same) / F.count(F.lit(1)), 6).alias("acc")).where(F.col("n") >= mode["min_n"])
    place = F.array_position(F.array(*map(F.lit, models)), F.col("source"))
    best = rates.where(F.col("source").isin(*models)).groupBy("question_type").agg(F.max(F.struct("acc", "n", (-place).alias("early"), "source")).alias("b"))
    base = rates.where(F.col("source").isin(*baselines)).groupBy("question_type").agg(F.max("acc").alias("baseline_acc"))
    rows = best.join(base, "question_type", "left").select("question_type", F.col("b.source").alias("model"), F.col("b.acc").alias("best_acc"), F.coalesce("baseline_acc", F.lit(0.0)).alias("baseline_acc"))
    return rows.withColumn("accepted", (F.col("best_acc") >= mode["min_acc"]) & (F.col("best_acc") - F.col("baseline_acc") >= mode["margin"]))


def calibrated_answers(questions: DataFrame, votes: DataFrame, choices: DataFrame, mode: Mapping[str, float], models: Sequence[str], fallback: str) -> DataFrame:
    """``id, letter, changed``: the chosen model's answer if enough models share it, for the first changes in order.

    questions: ``id, ord, question_type``.  Changes beyond ``change_cap`` of
    all questions keep the fallback's answer.
    """
    named = votes.select("id", "source", "letter")
    base = questions.join(named.where(F.col("source") == fallback).select("id", F.col("letter").alias("fallback")), "id", "left")
    picked = base.join(choices.where("accepted").select("question_type", F.col("model").alias("source")), "question_type", "left").join(named, ["id", "source"], "left")
    support = named.where(F.col("source").isin(*models)).groupBy("id", "letter").agg(F.count(F.lit(1)).alias("support"))
    rows = picked.join(support, ["id", "letter"], "left")
    take = F.col("letter").isin(*LETTERS) & (F.coalesce("support", F.lit(0)) >= mode["support"])
    rows = rows.select("id", "ord", F.coalesce("fallback", F.lit("")).alias("fallback"), F.when(take, F.col("letter")).otherwise(F.coalesce("fallback", F.lit(""))).alias("selected"))
    changed = rows.where("selected <> fallback").orderBy("ord").limit(change_cap(questions.count(), mode["change_cap"])).select("id", F.col("selected").alias("new"))
    return rows.join(changed, "id", "left").select("id", F.coalesce("new", "fallback").alias("letter"), F.col("new").isNotNull().alias("changed"))


def entropy(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """``keys, n, values, entropy``: base-2 entropy of the values of each key."""
    counts = rows.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("c"))
    share = F.col("c") / F.sum("c").over(Window.partitionBy(*keys))
    return counts.withColumn("h", -share * F.log2(share)).groupBy(*keys).agg(F.sum("c").cast("long").alias("n"), F.count(F.lit(1)).cast("long").alias("values"), F.round(F.sum("h"), 4).alias("entropy"))
