"""Voting: one answer from many sources.

Votes are rows ``id, source, letter`` and, where named, ``weight``.  Each way
of voting has its own rule for ties.  Weights are whole numbers (hundredths,
say), so that sums and ties are exact whatever the order of rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.fixed import LETTERS


def tally(votes: DataFrame, weight: Column | None = None, keys: Sequence[str] = ("id",)) -> DataFrame:
    """``score`` by keys and letter: counts, or sums of weights."""
    return votes.groupBy(*keys, "letter").agg((F.count(F.lit(1)) if weight is None else F.sum(weight)).cast("long").alias("score"))


def vote(votes: DataFrame, fallback: DataFrame, weight: Column | None = None) -> DataFrame:
    """``id, letter, score``: the highest score; of equals the fallback's letter, else the smallest.

    fallback: ``id, letter``, one row an id.
    """
    scored = tally(votes, weight).join(fallback.select("id", F.col("letter").alias("fallback")), "id", "left")
    # greatest score, then the fallback's letter, then the smallest letter
    best = F.max(F.struct("score", (F.col("letter") == F.coalesce("fallback", F.lit("a"))).alias("own"), (-F.ascii("letter")).alias("small"), "letter"))
    return scored.groupBy("id").agg(best.alias("best")).select("id", F.col("best.letter").alias("letter"), F.col("best.score").alias("score"))


def missing_votes(votes: DataFrame, ids: DataFrame, sources: Sequence[str]) -> DataFrame:
    """``id, source`` for each id that a source has no vote on."""
    wanted = ids.select("id").withColumn("source", F.explode(F.array(*map(F.lit, sources))))
    return wanted.join(votes.select("id", "source").distinct(), ["id", "source"], "left_anti")


def strict_vote(votes: DataFrame, fallback: DataFrame, sources: Sequence[str], weight: Column | None = None) -> DataFrame:
    """As vote, over the fallback's ids; an id that a source lacks is an error."""
    lacking = missing_votes(votes, fallback, sources).limit(1).collect()
    if lacking:
        raise ValueError(f"source {lacking[0].source} has no vote on id {lacking[0].id}")
    return vote(votes.where(F.col("source").isin(*sources)).join(fallback.select("id"), "id", "left_semi"), fallback, weight)


def routed_vote(votes: DataFrame, routes: Mapping[str, Sequence[str]], weights: Mapping[str, int], fallback: str, questions: DataFrame) -> DataFrame:
    """``id, letter, score``: a weighted vote of the sources on the route of a question's type.

    questions: ``id, question_type``.  The fallback source ends every route.
    Votes that aren't a to e don't count.  Of equal letters that of the source
    first on the route wins; an id without votes takes the fallback's answer.
    """
    # one row for each type and source: fixed by the route table
    rows = [(kind, source, place, weights.get(source, 100)) for kind, route in routes.items() for place, source in enumerate(dict.fromkeys((*route, fallback)))]
    table = F.broadcast(votes.sparkSession.createDataFrame(rows, "question_type string, source string, place int, weight int"))
    routed = questions.join(votes, "id").join(table, ["question_type", "source"]).where(F.col("letter").isin(*LETTERS))
    scored = routed.groupBy("id", "letter").agg(F.sum("weight").cast("long").alias("score"), F.min("place").alias("place"))
    best = scored.groupBy("id").agg(F.max(F.struct("score", (-F.col("place")).alias("early"), "letter")).alias("best"))
    default = votes.where(F.col("source") == fallback).select("id", F.col("letter").alias("default"))
    out = questions.select("id").join(best, "id", "left").join(default, "id", "left")
    return out.select("id", F.coalesce("best.letter", "default").alias("letter"), F.coalesce("best.score", F.lit(0)).cast("long").alias("score"))


def resolved_rule(rules: Mapping, question_type: str, available: Sequence[str], fallback: str) -> tuple[list[str], str]:
    """(inputs, fallback) of a question type: its rule, else the default one, else the fallback alone.

    A rule is a list of sources or an object of ``inputs`` and ``fallback``; a
    source that ends in "?" may be missing, any other one must be there.
    """
    rule = rules.get("types", {}).get(question_type, rules.get("default"))
    own = str(rule.get("fallback", fallback)) if isinstance(rule, Mapping) else fallback
    named = rule.get("inputs", [own]) if isinstance(rule, Mapping) else [fallback] if rule is None else rule
    if not isinstance(named, (list, tuple)):
        raise ValueError(f"the rule for {question_type} names no list of sources")
    named = [str(x).strip() for x in named]
    lacking = [x for x in (*named, own) if not x.endswith("?") and x not in available]
    if lacking:
        raise ValueError(f"the rule for {question_type} names a missing source: {lacking[0]}")
    inputs = [x.removesuffix("?") for x in named if x.removesuffix("?") in available]
    return inputs or [own], own


def ruled_vote(votes: DataFrame, rules: Mapping, available: Sequence[str], questions: DataFrame) -> DataFrame:
    """``id, letter, score``: a vote of the sources that rules name for a question's type.

    rules: ``fallback`` (else the first source), ``default`` and ``types``, as
    resolved_rule reads them.  questions: ``id, question_type``; a question that
    the general fallback lacks is an error.  Of equal letters the rule's own
    fallback's counts.
    """
    general = str(rules.get("fallback", available[0])).strip()
    if general not in available:
        raise ValueError(f"the fallback is missing: {general}")
    lone = missing_votes(votes, questions, [general]).limit(1).collect()
    if lone:
        raise ValueError(f"the fallback has no vote on id {lone[0].id}")
    # question types are a fixed list
    kinds = [r.question_type for r in questions.select("question_type").distinct().collect()]
    rows = [(kind, source, own) for kind in kinds for inputs, own in [resolved_rule(rules, kind, available, general)] for source in dict.fromkeys(inputs)]
    table = F.broadcast(votes.sparkSession.createDataFrame(rows, "question_type string, source string, own string"))
    taking = questions.select("id", "question_type").join(table, "question_type")
    cast = votes.join(taking, ["id", "source"]).select("id", "source", "letter")
    own = taking.select("id", F.col("own").alias("source")).distinct().join(votes, ["id", "source"]).select("id", "letter")
    voted = vote(cast, own)
    default = votes.where(F.col("source") == general).select("id", F.col("letter").alias("default"))
    return default.join(questions.select("id"), "id", "left_semi").join(voted, "id", "left").select("id", F.coalesce("letter", "default").alias("letter"), F.coalesce("score", F.lit(0)).cast("long").alias("score"))


def first_disputed(votes: DataFrame, questions: DataFrame, n: int = 3) -> DataFrame:
    """``id, ord``: the first n questions on which the sources' answers differ, or the first n if none is disputed.

    questions: ``id, ord``.  Empty answers don't count.
    """
    differ = votes.where("coalesce(letter, '') <> ''").groupBy("id").agg((F.min("letter") < F.max("letter")).alias("differ")).where("differ").select("id")
    # n rows each
    some = questions.select("id", "ord").join(differ, "id", "left_semi").orderBy("ord").limit(n).withColumn("disputed", F.lit(True))
    plain = questions.select("id", "ord").orderBy("ord").limit(n).withColumn("disputed", F.lit(False))
    both = some.unionByName(plain).withColumn("_any", F.max("disputed").over(Window.partitionBy(F.lit(0))))
    return both.where(F.col("disputed") == F.col("_any")).select("id", "ord")


def self_consistency(votes: DataFrame, fallback: DataFrame, min_votes: int = 8, min_margin: int = 3) -> DataFrame:
    """``id, letter, votes, margin, changed``: the top letter if it has enough votes and lead, else the fallback's.

    Of equal letters the largest counts as the top.
    """
    counts = tally(votes)
    top = counts.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("score", "letter")), False).alias("ranked"))  # five letters at most
    first, second = F.col("ranked")[0], F.coalesce(F.get("ranked", F.lit(1)).score, F.lit(0))
    rated = fallback.select("id", F.col("letter").alias("fallback")).join(top, "id", "left")
    votes_, margin = F.coalesce(first.score, F.lit(0)), F.coalesce(first.score - second, F.lit(0))
    taken = (votes_ >= min_votes) & (margin >= min_margin)
    chosen = F.when(taken, first.letter).otherwise(F.col("fallback"))
    return rated.select("id", chosen.alias("letter"), votes_.cast("long").alias("votes"), margin.cast("long").alias("margin"), (chosen != F.col("fallback")).alias("changed"))


def disagreements(votes: DataFrame, fallback: DataFrame, min_disagree: int = 2, max_rows: int = 0) -> DataFrame:
    """``id, ord, disagree``: ids on which sources contradict the fallback, in its order.

    At least ``min_disagree`` sources differ and some other letter has two
    votes.  fallback: ``id, ord, letter``.  max_rows 0 is no limit.
    """
    against = votes.join(fallback.select("id", "ord", F.col("letter").alias("fallback")), "id").where("letter <> fallback")
    counts = against.groupBy("id", "ord", "letter").agg(F.count(F.lit(1)).alias("n"))
    out = counts.groupBy("id", "ord").agg(F.sum("n").cast("long").alias("disagree"), F.max("n").alias("most")).where((F.col("disagree") >= min_disagree) & (F.col("most") >= 2)).drop("most")
    return out.orderBy("ord").limit(max_rows) if max_rows else out


def pairwise_disagreement(votes: DataFrame) -> DataFrame:
    """``left, right, shared, differ`` for each pair of sources; a row a source in each id, so pairs stay few."""
    a = votes.select("id", F.col("source").alias("left"), F.col("letter").alias("l"))
    b = votes.select("id", F.col("source").alias("right"), F.col("letter").alias("r"))
    both = a.join(b, "id").where("left < right")
    return both.groupBy("left", "right").agg(F.count(F.lit(1)).cast("long").alias("shared"), F.count_if(F.col("l") != F.col("r")).cast("long").alias("differ"))


def majority(votes: DataFrame, group: Sequence[str], value: str, min_size: int = 2, min_top: int = 2, min_share: float = 0.75) -> DataFrame:
    """The top value of each group that has the size, count and share: group, ``top, top_count, size``.

    Of equal values the one seen first (``ord``) is the top.
    """
    counts = votes.groupBy(*group, value).agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("first"))
    best = counts.groupBy(*group).agg(F.max(F.struct("n", (-F.col("first")).alias("early"), F.col(value).alias("top"))).alias("best"), F.sum("n").alias("size"))
    out = best.select(*group, F.col("best.top").alias("top"), F.col("best.n").cast("long").alias("top_count"), F.col("size").cast("long").alias("size"))
    return out.where((F.col("size") >= min_size) & (F.col("top_count") >= min_top) & (F.col("top_count") / F.col("size") >= min_share))
