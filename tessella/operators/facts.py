"""Traffic facts: kept flat, as rows ``scenario_id, phase, key, value``; nested only on the way out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.classify import fact_key
from tessella.functions.fixed import RETURN_JSON


def fact_rows(questions: DataFrame, answers: DataFrame | None = None) -> DataFrame:
    """``scenario_id, phase, key, value``: what the answers say; the last question on a key wins.

    questions: ``id, ord, scenario_id, scope, phase, question, options`` and, if
    no answers are given, ``correct``.  A letter without an option is its own
    value.
    """
    rows = questions.join(answers.select("id", F.col("letter").alias("_letter")), "id") if answers is not None else questions.withColumn("_letter", F.col("correct"))
    text = F.coalesce(F.try_element_at("options", F.col("_letter")), F.col("_letter"))
    keyed = rows.select("scenario_id", "phase", fact_key(F.col("question"), F.col("scope")).alias("key"), text.alias("value"), "ord")
    return keyed.groupBy("scenario_id", "phase", "key").agg(F.max_by("value", "ord").alias("value"))


def fact_table(facts: DataFrame, keys: list[str]) -> DataFrame:
    """One row a scenario and phase with a column for each key, dots as double underscores."""
    return facts.groupBy("scenario_id", "phase").agg(*(F.max(F.when(F.col("key") == k, F.col("value"))).alias(k.replace(".", "__")) for k in keys))


def fact_context(facts: DataFrame, global_limit: int = 12, phase_limit: int = 16) -> DataFrame:
    """``scenario_id, phase, context``: lines "key: value" in the order of keys, a scenario's own facts at most global_limit, a phase's at most phase_limit."""
    order = Window.partitionBy("scenario_id", "phase").orderBy("key")
    kept = facts.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= F.when(F.col("phase").isNull(), global_limit).otherwise(phase_limit))
    line = F.concat(F.lit("- "), "key", F.lit(": "), "value")
    # a few dozen lines at most
    return kept.groupBy("scenario_id", "phase").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("key", line.alias("line")))), lambda x: x.line), "\n").alias("context"))


def put_before(text: Column, block: Column, marker: str = RETURN_JSON) -> Column:
    """text with a block before the first marker, else at its end; an empty block changes nothing."""
    at = F.instr(text, marker)
    before, after = text.substr(F.lit(1), at - 1), text.substr(at, F.length(text))
    return F.when(F.coalesce(block, F.lit("")) == "", text).when(at > 0, F.concat(before, block, F.lit("\n\n"), after)).otherwise(F.concat(F.rtrim(text), F.lit("\n\n"), block))


def with_facts(rows: DataFrame, facts: DataFrame, global_limit: int = 12, phase_limit: int = 16) -> DataFrame:
    """rows (``scenario_id, phase, instruction``) with the facts of their scenario and phase put into the prompt, and ``fact_conditioned``."""
    context = fact_context(facts, global_limit, phase_limit)
    whole = context.where("phase is null").select("scenario_id", F.col("context").alias("_whole"))
    own = context.where("phase is not null").select("scenario_id", "phase", F.col("context").alias("_own"))
    joined = rows.join(whole, "scenario_id", "left").join(own, ["scenario_id", "phase"], "left")
    parts = [F.when(F.col("_whole").isNotNull(), F.concat(F.lit("Scenario facts:\n"), "_whole")), F.when(F.col("_own").isNotNull(), F.concat(F.lit("Phase facts:\n"), "_own"))]
    block = F.array_join(F.filter(F.array(*parts), lambda p: p.isNotNull()), "\n")
    return joined.withColumns({"instruction": put_before(F.col("instruction"), block), "fact_conditioned": block != ""}).drop("_whole", "_own")


def _nested(roles: Column) -> Column:
    """A JSON object of objects that are JSON already."""
    parts = F.transform(roles, lambda x: F.concat(F.to_json(F.array(x["role"])).substr(F.lit(2), F.length(F.to_json(F.array(x["role"]))) - 2), F.lit(":"), x["j"]))
    return F.concat(F.lit("{"), F.array_join(parts, ","), F.lit("}"))


def scene_graph(facts: DataFrame) -> DataFrame:
    """``scenario_id, phase, graph``: facts of a scenario (null phase) or phase as JSON, by role and attribute, both sorted; empty values are left out."""
    kept = facts.where(F.trim("value") != "")
    role, attribute = F.substring_index("key", ".", 1), F.regexp_replace("key", r"^[^.]*\.?", "")
    rows = kept.select("scenario_id", "phase", role.alias("role"), F.when(attribute == "", F.lit("value")).otherwise(attribute).alias("attribute"), "value")
    # a few dozen facts at most
    roles = rows.groupBy("scenario_id", "phase", "role").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("attribute", "value")))).alias("m"))
    return roles.groupBy("scenario_id", "phase").agg(_nested(F.array_sort(F.collect_list(F.struct("role", F.to_json("m").alias("j"))))).alias("graph"))


def graph_facts(graphs: DataFrame) -> DataFrame:
    """``scenario_id, phase, key, value`` of scene graphs: what scene_graph made of them."""
    roles = graphs.select("scenario_id", "phase", F.explode(F.from_json("graph", "map<string,map<string,string>>")).alias("role", "m"))
    rows = roles.select("scenario_id", "phase", "role", F.explode("m").alias("attribute", "value"))
    return rows.select("scenario_id", "phase", F.when(F.col("attribute") == "value", F.col("role")).otherwise(F.concat_ws(".", "role", "attribute")).alias("key"), "value")


def ordered_media(rows: DataFrame, most: int) -> DataFrame:
    """``scenario_id, phase, videos``: the distinct videos of a phase over all its rows (``ord, videos``), in order, ``most`` at most (0: all)."""
    each = rows.select("scenario_id", "phase", "ord", F.posexplode("videos").alias("pos", "video"))
    first = each.groupBy("scenario_id", "phase", "video").agg(F.min(F.struct("ord", "pos")).alias("at"))
    videos = F.transform(F.array_sort(F.collect_list(F.struct("at", "video"))), lambda x: x.video)
    return first.groupBy("scenario_id", "phase").agg((F.slice(videos, 1, most) if most else videos).alias("videos"))
