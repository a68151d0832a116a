"""Text-only training and inference rows: realising, selecting, segmenting and rewriting captions.

Phases are rows ``scenario_id, scenario_type, view, phase, ord`` with captions.
Headings of prompts are parameters, since they depend on the model at hand.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions import text
from tessella.functions.segments import SEGMENTS, caption_of, caption_segments
from tessella.operators.captions import ROLES, unpivoted
from tessella.operators.facts import fact_context
from tessella.operators.joins import first_other

KEYS = ("scenario_id", "scenario_type", "view", "phase")


def block(name: Column, pedestrian: Column, vehicle: Column) -> Column:
    """A named candidate as text."""
    return F.concat(F.lit("["), name, F.lit("]\ncaption_pedestrian: "), text.blank(pedestrian), F.lit("\ncaption_vehicle: "), text.blank(vehicle))


def _pair(p: Column, v: Column) -> list[Column]:
    return [p.alias("caption_pedestrian"), v.alias("caption_vehicle")]


def spoilt(phases: DataFrame, first: int = 4, contradictions: bool = False, other: bool = False) -> DataFrame:
    """phases with ``source, label``: each with its caption and spoilt forms of it.

    contradictions adds one with an attribute swapped; other adds the first
    different caption of the same phase.
    """
    p, v = (text.blank(F.col(f"caption_{r}")) for r in ROLES)
    made = [
        ("shuffled", "bad", text.shuffled_sentences(p), text.shuffled_sentences(v)),
        ("front_trimmed", "bad", text.first_sentences(p, first), text.first_sentences(v, first)),
        ("context_trimmed", "bad", text.without_context(p), text.without_context(v)),
    ]
    if contradictions:
        wrong = text.contradicted({"p": p, "v": v})
        made.append(("contradicted", "bad", wrong["p"], wrong["v"]))
    made.append(("gold", "good", p, v))
    rows = phases
    keep = [c for c in phases.columns if not c.startswith("caption_")]
    if other:
        rows = first_other(rows.withColumn("_c", F.struct(*_pair(p, v))), ["phase"], "ord", "_c")
        made.append(("wrong_scenario_same_phase", "bad", F.col("other.caption_pedestrian"), F.col("other.caption_vehicle")))
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("source"), F.lit(label).alias("label"), *_pair(a, b)) for n, label, a, b in made))).alias("x")
    return rows.select(*keep, each).select(*keep, "x.*").where("caption_pedestrian is not null")


def _with_context(rows: DataFrame, facts: DataFrame) -> DataFrame:
    context = fact_context(facts, 16, 24)
    whole = context.where("phase is null").select("scenario_id", F.col("context").alias("_whole"))
    own = context.where("phase is not null").select("scenario_id", "phase", F.col("context").alias("_own"))
    joined = rows.join(whole, "scenario_id", "left").join(own, ["scenario_id", "phase"], "left")
    return joined.withColumn("context", F.array_join(F.filter(F.array("_whole", "_own"), lambda x: x.isNotNull()), "\n")).drop("_whole", "_own")


def _head(heading: str) -> Column:
    return F.concat(F.lit(f"{heading}\n\nScenario type: "), "scenario_type", F.lit("\nView: "), "view", F.lit("\nPhase label: "), "phase", F.lit("\n\n"), "context", F.lit("\n\n"))


def realizer_rows(candidates: DataFrame, facts: DataFrame, heading: str, targets: DataFrame | None = None) -> DataFrame:
    """A row a phase and view: all its candidates (``source`` and captions) and facts, to be made one caption.

    targets: phases with the captions to learn; without them the output is empty.
    """
    blocks = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("source", block(F.col("source"), F.col("caption_pedestrian"), F.col("caption_vehicle")).alias("b")))), lambda x: x.b), "\n\n")
    rows = _with_context(candidates.groupBy(*KEYS).agg(blocks.alias("blocks")), facts)
    prompt = F.concat(_head(heading), F.lit("Candidate captions:\n"), "blocks", F.lit("\n\nReturn JSON with exactly these keys: caption_pedestrian, caption_vehicle."))
    if targets is None:
        return rows.select(*KEYS, prompt.alias("instruction"), F.lit("").alias("output"))
    wanted = targets.select(*KEYS, F.to_json(F.struct("caption_pedestrian", "caption_vehicle")).alias("output"))
    return rows.join(wanted, list(KEYS)).select(*KEYS, prompt.alias("instruction"), "output")


def selector_rows(candidates: DataFrame, facts: DataFrame, heading: str) -> DataFrame:
    """A row a candidate: is it good or bad?  The output is its ``label``, empty if it has none."""
    rows = _with_context(candidates if "label" in candidates.columns else candidates.withColumn("label", F.lit("")), facts)
    prompt = F.concat(_head(heading), block(F.col("source"), F.col("caption_pedestrian"), F.col("caption_vehicle")), F.lit("\n\nDecision:"))
    return rows.select(*KEYS, "source", prompt.alias("instruction"), F.col("label").alias("output"))


def segment_rows(phases: DataFrame, heading: str, train: bool = True) -> DataFrame:
    """A row a role and segment: in training those that the caption has, with their text; else all of them."""
    rows = unpivoted(phases, *KEYS)
    if train:
        rows = rows.select(*KEYS, "role", F.explode(caption_segments(F.col("text"), F.col("role"))).alias("segment", "output"))
    else:
        rows = rows.select(*KEYS, "role", F.explode(F.array(*map(F.lit, SEGMENTS))).alias("segment"), F.lit("").alias("output"))
    prompt = F.concat(F.lit(f"{heading}\n\nPhase label: "), "phase", F.lit("\nTarget role: "), "role", F.lit("\nTarget segment: "), "segment", F.lit("\nReturn only the segment text."))
    return rows.select(*KEYS, "role", "segment", prompt.alias("instruction"), "output")


def assembled_segments(rows: DataFrame) -> DataFrame:
    """``scenario_id, phase, role, caption`` from predicted segments (``view, segment, text, ord``): the overhead view's first."""
    best = F.min_by("text", F.struct((F.col("view") != "overhead_view").alias("v"), "ord"))
    picked = rows.where(text.blank(F.col("text")) != "").groupBy("scenario_id", "phase", "role", "segment").agg(best.alias("text"))
    return picked.groupBy("scenario_id", "phase", "role").agg(F.map_from_entries(F.collect_list(F.struct("segment", "text"))).alias("m")).select("scenario_id", "phase", "role", caption_of(F.col("m")).alias("caption"))


def rewrite_rows(phases: DataFrame, facts: DataFrame, heading: str, train: bool = True) -> DataFrame:
    """A row a phase and view: its captions' segments as notes, facts as locks, the captions as output in training."""
    notes = {r: caption_of(caption_segments(F.col(f"caption_{r}"), r)) for r in ROLES}
    rows = _with_context(phases.where((text.blank(F.col("caption_pedestrian")) != "") | (text.blank(F.col("caption_vehicle")) != "")), facts)
    lock = F.when(F.col("context") != "", F.concat(F.lit("Locked fact context:\n"), "context", F.lit("\n\n"))).otherwise("")
    prompt = F.concat(F.lit(f"{heading}\n\n"), lock, F.lit("Pedestrian segment notes:\n"), notes["pedestrian"], F.lit("\n\nVehicle segment notes:\n"), notes["vehicle"])
    output = F.to_json(F.struct("caption_pedestrian", "caption_vehicle")) if train else F.lit("")
    return rows.select(*KEYS, prompt.alias("instruction"), output.alias("output"))


def complete(caption: Column, least_words: int = 20) -> Column:
    """A caption of enough words that ends with a mark."""
    clean = text.blank(caption)
    return (F.size(F.filter(F.split(clean, r"\s+"), lambda w: w != "")) >= least_words) & F.substring(clean, -1, 1).isin(".", "!", "?")


def realised(predictions: DataFrame, fallback: DataFrame, keys: tuple[str, ...] = ("scenario_id", "phase"), least_words: int = 20) -> DataFrame:
    """``keys``, captions and ``used``: predicted captions (``text``) where both are complete, else the fallback's."""
    p, v = text.caption_pair(F.col("text"))
    made = predictions.select(*keys, p.alias("_p"), v.alias("_v"))
    good = F.coalesce(complete(F.col("_p"), least_words) & complete(F.col("_v"), least_words), F.lit(False))
    joined = fallback.join(made, list(keys), "left")
    return joined.select(*keys, *(F.when(good, F.col(a)).otherwise(F.col(f"caption_{r}")).alias(f"caption_{r}") for a, r in zip(("_p", "_v"), ROLES)), good.alias("used"))
