"""Caption slots: sentences by what they tell, put in order, filled and phrased from facts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.fixed import (
    CLASH_COLOURS, REWRITE_ARTIFACTS, SLOT_ATTENTION, SLOT_BEHAVIOR, SLOT_CONTEXT, SLOT_LOCATION, SLOT_STRONG_BEHAVIOR, SLOTS, TEMPLATE_FACTS, UNSUPPORTING,
)
from tessella.functions.text import blank, holds_any, lower_first, repetitive, sentences_kept, squash, upper_first, word_count
from tessella.operators.captions import ROLES
from tessella.operators.facts import fact_table
from tessella.operators.grams import with_gram_f1

Fact = Callable[[str], Column]


def slot(sentence: Column, role: str) -> Column:
    """The slot of a sentence: context, attention (of pedestrians), location, behavior or other."""
    low = F.lower(sentence)
    attention = holds_any(low, SLOT_ATTENTION) if role == "pedestrian" else F.lit(False)
    place, strong = holds_any(low, SLOT_LOCATION), holds_any(low, SLOT_STRONG_BEHAVIOR)
    behaves = strong | holds_any(low, SLOT_BEHAVIOR)
    return F.when(holds_any(low, SLOT_CONTEXT), "context").when(attention, "attention").when(place & ~strong, "location").when(behaves, "behavior").when(place, "location").otherwise("other")


def distinct_sentences(sentences: Column) -> Column:
    """Sentences without those that say the same as one before, by letters and digits only."""
    keys = F.transform(sentences, lambda s: F.trim(F.regexp_replace(F.lower(s), r"\W+", " ")))
    return F.filter(sentences, lambda s, i: F.array_position(keys, F.trim(F.regexp_replace(F.lower(s), r"\W+", " "))) == i + 1)


def tidy(text: Column) -> Column:
    """Single blanks, none before marks, a final mark."""
    clean = F.regexp_replace(squash(text), r"\s+([.,;!?])", "$1")
    return F.when((clean != "") & ~F.substring(clean, -1, 1).isin(".", "!", "?"), F.concat(clean, F.lit("."))).otherwise(clean)


def in_slot_order(sentences: Column, role: str) -> Column:
    """Sentences by slot, those of a slot in their order."""
    return F.flatten(F.array(*(_of_slot(sentences, role, name) for name in SLOTS)))


def _of_slot(sentences: Column, role: str, name: str) -> Column:
    return F.filter(sentences, lambda s: slot(s, role) == name)


def slot_order_score(text: Column, role: str) -> Column:
    """1 less the share of sentence pairs that stand against the slot order; 0 for less than two sentences."""
    order = F.array(*map(F.lit, SLOTS))
    places = F.transform(sentences_kept(text), lambda s: F.array_position(order, slot(s, role)))
    n = F.size(places)

    def after(p: Column, i: Column) -> Column:
        return F.size(F.filter(places, lambda q, j: (j > i) & (q < p)))

    inversions = F.aggregate(F.transform(places, after), F.lit(0), lambda a, b: a + b)
    return F.when(n < 2, 0.0).otherwise(1.0 - inversions / (n * (n - 1) / 2))


# sentences from facts; an absent fact is empty


def _some(*parts: Column) -> Column:
    """An array of the parts that aren't empty."""
    return F.filter(F.array(*parts), lambda p: F.coalesce(p, F.lit("")) != "")


def _with(value: Column, phrase: Column) -> Column:
    """The phrase if there is a value, else empty."""
    return F.when(value != "", phrase).otherwise("")


def _sentence(before: str, parts: Column, between: str, after: str = ".") -> Column:
    return F.when(F.size(parts) > 0, F.concat(F.lit(before), F.array_join(parts, between), F.lit(after))).otherwise("")


def relative_position(value: Column, target: str) -> Column:
    low = lower_first(value)
    sided = F.contains(low, F.lit("side")) | F.contains(low, F.lit("left")) | F.contains(low, F.lit("right")) | F.contains(low, F.lit("behind"))
    return F.when(F.contains(low, F.lit(target)), low).when(F.contains(low, F.lit("front")), F.replace(low, F.lit("front"), F.lit(f"front of the {target}"))).when(sided, F.concat(low, F.lit(f" of the {target}"))).otherwise(low)


def identity_sentence(fact: Fact) -> Column:
    clothes = [F.array_join(_some(*(lower_first(fact(f"pedestrian.{part}_body_{x}")) for x in ("color", "type"))), " ") for part in ("upper", "lower")]
    worn = F.array_join(_some(*clothes), " and ")
    age, height = fact("pedestrian.age_group"), fact("pedestrian.height")
    parts = _some(_with(age, F.concat(F.lit("in his "), age)), _with(height, F.concat(F.lit("approximately "), height, F.lit(" tall"))), _with(worn, F.concat(F.lit("was wearing "), worn)))
    only_worn = (age == "") & (height == "") & (worn != "")
    return F.when(only_worn, F.concat(F.lit("The pedestrian was wearing "), worn, F.lit("."))).otherwise(_sentence("The pedestrian, ", parts, ", "))


def pedestrian_location(fact: Fact) -> Column:
    place, far, body = fact("pedestrian.position_relative_to_vehicle"), fact("pedestrian.distance_to_vehicle"), fact("pedestrian.body_orientation")
    low = F.lower(body)
    facing = F.when(F.contains(low, F.lit("opposite")), "facing the opposite direction from the vehicle").when(F.contains(low, F.lit("same direction")), "facing the same direction as the vehicle")
    facing = facing.when(F.contains(low, F.lit("perpendicular")), "perpendicular to the vehicle").otherwise(lower_first(body))
    return _sentence("The pedestrian ", _some(_with(place, F.concat(F.lit("was positioned "), relative_position(place, "vehicle"))), _with(far, F.concat(F.lit("at a "), lower_first(far), F.lit(" distance from the vehicle"))), _with(body, F.concat(F.lit("with his body "), facing))), ", ")


def pedestrian_attention(fact: Fact) -> Column:
    line, visual, aware = fact("pedestrian.line_of_sight"), fact("pedestrian.visual_status"), fact("pedestrian.awareness_of_vehicle")
    a, b, c = F.lower(line), F.lower(visual), F.lower(aware)
    sight = F.when(F.contains(a, F.lit("vehicle")), "The pedestrian's line of sight was fixed on the vehicle.").when(holds_any(a, ("direction of travel", "front")), "The pedestrian's line of sight was in front, aligned with the direction of travel.")
    sight = sight.otherwise(F.concat(F.lit("The pedestrian's line of sight was "), lower_first(line), F.lit(".")))
    looks = F.when(F.contains(b, F.lit("closely")), "The pedestrian was closely watching the surroundings.").when(F.contains(b, F.lit("slowly")) & F.contains(b, F.lit("looking")), "The pedestrian was slowly looking around.")
    looks = looks.when(F.contains(b, F.lit("constant")), "The pedestrian was constantly looking around intently.").otherwise(F.concat(F.lit("The pedestrian's visual status was "), lower_first(visual), F.lit(".")))
    knows = F.when(F.contains(c, F.lit("unaware")), "The pedestrian appeared unaware of the vehicle.").when(holds_any(c, ("notice", "aware")), "The pedestrian appeared to notice the vehicle and was aware of its presence.")
    knows = knows.otherwise(F.concat(F.lit("The pedestrian's awareness was "), lower_first(aware), F.lit(".")))
    return F.array_join(_some(_with(line, sight), _with(visual, looks), _with(aware, knows)), " ")


def pedestrian_behavior(fact: Fact) -> Column:
    action, fine, way, speed = (fact(f"pedestrian.{x}") for x in ("action", "fine_grained_action", "direction_of_travel", "speed"))
    low = F.lower(action)
    does = F.when(holds_any(low, ("collision", "collid")), "the pedestrian was involved in a collision").when(F.contains(low, F.lit("standing still")), "the pedestrian was standing still").otherwise(F.concat(F.lit("the pedestrian was "), lower_first(action)))
    parts = _some(_with(action, does), _with(fine, F.concat(F.lit("with fine-grained behavior of "), lower_first(fine))), _with(way, F.concat(F.lit("traveling "), lower_first(way))), _with(speed, F.concat(F.lit("at a "), lower_first(speed), F.lit(" speed"))))
    return upper_first(_sentence("", parts, "; "))


def vehicle_location(fact: Fact) -> Column:
    place, far, view = (fact(f"vehicle.{x}") for x in ("position_relative_to_pedestrian", "distance_to_pedestrian", "field_of_view"))
    low = F.lower(view)
    seen = F.when(F.contains(low, F.lit("not visible")), "the pedestrian was not visible within the vehicle's field of view").when(F.contains(low, F.lit("visible")), "the pedestrian was visible within the vehicle's field of view").otherwise(lower_first(view))
    return _sentence("The vehicle was ", _some(_with(place, F.concat(F.lit("positioned "), relative_position(place, "pedestrian"))), _with(far, F.concat(F.lit("at a "), lower_first(far), F.lit(" distance from the pedestrian"))), _with(view, seen)), ", ")


def vehicle_behavior(fact: Fact) -> Column:
    action, speed = fact("vehicle.action"), fact("vehicle.speed")
    low = F.lower(action)
    does = F.when(holds_any(low, ("collided", "collision")), "the vehicle collided with the pedestrian").when(holds_any(low, ("emergency braking", "emergency brake")), "the vehicle avoided the pedestrian by emergency braking")
    does = does.when(F.startswith(low, F.lit("started")), F.concat(F.lit("the vehicle "), lower_first(action))).when(F.startswith(low, F.lit("going")) | F.startswith(low, F.lit("turn")), F.concat(F.lit("the vehicle was "), lower_first(action)))
    does = does.when(F.contains(low, F.lit("stopped")), "the vehicle was stopped").otherwise(F.concat(F.lit("the vehicle was "), lower_first(action)))
    return upper_first(_sentence("", _some(_with(action, does), _with(speed, F.concat(F.lit("with a speed of "), speed))), "; "))


def context_sentence(fact: Fact) -> Column:
    weather, light = fact("environment.weather"), fact("environment.brightness")
    surface, slope, material = (lower_first(fact(f"road.{x}")) for x in ("surface_condition", "inclination", "surface_type"))
    kind, lanes, traffic = lower_first(fact("road.road_type")), lower_first(fact("road.lane_count")), lower_first(fact("road.traffic_volume"))

    def known(value: Column) -> Column:
        return F.when(value == "", "unknown").otherwise(lower_first(value))

    sky = F.when((weather != "") | (light != ""), F.concat(F.lit("The weather was "), known(weather), F.lit(", and the brightness of the surroundings was "), known(light))).otherwise("")
    below = F.when((surface != "") | (slope != "") | (material != ""), F.concat(F.lit("The road surface conditions were "), F.trim(F.concat(surface, F.lit(" on a "), F.array_join(_some(slope, material), " "), F.lit(" road"))))).otherwise("")
    article = F.when(F.regexp_like(kind, F.lit("^(a|an|the) ")), kind).when(F.regexp_like(kind, F.lit("^[aeiou]")), F.concat(F.lit("an "), kind)).when(kind != "", F.concat(F.lit("a "), kind)).otherwise("")
    classed = F.when((kind != "") | (lanes != ""), F.concat(F.lit("The road was classified as "), F.array_join(_some(article, lanes), " with "))).otherwise("")
    volume = _with(traffic, F.concat(F.lit("The traffic volume was "), traffic))
    return _sentence("For the environment, ", _some(sky, below, classed, volume), ". ")


def fact_sentences(role: str, fact: Fact) -> list[Column]:
    """The sentences that facts give for a role, in slot order."""
    if role == "pedestrian":
        return [pedestrian_location(fact), pedestrian_attention(fact), pedestrian_behavior(fact), context_sentence(fact)]
    return [vehicle_location(fact), vehicle_behavior(fact), context_sentence(fact)]


def template(role: str, fact: Fact) -> Column:
    """A caption made of facts only; empty without facts."""
    first = [identity_sentence(fact)] if role == "pedestrian" else []
    return F.array_join(_some(*first, *fact_sentences(role, fact)), " ")


def supported(sentence: Column, text: Column) -> Column:
    """Whether a lower-case text holds most of a sentence's telling words: 60 %, two at least."""
    words = F.regexp_extract_all(F.lower(sentence), F.lit(r"\b[a-z0-9]+(?:/[a-z0-9]+)?\b"), F.lit(0))
    telling = F.filter(words, lambda w: (F.length(w) > 3) & ~w.isin(*UNSUPPORTING))
    found = F.size(F.filter(telling, lambda w: F.contains(text, w)))
    return (F.size(telling) > 0) & (found >= F.greatest(F.lit(2), F.floor(F.size(telling) * 0.6)))


def colours_clash(sentence: Column, text: Column) -> Column:
    """Whether both name colours and share none."""
    pattern = F.lit(rf"\b({'|'.join(CLASH_COLOURS)})\b")
    a, b = F.regexp_extract_all(F.lower(sentence), pattern, F.lit(1)), F.regexp_extract_all(text, pattern, F.lit(1))
    return (F.size(a) > 0) & (F.size(b) > 0) & ~F.arrays_overlap(a, b)


def with_fact_columns(captions: DataFrame, facts: DataFrame) -> tuple[DataFrame, Fact]:
    """captions joined with a column for each template fact, phase facts before scenario facts; and how to name them."""
    keys = list(TEMPLATE_FACTS)
    names = {k: "_f_" + k.replace(".", "__") for k in keys}
    whole = fact_table(facts.where("phase is null"), keys).drop("phase")
    own = fact_table(facts.where("phase is not null"), keys)
    rows = captions.join(whole.toDF("scenario_id", *(f"_g{i}" for i in range(len(keys)))), "scenario_id", "left").join(own.toDF("scenario_id", "phase", *(f"_p{i}" for i in range(len(keys)))), ["scenario_id", "phase"], "left")
    rows = rows.select(*(rows[c] for c in captions.columns), *(blank(F.coalesce(f"_p{i}", f"_g{i}")).alias(names[k]) for i, k in enumerate(keys)))
    return rows, lambda key: F.col(names[key])


def rewrite_slots(captions: DataFrame, facts: DataFrame, mode: str = "balanced", most_added: int = 2) -> DataFrame:
    """Captions rewritten by slots.

    reorder: sentences in slot order.  balanced: also up to ``most_added``
    sentences from facts, for slots without a sentence.  fill: the same
    sentences at the end, the order kept.  template: from facts only, the
    caption itself if there are none.
    """
    if mode not in ("reorder", "balanced", "fill", "template"):
        raise ValueError(f"mode {mode}")
    rows, fact = with_fact_columns(captions, facts)
    if mode == "template":
        made = {r: template(r, fact) for r in ROLES}
        return rows.withColumns({f"caption_{r}": tidy(F.when(made[r] != "", made[r]).otherwise(blank(F.col(f"caption_{r}")))) for r in ROLES}).select(*captions.columns)
    # steps of their own: what a step uses more than once would else be written out, planned and worked out as often
    text = {r: blank(F.col(f"caption_{r}")) for r in ROLES}
    rows = rows.withColumns({f"_all_{r}": sentences_kept(text[r]) for r in ROLES})
    if mode != "reorder":
        rows = rows.withColumns({f"_new_{r}": _some(*fact_sentences(r, fact)) for r in ROLES} | {f"_low_{r}": F.lower(text[r]) for r in ROLES} | {f"_taken_{r}": _slots_of(F.col(f"_all_{r}"), r) for r in ROLES})
        added = {r: F.slice(_addable(F.col(f"_new_{r}"), r, F.col(f"_taken_{r}"), F.col(f"_low_{r}")), 1, most_added) for r in ROLES}
        rows = rows.withColumns({f"_all_{r}": F.concat(f"_all_{r}", added[r]) for r in ROLES})
    if mode != "fill":
        rows = rows.withColumns({f"_all_{r}": in_slot_order(F.col(f"_all_{r}"), r) for r in ROLES})
    rows = rows.withColumns({f"_all_{r}": F.array_join(distinct_sentences(F.col(f"_all_{r}")), " ") for r in ROLES})
    return rows.withColumns({f"caption_{r}": tidy(F.col(f"_all_{r}")) for r in ROLES}).select(*captions.columns)


def _slots_of(sentences: Column, role: str) -> Column:
    return F.array_distinct(F.transform(sentences, lambda s: slot(s, role)))


def _addable(sentences: Column, role: str, taken: Column, low: Column) -> Column:
    return F.filter(sentences, lambda s: ~F.array_contains(taken, slot(s, role)) & ~supported(s, low) & ~colours_clash(s, low))


def slot_scores(candidates: DataFrame, base: DataFrame, facts: DataFrame, base_source: str, keep_order: bool = True) -> DataFrame:
    """candidates (``source, scenario_id, row_idx, phase`` and captions) with their ``score`` against the base's row.

    8 token F1 + 7 four-gram F1 + 1.8 slot order (unless the base's order is
    kept) + 1.2 share of facts told + length - artifacts - repetition - facts
    that the base does not tell, + 0.35 for the base itself.
    """
    both = F.concat_ws(" ", *(blank(F.col(f"caption_{r}")) for r in ROLES))
    keys = ["scenario_id", "row_idx"]
    rows = candidates.withColumns({"text": both, "full": (blank(F.col("caption_pedestrian")) != "") & (blank(F.col("caption_vehicle")) != "")})
    rows = rows.join(base.select(*keys, both.alias("base_text")), keys).withColumn("pair", F.concat_ws("|", "source", "scenario_id", "row_idx"))
    rows = with_gram_f1(rows, "text", "base_text", {"tokens": 1, "grams": 4})
    low, base_low = F.lower("text"), F.lower("base_text")
    of = facts.select("scenario_id", F.col("phase").alias("fact_phase"), F.lower(F.trim("value")).alias("value")).where("value <> ''")
    met = rows.select("pair", "scenario_id", "phase", low.alias("low"), base_low.alias("base_low")).join(of, "scenario_id").where(F.col("fact_phase").isNull() | (F.col("fact_phase") == F.col("phase")))
    told, known = F.contains("low", F.col("value")), F.contains("base_low", F.col("value"))
    sums = met.groupBy("pair").agg(F.count(F.lit(1)).alias("facts"), F.count_if(told).alias("told"), F.count_if(told & ~known & (F.length("value") >= 4)).alias("added"))
    rows = rows.join(sums, "pair", "left").na.fill(0, ["facts", "told", "added"])
    ratio = F.greatest(word_count(F.col("text")), F.lit(1)) / F.greatest(word_count(F.col("base_text")), F.lit(1))
    order = F.lit(0.0) if keep_order else 1.8 * (slot_order_score(F.col("caption_pedestrian"), "pedestrian") + slot_order_score(F.col("caption_vehicle"), "vehicle")) / 2
    score = (
        8.0 * F.col("tokens") + 7.0 * F.col("grams") + order
        + 1.2 * F.when(F.col("facts") > 0, F.least(F.lit(1.0), F.col("told") / F.least("facts", F.lit(12)))).otherwise(0.0)
        + F.greatest(F.lit(-4.0), 2.0 - F.abs(F.log(ratio)) * 8.0) + F.when(holds_any(F.lower("text"), REWRITE_ARTIFACTS), -8.0).otherwise(0.0)
        + F.when(repetitive(F.col("text")), -5.0).otherwise(0.0) + F.greatest(F.lit(-3.0), F.col("added") * -0.25) + F.when(F.col("source") == base_source, 0.35).otherwise(0.0)
    )
    return rows.withColumn("score", score).select(*candidates.columns, "score", F.col("tokens").alias("source_overlap"))


def rerank_slots(candidates: DataFrame, facts: DataFrame, base_source: str, margin: float = 1.0, least_overlap: float = 0.72, max_changes: int = 0, keep_order: bool = True) -> DataFrame:
    """``scenario_id, row_idx, source, margin``: rows where another source leads the base by ``margin``; the widest margins first, max_changes at most (0: all).

    A source whose words overlap the base's by less than ``least_overlap`` is out.
    """
    base = candidates.where(F.col("source") == base_source)
    rated = slot_scores(candidates, base, facts, base_source, keep_order)
    own = rated.where(F.col("source") == base_source).select("scenario_id", "row_idx", F.col("score").alias("own"))
    rated = rated.withColumn("score", F.col("score") - F.when((F.col("source") != base_source) & (F.col("source_overlap") < least_overlap), 100.0).otherwise(0.0))
    best = rated.groupBy("scenario_id", "row_idx").agg(F.max(F.struct("score", F.col("source").alias("source"))).alias("b"))
    out = best.join(own, ["scenario_id", "row_idx"]).select("scenario_id", "row_idx", "b.source", (F.col("b.score") - F.col("own")).alias("margin")).where((F.col("source") != base_source) & (F.col("margin") >= margin))
    return out.orderBy(F.desc("margin"), "scenario_id", "row_idx").limit(max_changes) if max_changes else out
