"""Captions: scoring against facts, fusion, gates, completeness, consistency, phrase banks."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.fixed import ARTIFACT_TERMS, ATTENTION_TERMS, COLOURS, CONTEXT_TERMS, GATE_POLICIES, PHASE_CUES, PHASE_TERMS, QUALITY_TERMS
from tessella.functions.text import blank, faults, hits, holds_any, joined_tokens, protected_items, repaired_ending, repetitive, squash, told, tokens, truncation_reason, up_to_ngrams, word_count
from tessella.operators.grams import Bank, bank_share, bucket_counts, gram_counts
from tessella.operators.metrics import grams_of, overlap
from tessella.operators.selection import best_over_fallback
from tessella.staging import Scratch

DECADE, SPEED = r"\b([1-9]0s)\b", r"\b([0-9]+)\s*km/h\b"
ROLES = ("pedestrian", "vehicle")


def by_phase(table: dict[str, Sequence[str]], phase: Column, text: Column) -> Column:
    """How many of a phase's terms a text holds."""
    found = F.when(F.lit(False), 0)
    for name, terms in table.items():
        found = found.when(phase == name, hits(text, terms))
    return found.otherwise(0)


def with_claims(rows: DataFrame) -> DataFrame:
    """rows (``low``) with what the lower-case text says of age, speed, gender and colour: looked up once a text, then met by many facts."""
    # a step of its own, so that it is worked out once for all that use it
    rows = rows.withColumn("_padded", F.concat(F.lit(" "), F.regexp_replace("low", "[^a-z0-9_]+", " "), F.lit(" ")))
    padded = F.col("_padded")
    said = {
        "_ages": F.regexp_extract_all("low", F.lit(DECADE), F.lit(1)),
        "_speeds": F.regexp_extract_all("low", F.lit(SPEED), F.lit(1)),
        "_colours": F.array_compact(F.array(*(F.when(F.contains(padded, F.lit(f" {c} ")), c) for c in COLOURS))),
        "_says_male": holds_any(padded, (" male ", " man ", " boy ")),
        "_says_female": holds_any(padded, (" female ", " woman ", " girl ")),
    }
    return rows.withColumns(said).drop("_padded")


def contradicts(key: Column, value: Column) -> Column:
    """Whether a text whose claims are columns speaks against a fact, by the kind that its key names."""

    def others(present: str, pattern: str) -> Column:
        expected = F.regexp_extract_all(value, F.lit(pattern), F.lit(1))
        return (F.size(present) > 0) & (F.size(expected) > 0) & (F.size(F.array_except(F.col(present), expected)) > 0)

    male, female = F.contains(value, F.lit("male")), F.contains(value, F.lit("female"))
    gender = F.when(female, F.col("_says_male")).when(male, F.col("_says_female")).otherwise(False)
    expected = F.array_compact(F.array(*(F.when(F.contains(value, F.lit(c)), c) for c in COLOURS)))
    colour = (F.size("_colours") > 0) & (F.size(expected) > 0) & ~F.arrays_overlap("_colours", expected)
    return (
        F.when(F.contains(key, F.lit("age_group")), others("_ages", DECADE))
        .when(F.contains(key, F.lit("speed")), others("_speeds", SPEED))
        .when(F.contains(key, F.lit("gender")) | value.isin("male", "female"), gender)
        .when(F.contains(key, F.lit("color")), colour)
        .otherwise(False)
    )


def judged(met: DataFrame) -> DataFrame:
    """met (``low`` and its claims, ``key, value``) with ``is_match, is_against, fact_score``."""
    value = F.regexp_replace(F.lower(squash(F.col("value"))), "grey", "gray")
    rows = met.withColumns({"_key": F.lower("key"), "_value": value})
    key, value = F.col("_key"), F.col("_value")
    known = ~value.isin("", "unknown", "none", "n/a")
    tight = F.endswith(value, F.lit(" km/h")) & F.contains(F.replace("low", F.lit(" "), F.lit("")), F.replace(value, F.lit(" "), F.lit("")))
    rows = rows.withColumns({"is_match": known & (F.contains("low", value) | tight), "is_against": known & contradicts(key, value)})
    extra = F.when(F.contains(key, F.lit("age_group")), 1.0).when(F.contains(key, F.lit("speed")), 0.8).when(F.contains(key, F.lit("gender")) | value.isin("male", "female"), 0.8)
    extra = extra.when(F.contains(key, F.lit("color")), 0.5).when(holds_any(key, ("position", "distance", "action", "awareness", "line_of_sight")), 0.8).otherwise(0.0)
    return rows.withColumn("fact_score", F.when(F.col("is_match"), extra + 0.7).otherwise(0.0) - F.when(F.col("is_against"), 2.5).otherwise(0.0))


def candidate_scores(captions: DataFrame, facts: DataFrame, target_words: int = 250, fallback: str | None = None) -> DataFrame:
    """captions with ``score`` and its parts.

    captions: ``source, scenario_id, phase, caption_pedestrian, caption_vehicle``.
    facts: ``scenario_id, phase, key, value``; a null phase is the whole
    scenario's.  Score: both captions there (3, else -20), words near the
    target, -4 for each artifact term, cues of the phase, facts, -4 for
    repetition, 0.05 for the fallback source.  Matches and contradictions count
    once in the facts' score and once more as parts of their own.
    """
    p, v = blank(F.col("caption_pedestrian")), blank(F.col("caption_vehicle"))
    rows = captions.withColumns({"text": F.trim(F.concat(p, F.lit(" "), v)), "_both": (p != "") & (v != "")}).withColumns({"low": F.lower("text"), "_words": word_count(F.col("text"))})
    keys = ["source", "scenario_id", "phase"]
    # a caption meets the facts of its scenario and phase only
    of = facts.select("scenario_id", F.col("phase").alias("fact_phase"), "key", "value")
    met = with_claims(rows.select(*keys, "low")).join(of, "scenario_id").where(F.col("fact_phase").isNull() | (F.col("fact_phase") == F.col("phase")))
    sums = judged(met).groupBy(*keys).agg(F.sum("fact_score").alias("fact_sum"), F.count_if("is_match").alias("matches"), F.count_if("is_against").alias("contradictions"))
    rows = rows.withColumns({
        "length": F.when(F.col("_words") <= 0, -10.0).otherwise(F.greatest(F.lit(-3.0), 4.0 - F.abs(F.col("_words") - target_words) / 18.0)),
        "artifacts": hits(F.col("low"), ARTIFACT_TERMS) * -4.0,
        "cues": F.least(F.lit(3.0), by_phase(PHASE_CUES, F.col("phase"), F.col("low")) * 0.6),
        "repetition": F.when(repetitive(F.col("text")), -4.0).otherwise(0.0),
    })
    rows = rows.join(sums, keys, "left").na.fill(0, ["fact_sum", "matches", "contradictions"])
    parts = F.least(F.lit(8.0), F.col("matches") * 0.6) - F.col("contradictions") * 3.0
    own = F.when(F.col("source") == fallback, 0.05).otherwise(0.0) if fallback else F.lit(0.0)
    total = F.when(F.col("_both"), 3.0).otherwise(-20.0) + F.col("length") + F.col("artifacts") + F.col("cues") + F.col("repetition") + F.col("fact_sum") + parts * 2 + own
    return rows.withColumn("score", total).drop("_both", "text", "low", "_words")


def fuse_captions(captions: DataFrame, facts: DataFrame, fallback: str, target_words: int = 250, margin: float = 2.0) -> DataFrame:
    """The best-scoring source's caption of each scenario and phase, if it leads the fallback by ``margin``."""
    return best_over_fallback(candidate_scores(captions, facts, target_words, fallback), ["scenario_id", "phase"], "score", "source", fallback, margin)


def unpivoted(captions: DataFrame, *keep: str) -> DataFrame:
    """``keep, role, text``: a row for each role's caption."""
    return captions.select(*keep, F.explode(F.array(*(F.struct(F.lit(r).alias("role"), F.coalesce(F.col(f"caption_{r}"), F.lit("")).alias("text")) for r in ROLES))).alias("x")).select(*keep, "x.role", "x.text")


def completeness(captions: DataFrame, *keys: str) -> DataFrame:
    """``keys, role, reason`` for captions that aren't complete."""
    return unpivoted(captions, *keys).select(*keys, "role", truncation_reason(F.col("text")).alias("reason")).where("reason <> ''")


def repair_completeness(captions: DataFrame, fallback: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Incomplete captions replaced by the fallback's of the same keys if that is complete, else closed."""
    other = fallback.select(*keys, *(F.col(f"caption_{r}").alias(f"_{r}") for r in ROLES))
    rows = captions.join(other, list(keys), "left")
    for r in ROLES:
        own, instead = F.col(f"caption_{r}"), F.col(f"_{r}")
        fixed = F.when(truncation_reason(own) == "", own).when(instead.isNotNull() & (truncation_reason(instead) == ""), instead).otherwise(repaired_ending(own))
        rows = rows.withColumn(f"caption_{r}", fixed)
    return rows.select(*captions.columns)


def quality(clean: Column, words: Column, flaws: Column) -> Column:
    """Length, sentences and checklist words; -5 for an open ending or a fragment."""
    stops = F.least(F.lit(8), F.length(clean) - F.length(F.replace(clean, F.lit("."), F.lit("")))) * 0.15
    return words * 0.015 + stops + hits(F.lower(clean), QUALITY_TERMS) * 0.3 - F.when(F.arrays_overlap(flaws, F.array(F.lit("bad_ending"), F.lit("fragment"))), 5.0).otherwise(0.0)


def gate(rows: DataFrame, policy: str) -> DataFrame:
    """rows (``baseline, candidate``) with ``accepted``, ``reasons`` and ``delta``.

    A candidate is turned down for each fault it has, for its length against
    the baseline, and for protected facts it lost; then for too little gain.
    Under "repair" the baseline must itself be cut off.
    """
    low, high, margin = GATE_POLICIES[policy]
    out = rows
    for side in ("candidate", "baseline"):
        # each is used more than once below, and so worked out once
        out = out.withColumn(f"_{side}", squash(F.col(side)))
        flaws = told((bad, name) for name, bad in faults(F.col(f"_{side}")).items())
        out = out.withColumns({f"_{side}_words": F.size(joined_tokens(F.col(f"_{side}"))), f"_{side}_flaws": flaws})
    ratio = F.col("_candidate_words") / F.greatest(F.lit(1), F.col("_baseline_words"))
    missing = F.size(F.array_except(protected_items(F.col("_baseline")), protected_items(F.col("_candidate")))) > 0
    more = told(((ratio < low, "too_short"), (ratio > high, "too_long"), (missing, "missing_protected")))
    delta = quality(*(F.col(f"_candidate{x}") for x in ("", "_words", "_flaws"))) - quality(*(F.col(f"_baseline{x}") for x in ("", "_words", "_flaws")))
    out = out.withColumns({"reasons": F.when(F.col("_candidate") == "", F.array(F.lit("empty"))).otherwise(F.concat("_candidate_flaws", more)), "delta": delta})
    whole = ~F.arrays_overlap("_baseline_flaws", F.array(F.lit("bad_ending"), F.lit("fragment"))) if policy == "repair" else F.lit(False)
    last = F.when(F.size("reasons") > 0, F.col("reasons")).when(whole, F.array(F.lit("baseline_not_truncated"))).when(F.col("delta") < margin, F.array(F.lit("quality_delta"))).otherwise(F.col("reasons"))
    out = out.withColumn("reasons", last).withColumn("accepted", F.size("reasons") == 0)
    return out.drop(*(f"_{side}{x}" for side in ("candidate", "baseline") for x in ("", "_words", "_flaws")))


def consistency_penalty(captions: DataFrame, facts: DataFrame) -> DataFrame:
    """captions with ``penalty``: -2.5 for a wrong age, -2.5 for a wrong gender, -1.5 for wrong weather or brightness, -1 for a wrong distance."""
    keys = ["scenario_id", "phase"]
    text = F.lower(F.concat_ws(" ", *(F.coalesce(F.col(f"caption_{r}"), F.lit("")) for r in ROLES)))
    of = facts.select("scenario_id", F.col("phase").alias("fact_phase"), F.lower("key").alias("key"), F.lower("value").alias("value"))
    met = captions.select(*keys).distinct().join(of, "scenario_id").where(F.col("fact_phase").isNull() | (F.col("fact_phase") == F.col("phase")))

    def of_key(*names: str) -> Column:
        # a few facts of one scenario and phase
        return F.array_join(F.collect_list(F.when(holds_any(F.col("key"), names), F.col("value"))), " ")

    known = met.groupBy(*keys).agg(of_key("age").alias("age"), of_key("gender").alias("gender"), of_key("weather", "brightness").alias("sky"), of_key("distance").alias("far"))
    rows = captions.withColumn("_low", text).join(known, keys, "left").na.fill("", ["age", "gender", "sky", "far"])
    low = F.col("_low")
    decades = F.lit(r"\b[1-9]0s\b")
    allowed, present = F.regexp_extract_all("age", decades, F.lit(0)), F.regexp_extract_all(low, decades, F.lit(0))
    age = (F.size(allowed) > 0) & (F.size(F.array_except(present, allowed)) > 0)
    sky = F.lit(False)
    for is_, said in (("clear", "cloudy"), ("cloudy", "clear"), ("bright", "dim"), ("dim", "bright")):
        sky = sky | (F.contains("sky", F.lit(is_)) & F.contains(low, F.lit(said)) & ~F.contains(low, F.lit(is_)))
    padded = F.concat(F.lit(" "), low, F.lit(" "))
    far = F.when(holds_any(F.col("far"), ("close", "near")), F.contains(padded, F.lit(" far "))).when(F.contains("far", F.lit("far")), holds_any(padded, (" close ", " near "))).otherwise(False)
    gender = F.when(F.contains("gender", F.lit("female")), F.regexp_like(low, F.lit(r"\b(male|man|boy)\b"))).when(F.contains("gender", F.lit("male")), F.regexp_like(low, F.lit(r"\b(female|woman|girl)\b"))).otherwise(False)
    penalty = sum((F.when(bad, -cost).otherwise(0.0) for bad, cost in ((gender, 2.5), (sky, 1.5), (far, 1.0))), F.when(age, -2.5).otherwise(0.0))
    return rows.select(*captions.columns, penalty.alias("penalty"))


def phase_penalty(text: Column, phase: Column) -> Column:
    """-0.6 if a lower-case text has no cue of its phase, and -1.5 for a collision told in the first two."""
    cues = F.when(phase.isin(*PHASE_CUES) & (by_phase(PHASE_CUES, phase, text) == 0), -0.6).otherwise(0.0)
    return cues + F.when(phase.isin("0", "1") & holds_any(text, ("collision occurred", "collided with")), -1.5).otherwise(0.0)


def label_score(text: Column) -> Column:
    """1 for "good" (unless "bad" opens the text), -1 for "bad", else 0."""
    low = F.lower(blank(text))
    bad = F.lit(r"\bbad\b")
    return F.when(F.regexp_like(low, F.lit(r"\bgood\b")) & ~F.regexp_like(F.substring(low, 1, 20), bad), 1.0).when(F.regexp_like(low, bad), -1.0).otherwise(0.0)


def selector_scores(candidates: DataFrame, labels: DataFrame, fallback: str, facts: DataFrame, least_overlap: float = 0.7) -> DataFrame:
    """candidates (``source, scenario_id, row_idx, phase`` and captions) with ``score``: a model's label, likeness to the fallback, facts and phase.

    labels: ``source, scenario_id, row_idx, text``.  Below ``least_overlap`` of
    the fallback's words 5 goes off; the fallback has 0.25 more.
    """
    keys = ["scenario_id", "row_idx"]
    text = F.concat_ws(" ", *(blank(F.col(f"caption_{r}")) for r in ROLES))
    rows = candidates.withColumns({"_text": text, "pair": F.concat_ws("|", "source", "scenario_id", "row_idx")})
    rows = rows.join(rows.where(F.col("source") == fallback).select(*keys, F.col("_text").alias("_base")), keys)
    pairs = rows.select("pair", F.col("_text").alias("candidate"), F.col("_base").alias("reference"))
    rows = rows.join(overlap_f1(pairs, 1).toDF("pair", "_o1"), "pair").join(overlap_f1(pairs, 4).toDF("pair", "_o4"), "pair")
    locked = consistency_penalty(rows, facts).join(labels.select("source", *keys, F.col("text").alias("_label")), ["source", *keys], "left")
    own = F.col("source") == fallback
    low_overlap = F.when(~own & (F.col("_o1") < least_overlap), -5.0).otherwise(0.0)
    score = label_score(F.coalesce("_label", F.lit(""))) + 0.3 * F.col("_o1") + 0.3 * F.col("_o4") + F.col("penalty") + phase_penalty(F.lower("_text"), F.col("phase")) + F.when(own, 0.25).otherwise(0.0) + low_overlap
    return locked.select(*candidates.columns, score.alias("score"), F.col("_o1").alias("source_overlap"))


def repair_consistency(captions: DataFrame, fallback: DataFrame, facts: DataFrame, limit: float = -2.0) -> DataFrame:
    """Captions whose penalty is ``limit`` or less replaced by the fallback's row of the same scenario and index."""
    rated = consistency_penalty(captions, facts)
    other = fallback.select("scenario_id", "row_idx", *(F.col(f"caption_{r}").alias(f"_{r}") for r in ROLES))
    rows = rated.join(other, ["scenario_id", "row_idx"], "left")
    bad = (F.col("penalty") <= limit) & F.col("_pedestrian").isNotNull()
    out = rows.withColumns({f"caption_{r}": F.when(bad, F.col(f"_{r}")).otherwise(F.col(f"caption_{r}")) for r in ROLES})
    return out.select(*captions.columns, "penalty", bad.alias("replaced"))


# phrase banks


def heaviest_grams(counts: DataFrame, totals: DataFrame, size: int) -> DataFrame:
    """``bank, gram, weight``: the ``size`` heaviest of each bank's grams, those of each share of them first.

    counts: ``bank, gram, count, df``; totals: ``bank, docs``.
    """
    idf = F.greatest(F.log((F.col("docs") + 1.0) / (F.col("df") + 0.5)), F.lit(0.05))
    weighed = counts.join(totals, "bank").select("bank", "gram", F.round(F.col("count") * idf, 6).alias("weight"))
    some = weighed.withColumn("_share", F.pmod(F.xxhash64("gram"), F.lit(64)))
    for keys in (["bank", "_share"], ["bank"]):
        some = some.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("weight"), "gram"))).where(F.col("_r") <= size)
    return some.drop("_r", "_share")


def phrase_bank(docs: DataFrame, max_n: int = 4, size: int = 6000) -> DataFrame:
    """``bank, gram, weight``: count times idf of the grams of each bank's texts, the ``size`` heaviest.

    docs: ``doc, bank, text``.  idf is log((N + 1) / (df + 0.5)), 0.05 at least.

    No table of all grams is made.  A bucket's number of grams bounds the weight
    of each gram in it.  The grams of the fullest buckets are counted exactly;
    the ``size``-th weight among them is one that the bank's ``size`` heaviest
    reach, so then the grams of all other buckets whose bound reaches it are
    counted too.  Those left out weigh less: the result is that of counting all.
    What comes to the driver is of bounded size a bank: bucket counts, masks and
    ``size`` weights.
    """
    each = docs.groupBy("bank", "doc").agg(F.count(F.lit(1)).alias("held"))
    told = each.where("bank is not null").groupBy("bank").agg(F.count("doc").alias("docs"), F.max("held").alias("held")).collect()
    totals = {str(r.bank): r.docs for r in told}
    rows = docs.where("bank is not null").select(F.col("bank").cast("string").alias("bank"), "doc", tokens(F.col("text")).alias("w"))
    again = each.where("bank is not null and held > 1").select(F.col("bank").cast("string").alias("_bank"), F.col("doc").alias("_doc"))
    key = F.lit(None).cast("string")
    if any(r.held > 1 for r in told):
        rows = rows.join(again, (F.col("bank") == F.col("_bank")) & F.col("doc").eqNullSafe(F.col("_doc")), "left")
        key = F.when(F.col("_bank").isNotNull(), F.coalesce(F.concat(F.lit("="), F.col("doc").cast("string")), F.lit("")))
    rows = rows.select("bank", key.alias("key"), "w")

    held = bucket_counts(rows, max_n)
    n = docs.sparkSession.createDataFrame(list(totals.items()), "bank string, docs long")

    def heaviest(wanted: dict[str, np.ndarray]) -> DataFrame:
        # one row a bank: safe to broadcast
        return heaviest_grams(gram_counts(rows, wanted, max_n), F.broadcast(n), size)

    # as many buckets as would do if each held one heavy gram, and as many again for those that hold light ones
    first = {name: (x > 0) & (x >= np.partition(x, -min(2 * size, len(x)))[-min(2 * size, len(x))]) for name, x in held.items()}
    scratch = Scratch(docs.sparkSession, "phrase-bank")
    found = scratch.cut(heaviest(first), "found")
    least = {r.bank: r.least for r in found.groupBy("bank").agg(F.min("weight").alias("least"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= size).collect()}
    rest = {}
    for name, x in held.items():
        # df is 1 at least; the margin is for rounding
        bound = x * max(math.log((totals[name] + 1.0) / 1.5), 0.05) + 1e-5
        rest[name] = (x > 0) & ~first[name] & (bound >= least.get(name, 0.0))
    rest = {name: x for name, x in rest.items() if x.any()}
    if not rest:
        return found
    both = found.unionByName(heaviest(rest))
    return both.withColumn("_r", F.row_number().over(Window.partitionBy("bank").orderBy(F.desc("weight"), "gram"))).where(F.col("_r") <= size).drop("_r")


def collected_bank(bank: DataFrame) -> Bank:
    """A phrase bank on the driver: a few thousand grams a bank, whatever the texts' number."""
    weights: dict[str, dict[str, float]] = {}
    for r in bank.select("bank", "gram", "weight").toLocalIterator():
        weights.setdefault(r.bank, {})[r.gram] = r.weight
    return Bank(weights)


def bank_overlap(texts: DataFrame, bank: DataFrame, max_n: int = 4) -> DataFrame:
    """``id, overlap``: mean weight of a text's grams in its bank, a gram counted three times at most.

    texts: ``id, bank, text``.  A text is looked up where it is; only ids of
    several rows, whose grams count together, are exchanged gram by gram.
    """
    again = texts.groupBy("id").agg(F.count(F.lit(1)).alias("held")).where("held > 1").select(F.col("id").alias("_id"))
    share = bank_share({1.0: F.col("bank").cast("string")}, tokens(F.col("text")), collected_bank(bank), max_n)
    alone, same = texts, F.col("id").eqNullSafe(F.col("_id"))
    several = not again.isEmpty()
    if several:
        alone = texts.join(again, same, "left_anti")
    found = alone.select("id", F.when(F.col("id").isNull(), 0.0).otherwise(share).alias("overlap"))
    return found.unionByName(_overlap_of_several(texts.join(again, same, "left_semi"), bank, max_n)) if several else found


def _overlap_of_several(texts: DataFrame, bank: DataFrame, max_n: int) -> DataFrame:
    """The same, for ids whose rows count together."""
    grams = grams_of(texts.select("id", "bank", tokens(F.col("text")).alias("w")), "w", max_n).groupBy("id", "bank", "gram").agg(F.least(F.count(F.lit(1)), F.lit(3)).alias("c"))
    sums = grams.join(bank, ["bank", "gram"], "left").groupBy("id").agg(F.sum(F.col("c") * F.coalesce("weight", F.lit(0.0))).alias("hit"), F.sum("c").alias("all"))
    return texts.select("id").distinct().join(sums.select("id", (F.col("hit") / F.greatest("all", F.lit(1))).alias("overlap")), "id", "left").na.fill(0.0, ["overlap"])


def overlap_f1(pairs: DataFrame, n: int = 1) -> DataFrame:
    """``pair, f1``: F1 of the n-grams of candidate and reference."""
    table = overlap(pairs, n).where(F.col("n") == n)
    p, r = F.col("shared") / F.greatest("left_total", F.lit(1)), F.col("shared") / F.greatest("right_total", F.lit(1))
    rated = table.select("pair", F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f1"))
    return pairs.select("pair").join(rated, "pair", "left").na.fill(0.0, ["f1"])


def wording_gain(candidate: Column, base: Column, phase: Column) -> tuple[Column, Column, Column]:
    """(context, attention, phase): terms that the candidate holds, the first two less those of the base."""
    c, b = F.lower(candidate), F.lower(base)
    return hits(c, CONTEXT_TERMS) - hits(b, CONTEXT_TERMS), hits(c, ATTENTION_TERMS) - hits(b, ATTENTION_TERMS), by_phase(PHASE_TERMS, phase, c)
