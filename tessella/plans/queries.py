"""The query catalogue: each query applies operators to views of the base tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import boxes, text
from tessella.functions.classify import question_type, vehicle_scope_loose, vehicle_scope_strict
from tessella.functions.fixed import ROUTE_WEIGHTS, ROUTER_MODES, ROUTES
from tessella.functions.segments import caption_segments
from tessella.operators import captions as cap
from tessella.operators import exports, facts, joins, metrics, prompts, ranker, repair, scores, selection, slots, tracks, validate, votes
from tessella.plans import views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


# text functions


@query
def token_counts(spark, sf_dir):
    words = text.tokens(F.col("text"))
    return views.read(spark, sf_dir, "documents").select("doc_id", F.size(words).cast("long").alias("tokens"), F.size(F.array_distinct(words)).cast("long").alias("distinct_tokens"))


@query
def word_count_unicode(spark, sf_dir):
    return views.read(spark, sf_dir, "documents").select("doc_id", text.word_count(F.col("text")).alias("words"))


@query
def letter_parse(spark, sf_dir):
    return views.read(spark, sf_dir, "documents").select("doc_id", text.letter(F.col("text")).alias("letter"), text.letter_strict(F.col("text")).alias("strict"))


@query
def sentence_split(spark, sf_dir):
    parts = text.sentences_kept(F.col("text"))
    count = F.when(F.col("text").isNotNull(), F.size(parts).cast("long"))
    return views.read(spark, sf_dir, "documents").select("doc_id", count.alias("sentences"), F.get(parts, F.lit(0)).alias("first"), text.slug(F.get(parts, F.lit(0))).alias("slug"))


@query
def truncation_audit(spark, sf_dir):
    reason = text.truncation_reason(F.col("text"))
    return views.read(spark, sf_dir, "documents").groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).cast("long").alias("n"), F.min("doc_id").alias("first_doc"))


@query
def repetition_flag(spark, sf_dir):
    return views.read(spark, sf_dir, "documents").where(text.repetitive(F.col("text"))).select("doc_id")


@query
def json_salvage(spark, sf_dir):
    props = F.col("props")
    wrapped = F.when(F.expr("event_id % 4 = 0"), F.concat(F.lit("Answer: "), props, F.lit(" done"))).when(F.expr("event_id % 4 = 1"), F.substring(props, 2, 1000)).when(F.expr("event_id % 4 = 2"), F.lit("")).otherwise(props)
    found = text.json_object(wrapped)
    return views.read(spark, sf_dir, "events").select("event_id", found.isNotNull().alias("found"), F.coalesce(F.length(found), F.lit(0)).cast("long").alias("length"))


# questions


def _typed(spark, sf_dir):
    return views.questions(spark, sf_dir).withColumn("question_type", question_type(F.col("question"), F.col("scope")))


@query
def question_type_summary(spark, sf_dir):
    rows = _typed(spark, sf_dir).select("question_type", "scope")
    sets = rows.groupingSets([[], ["question_type"], ["scope"], ["question_type", "scope"]], "question_type", "scope")
    return sets.agg(F.count(F.lit(1)).cast("long").alias("n"), F.grouping_id().cast("long").alias("level"))


@query
def first_example_per_type(spark, sf_dir):
    return _typed(spark, sf_dir).groupBy("question_type").agg(F.min_by("question", "ord").alias("question"))


@query
def scope_inference(spark, sf_dir):
    rows = views.questions(spark, sf_dir).where("scope <> 'environment'")
    names = [F.when(F.bool_or(rule(F.col("question"))), "vehicle_view").otherwise("overhead_view").alias(name) for name, rule in (("loose", vehicle_scope_loose), ("strict", vehicle_scope_strict))]
    return rows.withColumn("item", F.expr("ord div 3")).groupBy("item").agg(*names)


@query
def prompt_build(spark, sf_dir):
    prompt = prompts.vqa_prompt(F.col("scope"), F.lit("main"), F.col("phase"), F.col("question"), F.col("options"), F.expr("ord % 3"))
    return views.questions(spark, sf_dir).select("id", F.md5(prompt.cast("binary")).alias("prompt_md5"), F.length(prompt).cast("long").alias("length"))


@query
def prompt_parse(spark, sf_dir):
    prompt = prompts.vqa_prompt(F.col("scope"), F.lit("main"), F.col("phase"), F.col("question"), F.col("options"), F.lit(1))
    rows = views.questions(spark, sf_dir).select("id", prompt.alias("p"))
    found = rows.select("id", prompts.parsed_question(F.col("p")).alias("question"), prompts.parsed_options(F.col("p")).alias("o"))
    return found.select("id", "question", F.size("o").cast("long").alias("options"), F.element_at("o", "b").alias("option_b"))


@query
def preference_pairs(spark, sf_dir):
    return prompts.preference_pairs(views.questions(spark, sf_dir))


@query
def option_shuffle(spark, sf_dir):
    rows = prompts.shuffled_options(views.questions(spark, sf_dir), 2, "7")
    return rows.select("id", F.col("copy").cast("long").alias("copy"), F.array_join(F.map_values("options"), "|").alias("texts"), "correct")


# votes


@query
def vote_plurality(spark, sf_dir):
    return votes.vote(views.votes(spark, sf_dir), views.fallback(spark, sf_dir))


def _weighted(spark, sf_dir):
    weight = F.when(F.lit(False), 0)
    for name in views.SOURCES:
        weight = weight.when(F.col("source") == name, ROUTE_WEIGHTS[name])
    return views.votes(spark, sf_dir).withColumn("weight", weight)


@query
def vote_weighted_fallback(spark, sf_dir):
    rows = _weighted(spark, sf_dir)
    ids = views.fallback(spark, sf_dir).join(rows.select("id").distinct(), "id", "left_semi")
    return votes.vote(rows, ids, F.col("weight"))


@query
def vote_missing_ids(spark, sf_dir):
    return votes.missing_votes(views.votes(spark, sf_dir), views.fallback(spark, sf_dir), views.SOURCES).groupBy("source").agg(F.count(F.lit(1)).cast("long").alias("missing"), F.min("id").alias("first_id"))


@query
def vote_routed(spark, sf_dir):
    best = views.fallback(spark, sf_dir).select("id", F.lit("best").alias("source"), "letter")
    return votes.routed_vote(views.votes(spark, sf_dir).unionByName(best), ROUTES, ROUTE_WEIGHTS, "best", _typed(spark, sf_dir).select("id", "question_type"))


@query
def vote_self_consistency(spark, sf_dir):
    return votes.self_consistency(views.votes(spark, sf_dir), views.fallback(spark, sf_dir), min_votes=3, min_margin=1)


@query
def disagreement_subset(spark, sf_dir):
    return votes.disagreements(views.votes(spark, sf_dir), views.fallback(spark, sf_dir), 3)


@query
def pairwise_disagreement(spark, sf_dir):
    return votes.pairwise_disagreement(views.votes(spark, sf_dir))


# repair


@query
def majority_repair(spark, sf_dir):
    return repair.consistent_answers(views.questions(spark, sf_dir), views.answers(spark, sf_dir).select("id", "letter"))


@query
def slot_text_repair(spark, sf_dir):
    return repair.consistent_texts(views.questions(spark, sf_dir), views.answers(spark, sf_dir).select("id", "letter"))


def _prior_parts(spark, sf_dir):
    rows = views.questions(spark, sf_dir)
    told = rows.where("ord % 2 = 0").withColumn("answer", F.when(F.expr("ord % 16 = 2"), F.element_at("options", F.col("correct"))).otherwise(F.element_at("options", F.lit("a"))))
    return told.select("ord", "question", "answer"), rows.where("ord % 2 = 1")


@query
def answer_priors_repair(spark, sf_dir):
    train, asked = _prior_parts(spark, sf_dir)
    decisions = repair.prior_decisions(train, asked, views.answers(spark, sf_dir).select("id", "letter"), 5, 0.5)
    return decisions.select("id", "question_type", "decision", "old", "new")


@query
def entropy_by_type(spark, sf_dir):
    return repair.entropy(_typed(spark, sf_dir), ["question_type"], "correct")


@query
def accuracy_by_group(spark, sf_dir):
    return metrics.accuracy(views.answers(spark, sf_dir), _typed(spark, sf_dir), ("question_type",))


@query
def calibrated_router(spark, sf_dir):
    mode = ROUTER_MODES["balanced"] | {"min_acc": 0.2, "margin": -0.05}
    asked, cast = _typed(spark, sf_dir), views.votes(spark, sf_dir)
    validation = asked.where("ord % 2 = 0").select("id", "question_type", "correct").join(cast, "id")
    choices = repair.chosen_models(validation, mode, views.SOURCES, ("env", "joint"))
    return repair.calibrated_answers(asked.where("ord % 2 = 1").select("id", "ord", "question_type"), cast, choices, mode, views.SOURCES, "joint")


@query
def submission_validate(spark, sf_dir):
    rows = views.read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").distinct()
    rows = rows.select(F.expr("l_orderkey * 1000000000 + l_linenumber * 100000000 + l_partkey * 1000 + l_suppkey").alias("ord"), F.when(F.expr("l_partkey % 97 = 0"), " ").otherwise(F.concat(F.lit("q"), "l_orderkey")).alias("id"), views.pick(F.col("l_suppkey"), "abcdx").alias("correct"))
    return validate.answer_errors(rows).groupBy("error").agg(F.count(F.lit(1)).cast("long").alias("n"), F.min("ord").alias("first_ord"))


# option scores


@query
def hard_negative(spark, sf_dir):
    return scores.hard_negatives(views.scores(spark, sf_dir), views.score_correct(spark, sf_dir).select("id", "correct"))


@query
def margin_summary(spark, sf_dir):
    rows = scores.hard_negatives(views.scores(spark, sf_dir), views.score_correct(spark, sf_dir).select("id", "correct"))
    out = scores.margin_summary(rows, by=("correct",))
    return out.select("correct", "n", *(F.round(c, 6).alias(c) for c in ("min", "median", "mean", "max")))


def _selected(spark, sf_dir):
    rows = scores.hard_negatives(views.scores(spark, sf_dir), views.score_correct(spark, sf_dir).select("id", "correct"))
    return scores.eligible(rows, "errors_and_margin", 0.1)


@query
def balanced_round_robin(spark, sf_dir):
    return selection.round_robin(_selected(spark, sf_dir), ["correct", "rejected"], [F.round("gold_margin", 6), "id"], 10, 60).select("id", "correct", "rejected", "turn")


@query
def letter_remap(spark, sf_dir):
    return selection.balanced_letters(_selected(spark, sf_dir), [F.round("gold_margin", 6), "id"], "abcd").select("id", "chosen", "refused")


@query
def score_normalize(spark, sf_dir):
    rows = scores.normalised(views.scores(spark, sf_dir).withColumn("source", F.lit("m")), "zscore")
    return rows.select("id", "letter", (F.round("score", 6) + 0.0).alias("score"))


@query
def option_score_ensemble(spark, sf_dir):
    both = views.scores(spark, sf_dir).withColumn("source", F.lit("m1")).unionByName(views.scores(spark, sf_dir, 4).withColumn("source", F.lit("m2")).where("cast(substring(id, 2) as long) % 3 <> 0"))
    return scores.combined(both, {"m1": 1.0, "m2": 0.5}, views.scores(spark, sf_dir).select("id", "letter"))


# selection


@query
def capped_greedy(spark, sf_dir):
    rows = views.read(spark, sf_dir, "part").select("p_partkey", "p_brand", F.substring("p_type", 1, 5).alias("kind"), "p_retailprice")
    return selection.nested_caps(rows, [F.desc("p_retailprice"), "p_partkey"], "p_brand", "kind", 40, {"Brand#11": 2, "Brand#22": 3}, {("Brand#33", "PROMO"): 1}).select("p_partkey", "p_brand", "kind")


@query
def topk_variants(spark, sf_dir):
    return selection.top_of_several(views.read(spark, sf_dir, "part").select("p_partkey", "p_retailprice"), [F.desc("p_retailprice"), "p_partkey"], (5, 10, 20)).select("p_partkey", "rank", F.col("k").cast("long").alias("k"))


# facts


@query
def fact_values(spark, sf_dir):
    return facts.fact_rows(views.questions(spark, sf_dir), views.answers(spark, sf_dir).select("id", "letter"))


@query
def fact_pivot(spark, sf_dir):
    return facts.fact_table(facts.fact_rows(views.questions(spark, sf_dir)), ["environment.weather", "pedestrian.age_group", "vehicle.speed"])


@query
def scene_graphs(spark, sf_dir):
    known = facts.fact_rows(views.questions(spark, sf_dir))
    again = facts.graph_facts(facts.scene_graph(known))
    return facts.scene_graph(again).select("scenario_id", "phase", "graph")


@query
def fact_context(spark, sf_dir):
    return facts.fact_context(facts.fact_rows(views.questions(spark, sf_dir)), 5, 4)


# captions


@query
def caption_completeness(spark, sf_dir):
    return cap.completeness(views.captions(spark, sf_dir), "source", "scenario_id", "phase")


@query
def caption_scores(spark, sf_dir):
    rows = cap.candidate_scores(views.captions(spark, sf_dir), views.caption_facts(spark, sf_dir), 40, "base")
    return rows.select("source", "scenario_id", "phase", F.round("score", 4).alias("score"), F.col("matches").cast("long").alias("matches"), F.col("contradictions").cast("long").alias("contradictions"))


@query
def caption_fusion(spark, sf_dir):
    rows = cap.fuse_captions(views.captions(spark, sf_dir), views.caption_facts(spark, sf_dir), "base", 40, 2.0)
    return rows.select("scenario_id", "phase", "source", "caption_pedestrian")


def _against_base(spark, sf_dir, name):
    rows = cap.unpivoted(views.captions(spark, sf_dir), "source", "scenario_id", "row_idx", "phase")
    keys = ["scenario_id", "row_idx", "phase", "role"]
    base = rows.where("source = 'base'").select(*keys, F.col("text").alias("baseline"))
    return rows.where(F.col("source") == name).select(*keys, F.col("text").alias("candidate")).join(base, keys)


@query
def fact_locked_gate(spark, sf_dir):
    rows = cap.gate(_against_base(spark, sf_dir, "fused"), "loose")
    return rows.select("scenario_id", "phase", "role", "accepted", F.array_join("reasons", ",").alias("reasons"))


@query
def protected_diff(spark, sf_dir):
    rows = _against_base(spark, sf_dir, "slots")
    lost = F.array_except(text.protected_items(F.col("baseline")), text.protected_items(F.col("candidate")))
    return rows.select("scenario_id", "phase", "role", F.array_join(F.sort_array(lost), ",").alias("lost"))


@query
def consistency_repair(spark, sf_dir):
    rows = views.captions(spark, sf_dir)
    done = cap.repair_consistency(rows.where("source = 'fused'"), rows.where("source = 'base'"), views.caption_facts(spark, sf_dir))
    return done.select("scenario_id", "phase", "penalty", "replaced", "caption_pedestrian")


@query
def completeness_repair(spark, sf_dir):
    rows = views.captions(spark, sf_dir)
    return cap.repair_completeness(rows.where("source = 'fused'"), rows.where("source = 'base'"), ["scenario_id", "row_idx"]).select("scenario_id", "phase", "caption_pedestrian", "caption_vehicle")


def _bank_docs(spark, sf_dir):
    return views.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.col("lang").alias("bank"), "text")


@query
def phrase_bank(spark, sf_dir):
    return cap.phrase_bank(_bank_docs(spark, sf_dir))


@query
def phrase_overlap(spark, sf_dir):
    docs = _bank_docs(spark, sf_dir)
    return cap.bank_overlap(docs.withColumnRenamed("doc", "id"), cap.phrase_bank(docs)).select("id", F.round("overlap", 4).alias("overlap"))


@query
def segment_extract(spark, sf_dir):
    rows = cap.unpivoted(views.captions(spark, sf_dir).where("source = 'base'"), "scenario_id", "phase")
    return rows.select("scenario_id", "phase", "role", F.explode(caption_segments(F.col("text"), F.col("role"))).alias("segment", "text"))


@query
def slot_rewrite(spark, sf_dir):
    rows = slots.rewrite_slots(views.captions(spark, sf_dir).where("source = 'base'"), views.caption_facts(spark, sf_dir), "balanced")
    return rows.select("scenario_id", "phase", "caption_pedestrian", "caption_vehicle")


@query
def slot_template(spark, sf_dir):
    known = facts.fact_rows(views.questions(spark, sf_dir))
    rows = known.where("phase is not null").select("scenario_id", "phase").distinct().select("scenario_id", "phase", F.lit("").alias("caption_pedestrian"), F.lit("").alias("caption_vehicle"))
    return slots.rewrite_slots(rows, known, "template")


@query
def slot_rerank(spark, sf_dir):
    rows = slots.rerank_slots(views.captions(spark, sf_dir), views.caption_facts(spark, sf_dir), "base", 0.2, 0.3)
    return rows.select("scenario_id", "row_idx", "source", F.round("margin", 4).alias("margin"))


@query
def phrase_rerank(spark, sf_dir):
    rows = views.captions(spark, sf_dir)
    bank = ranker.caption_bank(rows.where("source = 'slots'").select("scenario_id", "phase", "caption_pedestrian", "caption_vehicle"), 2, 200)
    return ranker.rerank_by_bank(rows, "base", bank, ("base", "fused", "slots"), least_overlap=0.3, max_changes=50).select("scenario_id", "row_idx", "source", F.round("margin", 4).alias("margin"))


@query
def learned_ranker(spark, sf_dir):
    rows = views.captions(spark, sf_dir)
    # fitted on every 25th scenario, applied to all
    fitted = rows.where("cast(substring(scenario_id, 2) as long) % 25 = 0")
    seen = ranker.features(rows, "base", ("base", "fused", "slots"))
    target = ranker.target_scores(fitted, fitted.where("source = 'slots'"))
    weights = ranker.train_ranker(ranker.features(fitted, "base", ("base", "fused", "slots")).join(target, ["source", "scenario_id", "row_idx"]))
    return ranker.apply_ranker(seen, weights, "base").select("scenario_id", "row_idx", "source", F.round("margin", 4).alias("margin"))


@query
def question_export(spark, sf_dir):
    asked = views.questions(spark, sf_dir).withColumn("scenario_type", F.lit("main"))
    clips = spark.createDataFrame([], "scenario_id string, view string, phase string, clips array<string>")
    videos = asked.select("scenario_id").distinct().select("scenario_id", F.lit("overhead_view").alias("view"), F.array(F.concat("scenario_id", F.lit("_1.mp4")), F.concat("scenario_id", F.lit("_2.mp4"))).alias("videos"))
    rows = exports.question_rows(asked, clips, videos, "first", "letter_text")
    return rows.select("id", "output", F.size("videos").cast("long").alias("videos"), F.element_at("metadata", "question_type").alias("question_type"))


# metrics


@query
def bleu(spark, sf_dir):
    return metrics.corpus_bleu(views.caption_pairs(spark, sf_dir)).select(F.round("bleu", 6).alias("bleu"))


@query
def meteor_like(spark, sf_dir):
    return metrics.meteor_like(views.caption_pairs(spark, sf_dir)).select("pair", F.round("meteor", 6).alias("meteor"))


@query
def cider_like(spark, sf_dir):
    return metrics.cider_like(views.neighbour_pairs(spark, sf_dir), near="near").select("pair", F.round("cider", 6).alias("cider"))


@query
def rouge_l(spark, sf_dir):
    return metrics.rouge_l(views.caption_pairs(spark, sf_dir)).select("pair", F.round("rouge", 6).alias("rouge"))


@query
def token_f1_pairs(spark, sf_dir):
    return cap.overlap_f1(views.caption_pairs(spark, sf_dir), 1).select("pair", F.round("f1", 6).alias("f1"))


@query
def fourgram_f1_pairs(spark, sf_dir):
    return cap.overlap_f1(views.caption_pairs(spark, sf_dir), 4).select("pair", F.round("f1", 6).alias("f1"))


# tracks


@query
def bbox_normalize(spark, sf_dir):
    box = boxes.grid_box(*(F.col(c) for c in "xywh"))
    return views.tracks(spark, sf_dir).select("ord", *(box[i].cast("long").alias(n) for i, n in enumerate(("x1", "y1", "x2", "y2"))))


@query
def track_summary(spark, sf_dir):
    rows = tracks.track_summary(views.tracks(spark, sf_dir))
    return rows.select("role", "track", "phase", "frames", *(F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in ("first", "mid", "last")))


@query
def crop_geometry(spark, sf_dir):
    rows = tracks.pixel_tracks(views.tracks(spark, sf_dir))
    side, left, top = boxes.crop_square(*(F.col(c) for c in ("x1", "y1", "x2", "y2")))
    return rows.select("role", "track", "phase", "frames", side.cast("long").alias("side"), left.cast("long").alias("left"), top.cast("long").alias("top"))


@query
def nearest_frame(spark, sf_dir):
    rows = views.tracks(spark, sf_dir)
    wanted = rows.select("role", "track", F.expr("ord * 3 % 4001").alias("frame")).distinct()
    return tracks.nearest_frame(rows, wanted, ["role", "track"]).select("role", "track", "frame", "image_id")


@query
def clip_manifest(spark, sf_dir):
    rows = views.tracks(spark, sf_dir).groupBy("track", "phase").agg(F.min("image_id").alias("a"), F.max("image_id").alias("b"))
    phases = rows.select(F.concat(F.lit("s"), "track").alias("scenario_id"), F.lit("overhead_view").alias("view"), "phase", (F.col("a") / F.lit(10.0)).alias("start_time"), (F.col("b") / F.lit(10.0)).alias("end_time"))
    videos = phases.select("scenario_id", "view").distinct().select(F.lit("train").alias("split"), "scenario_id", F.lit("main").alias("scenario_type"), "view", F.concat(F.lit("/videos/"), "scenario_id", F.lit("_cam1.mp4")).alias("video"))
    return tracks.clip_manifest(videos, phases, "/clips").select("scenario_id", "camera_id", "phase", "start_time", "duration", "clip_path")


# joins and resuming


@query
def zip_predictions(spark, sf_dir):
    docs = views.read(spark, sf_dir, "documents").select("doc_id").join(views.read(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")
    left = selection.numbered(docs, ["doc_id"]).select((F.col("place") - 1).alias("ord"), "doc_id")
    right = selection.numbered(views.read(spark, sf_dir, "labels"), ["doc_id"]).select((F.col("place") - 1).alias("ord"), "quality", "toxic")
    return joins.zipped(left, right).select("ord", "doc_id", F.col("quality").cast("long").alias("quality"))


@query
def key_or_place_join(spark, sf_dir):
    rows = views.captions(spark, sf_dir)
    other = rows.where("source = 'fused' and row_idx < 4").withColumn("phase", F.when(F.col("row_idx") % 2 == 0, F.col("phase")).otherwise(F.lit("x")))
    left = rows.where("source = 'base'").select("scenario_id", "row_idx", "phase")
    return joins.by_key_or_place(left, other, "scenario_id", "phase", "row_idx", ["caption_vehicle"]).select("scenario_id", F.col("row_idx").cast("long").alias("row_idx"), "other_caption_vehicle")


@query
def resume_antijoin(spark, sf_dir):
    return joins.unfinished(views.read(spark, sf_dir, "documents").select("doc_id", "lang"), views.read(spark, sf_dir, "labels"), "doc_id", F.col("quality") == 1)


# ids, options, rules, clips


@query
def stable_ids(spark, sf_dir):
    rows = views.questions(spark, sf_dir)
    fields = {"scenario_id": F.col("scenario_id"), "scope": F.col("scope"), "phase": F.col("phase"), "question": F.col("question"), "options": prompts.option_lines(F.col("options"))}
    media = F.concat(F.lit("/videos/"), "scenario_id", F.lit(".mp4"))
    return rows.select("id", text.stable_id(fields).alias("stable_id"), text.path_hash(media, 24).alias("media"))


@query
def options_rewrite(spark, sf_dir):
    rows = views.questions(spark, sf_dir)
    prompt = prompts.vqa_prompt(F.col("scope"), F.lit("main"), F.col("phase"), F.col("question"), F.col("options"), F.expr("ord % 3"))
    next_ = F.translate("correct", "abcd", "bcda")
    options = prompts.remapped(F.col("options"), F.col("correct"), next_, F.lit("b"), F.lit("d"))
    return rows.select("id", F.md5(prompts.replaced_options(prompt, options).cast("binary")).alias("prompt_md5"))


RULES = {"fallback": "env", "default": ["joint", "qwen35", "geometry?", "absent?"], "types": {"weather": ["env"], "pedestrian_action": {"inputs": ["ped_dynamic", "visual", "vehicle"], "fallback": "visual"}, "other": ["absent?"]}}


@query
def rule_fusion(spark, sf_dir):
    cast = views.votes(spark, sf_dir)
    known = _typed(spark, sf_dir).join(cast.where("source = 'env'").select("id"), "id", "left_semi")
    return votes.ruled_vote(cast, RULES, views.SOURCES, known.select("id", "question_type"))


@query
def first_disputed(spark, sf_dir):
    return votes.first_disputed(views.votes(spark, sf_dir), views.fallback(spark, sf_dir))


@query
def box_text_features(spark, sf_dir):
    rows = views.tracks(spark, sf_dir)
    line = F.format_string("- %s phase %s mean=[%d, %d, %d, %d]", "role", "phase", F.expr("cast(image_id % 700 as int)"), F.expr("cast(image_id % 500 as int)"), F.expr("cast(ord % 900 as int)"), F.expr("cast(ord % 800 as int)"))
    told = rows.groupBy("track").agg(F.array_join(F.collect_list(line), "\n").alias("t"))
    each = told.select("track", F.explode(F.array(*(F.struct(F.lit(r).alias("role"), text.box_means(F.col("t"), r).alias("m")) for r in ("pedestrian", "vehicle")))).alias("x")).where("x.m is not null")
    return each.select("track", "x.role", *(F.round(F.col(f"x.m.{c}"), 4).alias(c) for c in ("cx", "cy", "area")))


@query
def clip_errors(spark, sf_dir):
    events = views.read(spark, sf_dir, "events")
    path = F.format_string("/clips/%d.mp4", "event_id")
    probes = events.where("event_id % 11 <> 0").select(path.alias("clip_path"), F.expr("event_id % 5").alias("size"), F.expr("nullif(event_id % 7, 3) - 1.0").alias("duration"), F.expr("event_id % 3").alias("frames"))
    return tracks.clip_errors(events.select(F.col("event_id").alias("ord"), path.alias("clip_path")), probes)
