"""Training and inference rows made from scenarios, phases, questions and clips."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.classify import question_type, vehicle_scope_loose, vehicle_scope_strict
from tessella.operators.prompts import answer_text, caption_prompt, media_for, parsed_options, prompt_variant, vqa_prompt
from tessella.sources.json import scenario_of

BOX_HEAD = "BBox context: coordinates are [x1, y1, x2, y2] normalized to a 0-1000 full-frame grid."


def clip_map(manifest: DataFrame) -> DataFrame:
    """``scenario_id, view, phase, clips``: a phase's clips in the order of the manifest (``ord``)."""
    return manifest.groupBy("scenario_id", "view", "phase").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "clip_path"))), lambda x: x.clip_path).alias("clips"))


def box_context(summaries: DataFrame, per_role: int = 4) -> DataFrame:
    """``scenario_id, view, phase, context``: a line a track, pedestrians first, ``per_role`` tracks of each role by name.

    summaries: track_summary rows with scenario_id and view.
    """
    ranked = summaries.withColumn("_r", F.dense_rank().over(Window.partitionBy("scenario_id", "view", "role").orderBy("track"))).where(F.col("_r") <= per_role)

    def shown(box: str) -> Column:
        return F.concat(F.lit("["), F.array_join(F.col(box).cast("array<string>"), ", "), F.lit("]"))

    line = F.concat(F.lit("- "), "role", F.lit(" "), "view", F.lit(" "), F.col("track").cast("string"), F.lit(": first="), shown("first"), F.lit(" mid="), shown("mid"), F.lit(" last="), shown("last"), F.lit(" mean="), shown("mean"), F.lit(" frames="), F.col("frames").cast("string"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("role", "_r", line.alias("line")))), lambda x: x.line)
    return ranked.groupBy("scenario_id", "view", "phase").agg(F.concat(F.lit(BOX_HEAD + "\n"), F.array_join(lines, "\n")).alias("context"))


def caption_rows(phases: DataFrame, clips: DataFrame, videos: DataFrame, policy: str = "all", context: DataFrame | None = None, keep_without_media: bool = False) -> DataFrame:
    """``instruction, input, output, videos, metadata``: a caption row a phase and view.

    phases: ``split, scenario_id, scenario_type, view, phase, caption_pedestrian,
    caption_vehicle``; clips: clip_map; videos: ``scenario_id, view, videos``.
    A phase's clips come before the whole videos, and the policy after both.
    """
    keys = ["scenario_id", "view"]
    rows = phases.join(clips, [*keys, "phase"], "left").join(videos, keys, "left")
    media = media_for(F.coalesce("clips", "videos", F.array().cast("array<string>")), policy)
    if context is not None:
        rows = rows.join(context, [*keys, "phase"], "left")
    told = F.coalesce("context", F.lit("")) if context is not None else F.lit("")
    rows = rows.withColumn("media", media)
    if not keep_without_media:
        rows = rows.where(F.size("media") > 0)
    output = F.to_json(F.struct(F.array("phase").alias("labels"), "caption_pedestrian", "caption_vehicle"))
    meta = F.create_map(*(x for name in ("split", "scenario_id", "scenario_type", "view", "phase") for x in (F.lit(name), F.col(name))))
    return rows.select(caption_prompt(F.col("view"), F.col("scenario_type"), F.col("phase"), F.size("media"), told).alias("instruction"), F.lit("").alias("input"), output.alias("output"), F.col("media").alias("videos"), F.map_concat(F.create_map(F.lit("task"), F.lit("caption")), meta).alias("metadata"))


def question_rows(questions: DataFrame, clips: DataFrame, videos: DataFrame, policy: str = "all", mode: str = "letter") -> DataFrame:
    """``id, instruction, input, output, videos, options, correct, metadata``: a row a question with an answer among its options.

    Environment questions are asked of overhead media, else of the vehicle's.
    """
    rows = questions.withColumn("view", F.when(F.col("scope") == "vehicle_view", "vehicle_view").otherwise("overhead_view"))
    other = videos.where(F.col("view") == "vehicle_view").select("scenario_id", F.col("videos").alias("_vehicle"))
    rows = rows.join(clips, ["scenario_id", "view", "phase"], "left").join(videos, ["scenario_id", "view"], "left").join(other, "scenario_id", "left")
    fallback = F.when(F.col("scope") == "environment", F.col("_vehicle"))
    rows = rows.withColumn("media", media_for(F.coalesce("clips", "videos", fallback, F.array().cast("array<string>")), policy)).where(F.map_contains_key("options", F.col("correct")))
    prompt = vqa_prompt(F.col("scope"), F.col("scenario_type"), F.col("phase"), F.col("question"), F.col("options"), F.size("media"))
    kind = question_type(F.col("question"), F.col("scope"))
    meta = F.map_filter(F.create_map(F.lit("task"), F.lit("vqa"), F.lit("vqa_id"), F.col("id"), F.lit("scenario_id"), F.col("scenario_id"), F.lit("scope"), F.col("scope"), F.lit("phase"), F.col("phase"), F.lit("question_type"), kind), lambda k, v: v.isNotNull())
    return rows.select("id", prompt.alias("instruction"), F.lit("").alias("input"), answer_text(F.col("correct"), F.col("options"), mode).alias("output"), F.col("media").alias("videos"), "options", "correct", meta.alias("metadata"))


def dataset_info(name: str, file_name: str, ranking: bool = False) -> dict:
    """The registry entry of an exported dataset."""
    columns = {"prompt": "instruction", "query": "input", **({"chosen": "chosen", "rejected": "rejected"} if ranking else {"response": "output"}), "videos": "videos"}
    return {name: {"file_name": file_name, **({"ranking": True} if ranking else {}), "columns": columns}}


def scoped_items(items: DataFrame, strict: bool = True) -> DataFrame:
    """Question rows of public files with ``scope`` and ``scenario_id``.

    A question outside a phase is of the environment.  An item's phase
    questions are seen from the vehicle if the wording of any of them shows it,
    by the strict or the loose rule.  The scenario is that of the item's first
    video, else the item's number.
    """
    rule = vehicle_scope_strict if strict else vehicle_scope_loose
    seen = items.groupBy("path", "item_ord").agg(F.bool_or(F.col("phase_ord").isNotNull() & rule(F.col("question"))).alias("_vehicle"))
    scope = F.when(F.col("phase_ord").isNull(), "environment").when(F.col("_vehicle"), "vehicle_view").otherwise("overhead_view")
    first = F.get("videos", F.lit(0))
    scenario = F.when(first.isNull(), F.format_string("item_%05d", "item_ord")).otherwise(scenario_of(first))
    return items.join(seen, ["path", "item_ord"]).withColumns({"scope": scope, "scenario_id": scenario}).drop("_vehicle")


def inference_rows(questions: DataFrame, policy: str = "all", placeholder: str = "a") -> DataFrame:
    """``id, instruction, input, output, videos, metadata`` to be answered by a model, from scoped_items.

    A "_normal_" video is of a normal clip.  The output is a placeholder.
    """
    kind = F.when(F.exists(F.coalesce("videos", F.array().cast("array<string>")), lambda v: F.contains(v, F.lit("_normal_"))), "normal_trimmed").otherwise("main")
    rows = questions.withColumns({"media": media_for(F.coalesce("videos", F.array().cast("array<string>")), policy), "scenario_type": kind})
    prompt = vqa_prompt(F.col("scope"), F.col("scenario_type"), F.col("phase"), F.col("question"), F.col("options"), F.size("media"))
    meta = F.create_map(*(x for name in ("id", "scenario_id", "scenario_type", "scope", "phase", "question") for x in (F.lit("vqa_id" if name == "id" else name), F.col(name))))
    return rows.select("id", prompt.alias("instruction"), F.lit("").alias("input"), F.lit(placeholder).alias("output"), F.col("media").alias("videos"), F.map_filter(meta, lambda k, v: v.isNotNull()).alias("metadata"))


def option_candidates(rows: DataFrame, variant: str = "base") -> DataFrame:
    """``id, instruction, options, videos`` for scoring each option, read out of prompts.

    An id that comes twice, a row without one, and a prompt with fewer than two options are errors.
    """
    id_ = F.trim(F.coalesce(F.element_at("metadata", "vqa_id"), F.lit("")))
    made = rows.select(id_.alias("id"), prompt_variant(F.col("instruction"), variant).alias("instruction"), "videos").withColumn("options", parsed_options(F.col("instruction")))
    counted = made.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("id")))
    fault = F.when(F.col("id") == "", "a row has no id").when(F.col("_n") > 1, F.concat(F.lit("two rows for "), "id")).when(F.size("options") < 2, F.concat(F.lit("fewer than two options for "), "id"))
    checked = F.when(fault.isNotNull(), F.raise_error(fault)).otherwise(F.col("id"))
    return counted.select(checked.alias("id"), "instruction", "options", "videos")
