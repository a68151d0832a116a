"""JSON sources that keep the order of their rows, and what is read from them."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.fixed import PREDICTION_KEYS
from tessella.functions.text import blank, letter, phase_number

OPTIONS = "a string, b string, c string, d string, e string"
QUESTION = f"struct<id: string, question: string, {', '.join(x.replace(' ', ': ') for x in OPTIONS.split(', '))}, correct: string>"
SCENARIO = "split string, scenario_id string, scenario_type string, videos map<string,array<string>>, caption_files map<string,string>, vqa_files map<string,string>, bbox_files map<string,map<string,array<string>>>"
CAPTIONS = "map<string,array<struct<labels: array<string>, caption_pedestrian: string, caption_vehicle: string, start_time: string, end_time: string>>>"


def documents(spark: SparkSession, path: str) -> DataFrame:
    """``path, text``: each file as one text."""
    return spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def json_rows(texts: DataFrame, schema: str) -> DataFrame:
    """``path, ord`` and the fields: the rows of JSON lists, or of single objects."""
    body = F.trim("text")
    as_list = F.when(F.substring(body, 1, 1) == "{", F.concat(F.lit("["), body, F.lit("]"))).otherwise(body)
    parsed = F.from_json(as_list, f"array<struct<{_fields(schema)}>>")
    return texts.select("path", F.posexplode(parsed).alias("ord", "row")).select("path", F.col("ord").cast("long").alias("ord"), "row.*")


def json_lines(texts: DataFrame, schema: str | None = None) -> DataFrame:
    """``path, ord`` and the fields (or ``line``): the lines of JSONL texts that aren't blank."""
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    rows = texts.select("path", F.posexplode(lines).alias("ord", "line")).withColumn("ord", F.col("ord").cast("long"))
    return rows if schema is None else rows.select("path", "ord", F.from_json("line", schema).alias("row")).select("path", "ord", "row.*")


def _fields(schema: str) -> str:
    """DDL of a table as DDL of a struct."""
    depth, parts, part = 0, [], ""
    for c in schema:
        depth += (c in "<(") - (c in ">)")
        if c == "," and not depth:
            parts.append(part)
            part = ""
        else:
            part += c
    return ", ".join(": ".join(p.strip().split(" ", 1)) for p in [*parts, part])


def scenarios(spark: SparkSession, path: str) -> DataFrame:
    """The scenario index."""
    return spark.read.schema(SCENARIO).json(path)


def option_map(row: str) -> Column:
    """The options of a question object: letters whose text isn't blank."""
    names = ["a", "b", "c", "d", "e"]
    return F.map_filter(F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*(blank(F.col(f"{row}.{n}")) for n in names))), lambda k, v: v != "")


def caption_phases(texts: DataFrame) -> DataFrame:
    """``path, phase_ord, label, caption_pedestrian, caption_vehicle, start_time, end_time`` of caption annotations."""
    kind = "event_phase array<struct<labels: array<string>, caption_pedestrian: string, caption_vehicle: string, start_time: string, end_time: string>>"
    rows = texts.select("path", F.posexplode(F.from_json("text", kind).event_phase).alias("phase_ord", "p"))
    return rows.select("path", "phase_ord", phase_number(F.get("p.labels", F.lit(0))).alias("label"), blank(F.col("p.caption_pedestrian")).alias("caption_pedestrian"), blank(F.col("p.caption_vehicle")).alias("caption_vehicle"), F.expr("try_cast(p.start_time as double)").alias("start_time"), F.expr("try_cast(p.end_time as double)").alias("end_time"))


def items(texts: DataFrame) -> DataFrame:
    """Question rows of question files: ``path, item_ord, phase_ord, q_ord, videos, raw_phase, phase, id, question, options, correct``.

    An item's questions stand in its phases, or on their own (environment or
    conversations): then phase and phase_ord are null.  Items without any give
    no row.
    """
    phases = f"array<struct<labels: array<string>, start_time: string, end_time: string, conversations: array<{QUESTION}>>>"
    table = json_rows(texts, f"videos array<string>, event_phase {phases}, conversations array<{QUESTION}>, environment array<{QUESTION}>").withColumnRenamed("ord", "item_ord")
    timed = table.select("path", "item_ord", "videos", F.posexplode("event_phase").alias("phase_ord", "p")).select("path", "item_ord", "videos", "phase_ord", F.get("p.labels", F.lit(0)).alias("raw_phase"), F.posexplode("p.conversations").alias("q_ord", "q"))
    alone = table.select("path", "item_ord", "videos", F.lit(None).cast("int").alias("phase_ord"), F.lit(None).cast("string").alias("raw_phase"), F.posexplode(F.concat(F.coalesce("environment", F.array()), F.coalesce("conversations", F.array()))).alias("q_ord", "q"))
    rows = timed.unionByName(alone)
    name = F.format_string("item_%05d_phase_%s_q_%03d", "item_ord", F.coalesce(F.col("phase_ord").cast("string"), F.lit("env")), "q_ord")
    id_ = F.when(blank(F.col("q.id")) == "", name).otherwise(blank(F.col("q.id")))
    phase = F.when(F.col("phase_ord").isNotNull(), phase_number(F.col("raw_phase")))
    return rows.select("path", "item_ord", "phase_ord", "q_ord", "videos", "raw_phase", phase.alias("phase"), id_.alias("id"), blank(F.col("q.question")).alias("question"), option_map("q").alias("options"), F.lower(blank(F.col("q.correct"))).alias("correct"))


def scenario_of(video: Column) -> Column:
    """The scenario of a video file name: the stem's first four parts if it has as many, else the stem."""
    stem = F.regexp_replace(F.element_at(F.split(video, "/"), -1), r"\.[^.]*$", "")
    parts = F.split(stem, "_")
    return F.when(F.size(parts) >= 4, F.array_join(F.slice(parts, 1, 4), "_")).otherwise(stem)


def prediction_text(line: Column, keys: Sequence[str] = PREDICTION_KEYS) -> Column:
    """The text of a prediction: a string itself, the first key that is there, the last message, else the JSON."""
    value = F.try_parse_json(line)
    found = F.lit(None).cast("string")
    for key in reversed(keys):
        item = F.try_variant_get(value, f"$.{key}", "string")
        found = F.when(item.isNotNull(), item).otherwise(found)
    last = F.element_at(F.from_json(F.get_json_object(line, "$.messages"), "array<struct<content: string>>"), -1)["content"]
    text = F.when(F.substring(F.trim(line), 1, 1) == '"', F.try_variant_get(value, "$", "string")).otherwise(found)
    return F.coalesce(text, last, line)


def predictions(texts: DataFrame, keys: Sequence[str] = PREDICTION_KEYS) -> DataFrame:
    """``path, ord, text`` of prediction files: JSONL, a JSON list, or an object with a list under "predictions"."""
    body = F.trim("text")
    listed = F.when(F.substring(body, 1, 1) == "[", body).otherwise(F.get_json_object(body, "$.predictions"))
    # a JSONL file isn't one JSON value, so it has no list
    items_ = F.from_json(listed, "array<variant>")
    whole = texts.where((F.substring(body, 1, 1) == "[") | listed.isNotNull()).select("path", F.posexplode(items_).alias("ord", "v")).select("path", F.col("ord").cast("long").alias("ord"), prediction_text(F.to_json("v"), keys).alias("text"))
    lines = json_lines(texts.where((F.substring(body, 1, 1) != "[") & listed.isNull())).select("path", "ord", prediction_text(F.col("line"), keys).alias("text"))
    return whole.unionByName(lines)


def answers(texts: DataFrame, strict: bool = True) -> DataFrame:
    """``id, letter`` of an answer file; the last of several answers to an id wins.

    strict: a row without an id is an error; else it is left out.
    """
    rows = json_rows(texts, "id string, correct string")
    id_ = blank(F.col("id"))
    kept = rows.withColumn("id", F.when(id_ == "", F.raise_error(F.lit("an answer has no id"))).otherwise(id_)) if strict else rows.withColumn("id", id_).where("id <> ''")
    return kept.groupBy("id").agg(F.max_by("correct", "ord").alias("correct"), F.min("ord").alias("ord")).select("id", "ord", letter(F.col("correct")).alias("letter"))


def captions(texts: DataFrame) -> DataFrame:
    """``scenario_id, row_idx, phase, caption_pedestrian, caption_vehicle`` of caption files; without a label the index is the phase."""
    rows = texts.select(F.explode(F.from_json("text", CAPTIONS)).alias("scenario_id", "rows")).select("scenario_id", F.posexplode("rows").alias("row_idx", "r"))
    phase = F.coalesce(F.get("r.labels", F.lit(0)), F.col("row_idx").cast("string"))
    return rows.select("scenario_id", "row_idx", phase.alias("phase"), blank(F.col("r.caption_pedestrian")).alias("caption_pedestrian"), blank(F.col("r.caption_vehicle")).alias("caption_vehicle"))


def score_rows(texts: DataFrame, strict: bool = True) -> DataFrame:
    """``id, scores map<string,double>, correct`` of score files (JSONL); a scored row replaces a failed one, two scored rows are an error."""
    rows = json_lines(texts, "vqa_id string, id string, scores map<string,double>, correct string")
    id_ = F.coalesce(F.when(blank(F.col("vqa_id")) != "", blank(F.col("vqa_id"))), blank(F.col("id")))
    held = rows.withColumn("id", id_).where("id <> ''").groupBy("id").agg(F.count("scores").alias("n"), F.max_by(F.struct("scores", "correct"), F.struct(F.col("scores").isNotNull(), -F.col("ord"))).alias("r"))
    scores = F.when(F.col("n") > 1, F.raise_error(F.concat(F.lit("two score rows for "), "id"))).otherwise(F.col("r.scores")) if strict else F.col("r.scores")
    return held.select("id", scores.alias("scores"), F.lower(blank(F.col("r.correct"))).alias("correct"))


def named(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Several sources as one table with their names as ``source``."""
    out = None
    for name, table in tables.items():
        table = table.withColumn("source", F.lit(name))
        out = table if out is None else out.unionByName(table)
    return out


def files(spark: SparkSession, root: str, suffix: str) -> DataFrame:
    """``path, length`` of the files below a folder with a suffix; their content isn't read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*{suffix}").load(root).select("path", "length")


def dataset_index(paths: DataFrame, root: str) -> DataFrame:
    """The scenario index of a folder tree, from its file paths.

    ``<root>/<kind>/<split>/[normal_trimmed/]<scenario>/<view>/<file>``; a
    scenario's first caption and question file by name counts for each view.
    """
    parts = F.split(F.regexp_replace("path", f"^.*?{root.rstrip('/')}/", ""), "/")
    normal = F.get(parts, F.lit(2)) == "normal_trimmed"
    shift = F.when(normal, 1).otherwise(0)
    rows = paths.select("path", F.get(parts, F.lit(0)).alias("kind"), F.get(parts, F.lit(1)).alias("split"), F.when(normal, "normal_trimmed").otherwise("main").alias("scenario_type"), F.get(parts, shift + 2).alias("scenario_id"), F.get(parts, shift + 3).alias("view"))
    rows = rows.where("scenario_id is not null and view is not null")
    of = rows.groupBy("split", "scenario_type", "scenario_id", "kind", "view").agg(F.array_sort(F.collect_list("path")).alias("files"))

    def by_view(kind: str, value: Column) -> Column:
        return F.map_from_entries(F.array_sort(F.filter(F.collect_list(F.when(F.col("kind") == kind, F.struct("view", value.alias("v")))), lambda x: x.isNotNull())))

    return of.groupBy("split", "scenario_type", "scenario_id").agg(by_view("videos", F.col("files")).alias("videos"), by_view("caption", F.col("files")[0]).alias("caption_files"), by_view("vqa", F.col("files")[0]).alias("vqa_files"))


def box_annotations(texts: DataFrame) -> DataFrame:
    """``path, track, ord, phase, image_id, x, y, w, h`` of bounding-box files, one track each; boxes of fewer than four numbers are left out."""
    kind = "annotations array<struct<image_id: bigint, bbox: array<double>, phase_number: string>>"
    rows = texts.select("path", F.posexplode(F.from_json("text", kind).annotations).alias("ord", "a")).where("size(a.bbox) >= 4")
    track = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    return rows.select("path", track.alias("track"), F.col("ord").cast("long").alias("ord"), phase_number(F.col("a.phase_number")).alias("phase"), F.coalesce("a.image_id", F.lit(0)).alias("image_id"), *(F.col("a.bbox")[i].alias(n) for i, n in enumerate("xywh")))


def box_summaries(annotations: DataFrame) -> DataFrame:
    """``path, phase, count, first_image, last_image, mean``: boxes of each file and phase in file order, the mean box to three decimals."""
    mean = F.array(*(F.round(F.avg(c), 3) for c in "xywh"))
    return annotations.groupBy("path", "phase").agg(F.count(F.lit(1)).cast("long").alias("count"), F.min_by("image_id", "ord").alias("first_image"), F.max_by("image_id", "ord").alias("last_image"), mean.alias("mean"))


def zip_members(spark: SparkSession, path: str, member: str) -> DataFrame:
    """``path, text``: a member of each zip archive; archives without it give no row.

    Archives of submissions are small, and each is read whole by one task.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for name, content in zip(batch["path"], batch["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    if member in archive.namelist():
                        found.append((name, archive.read(member).decode("utf-8")))
            yield pd.DataFrame(found, columns=["path", "text"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, text string")
