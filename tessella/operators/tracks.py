"""Bounding-box tracks: summaries, nearest frames, clip tables, media commands."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.boxes import degenerate, grid_box, half_even, pixel_box


def track_summary(annotations: DataFrame, keys: Sequence[str] = ("role", "track", "phase")) -> DataFrame:
    """First, middle, last and mean box on the 0-1000 grid, and the number of boxes, of each track and phase.

    annotations: keys, ``image_id, ord, x, y, w, h``, ordered by image_id, then
    ord.  The middle is the box at index count // 2.
    """
    boxes = annotations.select(*keys, "image_id", "ord", grid_box(F.col("x"), F.col("y"), F.col("w"), F.col("h")).alias("box"))
    order = Window.partitionBy(*keys).orderBy("image_id", "ord")
    ranked = boxes.withColumns({"i": F.row_number().over(order) - 1, "n": F.count(F.lit(1)).over(Window.partitionBy(*keys))})

    def at(place: Column) -> Column:
        return F.max(F.when(F.col("i") == place, F.col("box")))

    means = F.array(*(half_even(F.avg(F.col("box")[k])).cast("int") for k in range(4)))
    return ranked.groupBy(*keys).agg(
        F.max("n").cast("long").alias("frames"), at(F.lit(0)).alias("first"), at(F.floor(F.col("n") / 2)).alias("mid"), at(F.col("n") - 1).alias("last"), means.alias("mean")
    )


def pixel_tracks(annotations: DataFrame, keys: Sequence[str] = ("role", "track", "phase")) -> DataFrame:
    """Union box in pixels and number of boxes of each track and phase; degenerate boxes are left out."""
    boxes = annotations.select(*keys, pixel_box(F.col("x"), F.col("y"), F.col("w"), F.col("h")).alias("box")).where(~degenerate(F.col("box")))
    return boxes.groupBy(*keys).agg(F.count(F.lit(1)).cast("long").alias("frames"), *(f(F.col("box")[k]).alias(name) for f, k, name in ((F.min, 0, "x1"), (F.min, 1, "y1"), (F.max, 2, "x2"), (F.max, 3, "y2"))))


def nearest_frame(frames: DataFrame, wanted: DataFrame, keys: Sequence[str], bucket: int = 256) -> DataFrame:
    """wanted (keys, ``frame``) with the ``image_id`` nearest to it in frames; of equals the first by ``ord``.

    An as-of join in both directions by one ordered pass over buckets of
    frames, so that no pairs of frames are made and a long track is many tasks.
    """
    spot = F.floor(F.col("frame") / bucket)
    marks = frames.select(*keys, F.col("image_id").alias("frame"), "ord").groupBy(*keys, "frame").agg(F.min("ord").alias("ord")).withColumn("spot", spot)
    ends = marks.groupBy(*keys, "spot").agg(F.min(F.struct("frame", "ord")).alias("lo"), F.max(F.struct("frame", "ord")).alias("hi"))
    asks = wanted.select(*keys, "frame").distinct().withColumn("spot", spot)
    spots = ends.unionByName(asks.select(*keys, "spot").distinct(), allowMissingColumns=True).groupBy(*keys, "spot").agg(F.max("lo").alias("lo"), F.max("hi").alias("hi"))
    order = Window.partitionBy(*keys).orderBy("spot")
    around = spots.select(
        *keys, "spot", F.last("hi", True).over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("before"), F.first("lo", True).over(order.rowsBetween(1, Window.unboundedFollowing)).alias("after")
    )
    both = marks.withColumn("mark", F.struct("frame", "ord")).unionByName(asks.withColumn("ask", F.lit(True)), allowMissingColumns=True)
    inside = Window.partitionBy(*keys, "spot").orderBy("frame", F.col("ask").asc_nulls_first())
    found = both.withColumns({"left": F.last("mark", True).over(inside.rowsBetween(Window.unboundedPreceding, 0)), "right": F.first("mark", True).over(inside.rowsBetween(0, Window.unboundedFollowing))}).where("ask")
    found = found.join(around, [*keys, "spot"], "left").select(*keys, "frame", F.coalesce("left", "before").alias("left"), F.coalesce("right", "after").alias("right"))
    far = [F.struct(F.abs(F.col(c).frame - F.col("frame")).alias("far"), F.col(c).ord.alias("ord"), F.col(c).frame.alias("image_id")) for c in ("left", "right")]
    best = F.least(*(F.when(F.col(c).isNotNull(), s) for c, s in zip(("left", "right"), far)))
    return wanted.join(found.select(*keys, "frame", best.image_id.alias("image_id")), [*keys, "frame"], "left")


def clip_manifest(scenarios: DataFrame, phases: DataFrame, root: str) -> DataFrame:
    """A row for each video and phase of a scenario and view: times, duration (0.001 at least), clip path.

    scenarios: ``split, scenario_id, scenario_type, view, video``; phases:
    ``scenario_id, view, phase, start_time, end_time``.
    """
    camera = F.regexp_replace(F.element_at(F.split("video", "/"), -1), r"\.[^.]*$", "")
    rows = scenarios.withColumn("camera_id", camera).join(phases, ["scenario_id", "view"])
    path = F.concat_ws("/", F.lit(root), "split", "scenario_type", "scenario_id", "view", F.concat_ws("_", "camera_id", F.lit("phase"), "phase"))
    return rows.select("split", "scenario_id", "scenario_type", "view", "camera_id", "phase", "start_time", "end_time", F.greatest(F.col("end_time") - F.col("start_time"), F.lit(0.001)).alias("duration"), F.col("video").alias("source_video"), F.concat(path, F.lit(".mp4")).alias("clip_path"))


def clip_commands(manifest: DataFrame, ffmpeg: str = "ffmpeg") -> DataFrame:
    """The manifest with ``command array<string>``, which cuts the clip; nothing is run here."""
    seconds = [F.format_number(c, "0.000") for c in ("start_time", "duration")]
    return manifest.withColumn("command", F.array(F.lit(ffmpeg), F.lit("-ss"), seconds[0], F.lit("-i"), F.col("source_video"), F.lit("-t"), seconds[1], F.lit("-c"), F.lit("copy"), F.col("clip_path")))


def capped_clips(clips: DataFrame, keys: Sequence[str], cap: int) -> DataFrame:
    """The first ``cap`` clips of each key by ``ord, variant_ord``; 0 takes all."""
    if not cap:
        return clips
    order = Window.partitionBy(*keys).orderBy("ord", "variant_ord")
    return clips.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= cap).drop("_r")


def same_camera(stem: Column, camera: Column) -> Column:
    """Whether a box file belongs to a camera: equal names, or one ends in the other."""
    bare = F.regexp_replace(stem, "_bbox$", "")
    return (bare == camera) | F.endswith(bare, camera) | F.endswith(camera, bare)


#: Box colours of the first, middle and last frame.
OVERLAY = {"pedestrian": ("yellow@0.95", "orange@0.95", "red@0.95"), "vehicle": ("cyan@0.95", "dodgerblue@0.95", "lime@0.95")}


def _draw(box: Column, colour: Column, width: int) -> Column:
    return F.format_string(f"drawbox=x=%d:y=%d:w=%d:h=%d:color=%s:t={width}", box[0], box[1], box[2] - box[0], box[3] - box[1], colour)


def overlay_filters(annotations: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys, overlay``: the video filter that draws each track's first, middle and last box and its union.

    annotations: keys, ``role, track, image_id, ord, x, y, w, h``.  Tracks stand
    pedestrians first, then by name; degenerate boxes are left out.
    """
    of = [*keys, "role", "track"]
    boxes = annotations.select(*of, "image_id", "ord", pixel_box(F.col("x"), F.col("y"), F.col("w"), F.col("h")).alias("box")).where(~degenerate(F.col("box")))
    ranked = boxes.withColumns({"i": F.row_number().over(Window.partitionBy(*of).orderBy("image_id", "ord")) - 1, "n": F.count(F.lit(1)).over(Window.partitionBy(*of))})
    marks = [F.max(F.when(F.col("i") == place, F.col("box"))).alias(name) for name, place in (("first", F.lit(0)), ("mid", F.floor(F.col("n") / 2)), ("last", F.col("n") - 1))]
    union = F.array(F.min(F.col("box")[0]), F.min(F.col("box")[1]), F.max(F.col("box")[2]), F.max(F.col("box")[3])).alias("union")
    rows = ranked.groupBy(*of).agg(*marks, union)
    colour = [F.when(F.col("role") == "pedestrian", OVERLAY["pedestrian"][i]).when(F.col("role") == "vehicle", OVERLAY["vehicle"][i]).otherwise("white@0.95") for i in range(3)]
    line = F.concat_ws(",", *(_draw(F.col(name), colour[i], 3 + i) for i, name in enumerate(("first", "mid", "last"))), _draw(F.col("union"), F.lit("white@0.35"), 2))
    return rows.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("role", "track", line.alias("line")))), lambda x: x.line), ",").alias("overlay"))


def crop_filter(side: Column, left: Column, top: Column, size: int = 768) -> Column:
    """The video filter that cuts a square and scales it."""
    return F.format_string(f"crop=%d:%d:%d:%d,scale={size}:{size}:force_original_aspect_ratio=decrease,pad={size}:{size}:(ow-iw)/2:(oh-ih)/2", side, side, left, top)


def clip_errors(manifest: DataFrame, probes: DataFrame, max_errors: int = 0) -> DataFrame:
    """``ord, clip_path, error`` of the clips that can't be used, in the manifest's order; max_errors 0 is no limit.

    manifest: ``ord, clip_path``; probes: ``clip_path, size, duration, frames``,
    one row a file that is there, with null duration or frames where probing it
    failed.
    """
    probed = manifest.select("ord", "clip_path").join(probes.withColumn("_there", F.lit(True)), "clip_path", "left")
    error = (
        F.when(F.col("_there").isNull(), "missing").when(F.col("size") == 0, "zero_bytes").when(F.col("duration").isNull() | F.col("frames").isNull(), "ffprobe_failed")
        .when(F.col("duration") <= 0, "non_positive_duration").when(F.col("frames") <= 0, "zero_decodable_frames")
    )
    out = probed.select("ord", "clip_path", error.alias("error")).where("error is not null")
    return out.orderBy("ord").limit(max_errors) if max_errors else out


def good_clips(manifest: DataFrame, errors: DataFrame) -> DataFrame:
    """The manifest without clips that a check reported."""
    return manifest.join(errors.select("clip_path"), "clip_path", "left_anti")


def frame_time(duration: Column, at: str) -> Column:
    """The second of a clip to take a frame from: start, one_sec (half of a shorter clip), middle, or a number."""
    if at == "start":
        return F.lit(0.0)
    if at == "middle":
        return F.greatest(F.lit(0.0), duration / 2)
    if at == "one_sec":
        return F.when(duration > 1.0, 1.0).otherwise(F.greatest(F.lit(0.0), duration / 2))
    return F.lit(max(0.0, float(at)))
