"""Projects and renders: keys of cached renders, sidecars and packages, plans of framing, resumes, revisions, ranked replies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
#: Clips that a resumed project asks for where it has none, and at least.
RESUME_CLIPS, LEAST_CLIPS = 6, 3
PREFIXES = {True: "preview_v22m5", False: "short_v22m5"}
#: Counts of a framing plan; absent ones are 0.
PLAN_COUNTS = ("source_width", "source_height", "sample_count", "face_samples", "motion_samples", "multi_face_samples", "scene_cut_samples", "active_speaker_samples", "active_speaker_switches", "group_fallback_samples", "speaker_hold_samples", "saliency_samples", "subtitle_samples")
PLAN = "mode string, keyframes array<array<double>>, " + ", ".join(f"{c} int" for c in PLAN_COUNTS) + ", scene_cut_times array<double>, visual_profile string"


def render_key(preview: Column, offset_ms: Column, revision: Column, start: Column, end: Column, *choices: Column) -> Column:
    """The name of a render's file: all that it depends on, the transcript's revision and the range in milliseconds included."""
    ms = lambda c: F.rint(c * 1000).cast("long").cast("string")
    tag = F.concat(F.when(offset_ms >= 0, "p").otherwise("m"), F.abs(offset_ms).cast("string"))
    return F.concat(F.concat_ws("_", F.when(preview, PREFIXES[True]).otherwise(PREFIXES[False]), *choices, tag, F.concat(F.lit("tr"), revision.cast("string")), ms(start), ms(end)), F.lit(".mp4"))


def sidecar(app: str, version: str) -> Column:
    """The JSON that lies beside a render, for rows of a clip with its project; fields that are missing have their defaults, null ones stay."""
    c = F.col
    return F.to_json(F.struct(
        F.lit(1).alias("schema"), F.lit(app).alias("app"), F.lit(version).alias("app_version"), c("job_id").alias("project_id"), "project_title", "title", F.coalesce("description", F.lit("")).alias("description"), F.coalesce("hashtags", F.array().cast("array<string>")).alias("hashtags"),
        F.coalesce("social_caption", F.lit("")).alias("social_caption"), "start", "end", "score", "source_type", "render_filename", F.coalesce("transcript_revision", F.lit(0)).alias("transcript_revision"),
        F.coalesce("resolved_content_type", "content_type", F.lit("other")).alias("content_type"), F.coalesce("resolved_content_structure", "content_structure", F.lit("single-story")).alias("content_structure"), "subject_hint",
    ), {"ignoreNullFields": "false"})


def covers(clips: DataFrame, files: DataFrame, key: list[str]) -> DataFrame:
    """clips(key, render_filename, start, end) with cover: the render's own cover, else the newest that was made for its range.

    files(job_id, name, modified): pictures of the clips' folders. One partial aggregation.
    """
    stem = F.regexp_replace("render_filename", r"\.mp4$", "")
    at = F.concat(F.rint(F.col("start") * 1000).cast("long").cast("string"), F.lit("_"), F.rint(F.col("end") * 1000).cast("long").cast("string"))
    own = F.col("name") == F.concat(F.lit("cover_custom_"), stem, F.lit(".jpg"))
    made = F.col("name").startswith("cover") & F.col("name").endswith(F.concat(F.lit("_"), at, F.lit(".jpg")))
    found = clips.join(files, "job_id").where(own | made).groupBy(*key).agg(F.max_by("name", F.struct(own.alias("own"), F.col("modified"), F.col("name"))).alias("cover"))
    return clips.join(found, key, "left")


def plan_json() -> Column:
    """A framing plan as JSON, with times to a millisecond and centres to five digits."""
    frames = F.transform("keyframes", lambda p: F.array(F.round(p[0], 3), F.round(p[1], 5)))
    return F.to_json(F.struct("mode", frames.alias("keyframes"), *PLAN_COUNTS, "scene_cut_times", "visual_profile"))


def plan_of(json: Column) -> Column:
    """The plan of a JSON document, with defaults for what it leaves out; null where it can't be read."""
    p = F.from_json(json, PLAN)
    frames = F.coalesce(p["keyframes"], F.array().cast("array<array<double>>"))
    made = F.struct(F.coalesce(p["mode"], F.lit("center")).alias("mode"), frames.alias("keyframes"), *[F.coalesce(p[c], F.lit(0)).alias(c) for c in PLAN_COUNTS], F.coalesce(p["scene_cut_times"], F.array().cast("array<double>")).alias("scene_cut_times"), F.coalesce(p["visual_profile"], F.lit("standard")).alias("visual_profile"))
    return F.when(p.isNotNull(), made)


def resumed(projects: DataFrame, profile: str = "balanced") -> DataFrame:
    """What each project is analysed with when it is taken up again: as many clips as it has, three at least, and its own choices."""
    n = F.coalesce(F.nullif("clip_count", F.lit(0)), F.lit(RESUME_CLIPS))
    full = lambda c, other: F.coalesce(F.when(F.col(c) != "", F.col(c)), other)
    return projects.select("job_id", F.greatest(F.lit(LEAST_CLIPS), n).alias("max_clips"), full("processing_profile", F.lit(profile)).alias("profile"), F.when(F.col("source_type") == "youtube", "youtube").otherwise("upload").alias("source_type"), full("content_type", F.lit("auto")).alias("content_type"), full("duration_preference", F.lit("auto")).alias("duration_preference"))


def revised(projects: DataFrame, edits: DataFrame) -> DataFrame:
    """projects(job_id, transcript_revision) after edits(job_id, lo, hi): a revision more for each edit of a range that isn't empty."""
    n = edits.where("hi > lo").groupBy("job_id").agg(F.count("*").cast("int").alias("_n"))
    return projects.join(n, "job_id", "left").withColumns({"transcript_revision": F.coalesce("transcript_revision", F.lit(0)) + F.coalesce("_n", F.lit(0)), "transcript_edited": F.col("_n").isNotNull()}).drop("_n")


def replies(clips: DataFrame, most: int) -> DataFrame:
    """The best clips(job_id, place, score, ...) of each job's reply, in order of score, then of place."""
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("job_id").orderBy(F.desc("score"), "place"))
    return clips.withColumn("rank", rank).where(F.col("rank") <= most)
