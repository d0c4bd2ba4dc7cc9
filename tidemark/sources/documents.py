"""Transcripts and projects as JSON documents: reading, writing, defaults, and the catalogue of projects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SEGMENT = "start double, end double, text string, words array<struct<start double, end double, text string, probability double>>"
PROJECT = "job_id string, title string, source_type string, status string, created_at string, updated_at string, processing_profile string, content_type string, resolved_content_type string, duration_preference string, clips array<struct<start double, end double>>, schema_version int, transcript_revision int"
#: What a project has where it tells nothing.
DEFAULTS = {"title": "Untitled project", "status": "ready", "processing_profile": "balanced", "content_type": "auto", "resolved_content_type": "other", "duration_preference": "auto"}
SCHEMA_VERSION = 24
SAFE_ID = r"^[A-Za-z0-9_-]+$"


def read_transcripts(spark: SparkSession, folder: str) -> DataFrame:
    """(job_id, seg_ix, start, end, text, words) of every folder/<job>/transcript.json, an array of segments each."""
    files = spark.read.option("wholetext", True).text(f"{folder}/*/transcript.json").select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2).alias("job_id"), "value")
    return transcripts(files, "value").where(F.col("job_id").rlike(SAFE_ID))


def transcripts(docs: DataFrame, json: str) -> DataFrame:
    """docs(job_id, json) as segments in their order; a document that can't be parsed has none."""
    rows = docs.select("job_id", F.posexplode(F.from_json(json, f"array<struct<{SEGMENT}>>")).alias("seg_ix", "s"))
    return rows.select("job_id", "seg_ix", "s.*")


def segment_json(rows: DataFrame) -> Column:
    """One JSON object a segment, for rows(start, end, text, words); a folder of such lines is a transcript too large for one document."""
    return F.to_json(F.struct("start", "end", "text", "words"))


def read_projects(spark: SparkSession, folder: str) -> DataFrame:
    """The projects of folder/<job>/project.json whose names are safe and whose documents can be read."""
    files = spark.read.option("wholetext", True).text(f"{folder}/*/project.json").select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2).alias("folder"), F.col("value").alias("doc"))
    return projects(files)


def projects(docs: DataFrame) -> DataFrame:
    """docs(folder, doc) as project rows with defaults set; unsafe names and broken documents are left out."""
    # parsed once with a column that tells broken documents, which a null field alone wouldn't
    parsed = docs.where(F.col("folder").rlike(SAFE_ID)).withColumn("p", F.from_json("doc", PROJECT + ", _broken string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"}))
    x = parsed.where("p is not null and p._broken is null").select("folder", "p.*").drop("_broken")
    full = lambda c: F.when(F.col(c) != "", F.col(c))
    return x.select(
        F.coalesce(full("job_id"), "folder").alias("job_id"), *[F.coalesce(full(c), F.lit(v)).alias(c) for c, v in DEFAULTS.items()], F.when(F.col("source_type") == "youtube", "youtube").otherwise("upload").alias("source_type"),
        F.coalesce(full("created_at"), full("updated_at")).alias("created_at"), F.coalesce(full("updated_at"), full("created_at")).alias("updated_at"),
        F.coalesce(F.size("clips"), F.lit(0)).alias("clip_count"), F.coalesce("transcript_revision", F.lit(0)).alias("transcript_revision"), F.lit(SCHEMA_VERSION).alias("schema_version"),
    )


def renders(files: DataFrame) -> DataFrame:
    """Finished renders of files(job_id, name, bytes): mp4 files but previews, with their kind."""
    x = files.where(F.lower("name").endswith(".mp4") & ~F.col("name").startswith("preview_"))
    return x.withColumn("kind", F.when(F.col("name").startswith("short_"), "short").otherwise("original"))


def summaries(found: DataFrame, files: DataFrame) -> DataFrame:
    """The catalogue: projects with the number of renders and the bytes of all their files."""
    sizes = files.groupBy("job_id").agg(F.sum("bytes").alias("storage_bytes"))
    made = renders(files).groupBy("job_id").agg(F.count("*").alias("render_count"), F.count_if(F.col("kind") == "short").alias("short_count"))
    x = found.join(sizes, "job_id", "left").join(made, "job_id", "left")
    return x.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("storage_bytes", "render_count", "short_count")})


#: What of a task a diagnostics bundle shows, and how many tasks.
TASK_FIELDS = ("task_id", "kind", "status", "stage", "progress", "job_id", "error", "created_at", "updated_at", "recoverable")
BUNDLE_TASKS = 100


def diagnostics(docs: DataFrame, tasks: DataFrame) -> DataFrame:
    """A row for each project document of docs(folder, doc), also for those that can't be read, and for each of the newest tasks.

    Only fixed columns are shown, so no texts, paths or keys leave; times are strings. A task column that isn't there is null.
    """
    x = docs.withColumn("p", F.from_json("doc", PROJECT + ", _broken string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"}))
    broken = F.col("p").isNull() | F.col("p._broken").isNotNull()
    told = lambda c: F.when(~broken, F.col(f"p.{c}"))
    projects = x.select(
        F.lit("project").alias("section"), F.coalesce(told("job_id"), "folder").alias("job_id"), told("title").alias("title"), told("source_type").alias("source_type"), told("status").alias("status"),
        F.when(~broken, F.coalesce(F.size("p.clips"), F.lit(0))).alias("clip_count"), told("updated_at").alias("updated_at"), broken.alias("read_error"),
    )
    shown = tasks.orderBy(F.desc("created_at"), F.desc("task_id")).limit(BUNDLE_TASKS).select(F.lit("task").alias("section"), *[(F.col(c).cast("string") if c in tasks.columns else F.lit(None).cast("string")).alias(c) for c in TASK_FIELDS])
    return projects.unionByName(shown, allowMissingColumns=True)


def write_bundle(rows: DataFrame, folder: str) -> None:
    """The bundle as lines of JSON, one folder a section."""
    rows.write.mode("overwrite").partitionBy("section").json(folder)
