"""Queries over JSON documents that are derived from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.plans import sqltext as S
from tidemark.plans.transcript import query
from tidemark.sources import bridge, documents


def _projects(spark, d: str) -> DataFrame:
    """A project document for each customer, with fields left out by place; some are cut off, some names are unsafe."""
    c = spark.read.parquet(f"{d}/customer.parquet")
    k = F.col("c_custkey")
    doc = F.to_json(F.struct(
        F.when(k % 7 != 0, F.col("c_name")).alias("title"), F.when(k % 3 == 0, "youtube").when(k % 3 == 1, "disk").alias("source_type"), F.when(k % 4 == 0, "").when(k % 4 == 1, "analyzing").alias("status"),
        F.when(k % 5 != 0, F.concat(F.lit("2024-01-"), F.lpad((k % 28 + 1).cast("string"), 2, "0"))).alias("updated_at"), F.when(k % 6 != 0, F.lit("2023-12-31")).alias("created_at"),
        F.when(k % 2 == 0, F.transform(F.sequence(F.lit(1).cast("long"), k % 4 + 1), lambda i: F.struct((i * 10.5).alias("start"), (i * 10.5 + 20).alias("end")))).alias("clips"), F.when(k % 9 == 0, (k % 5).cast("int")).alias("transcript_revision"),
    ))
    return c.select(F.concat(F.lit("job"), F.when(k % 13 == 0, ".").otherwise("_"), k.cast("string")).alias("folder"), F.when(k % 11 == 0, F.left(doc, F.length(doc) - 3)).otherwise(doc).alias("doc"))


def _files(spark, d: str) -> DataFrame:
    o = spark.read.parquet(f"{d}/orders.parquet")
    k = F.col("o_orderkey")
    name = F.concat(F.when(k % 4 == 0, "preview_").when(k % 4 == 1, "short_").otherwise("full"), k.cast("string"), F.when(k % 5 == 0, ".srt").otherwise(".mp4"))
    return o.select(F.concat(F.lit("job_"), F.col("o_custkey").cast("string")).alias("job_id"), name.alias("name"), F.floor("o_totalprice").cast("long").alias("bytes"))


_CATALOGUE = """WITH p AS (SELECT c_custkey AS k, concat('job_', c_custkey) AS job_id, c_name FROM customer WHERE c_custkey % 13 <> 0 AND c_custkey % 11 <> 0),
q AS (SELECT k, job_id, CASE WHEN k % 7 <> 0 THEN c_name ELSE 'Untitled project' END AS title, CASE WHEN k % 3 = 0 THEN 'youtube' ELSE 'upload' END AS source_type, CASE WHEN k % 4 = 1 THEN 'analyzing' ELSE 'ready' END AS status, CASE WHEN k % 5 <> 0 THEN concat('2024-01-', lpad(CAST(k % 28 + 1 AS VARCHAR), 2, '0')) END AS u, CASE WHEN k % 6 <> 0 THEN '2023-12-31' END AS c, CASE WHEN k % 2 = 0 THEN k % 4 + 1 ELSE 0 END AS n, CASE WHEN k % 9 = 0 THEN k % 5 ELSE 0 END AS r FROM p),
f AS (SELECT concat('job_', o_custkey) AS job_id, o_orderkey AS o, CAST(floor(o_totalprice) AS BIGINT) AS b FROM orders), s AS (SELECT job_id, CAST(sum(b) AS BIGINT) AS bytes, count(*) FILTER (o % 4 <> 0 AND o % 5 <> 0) AS renders, count(*) FILTER (o % 4 = 1 AND o % 5 <> 0) AS shorts FROM f GROUP BY job_id),
cat AS (SELECT q.*, coalesce(c, u) AS created_at, coalesce(u, c) AS updated_at, coalesce(bytes, 0) AS bytes, coalesce(renders, 0) AS renders, coalesce(shorts, 0) AS shorts FROM q LEFT JOIN s USING (job_id))"""


@query(_CATALOGUE + " SELECT job_id, title, source_type, status, created_at, updated_at, CAST(n AS INTEGER) AS clip_count, CAST(r AS INTEGER) AS transcript_revision, bytes AS storage_bytes, renders AS render_count, shorts AS short_count FROM cat")
def src3_project_catalogue(spark, d):
    """Project documents with defaults, their renders and bytes (SRC-2, SRC-3, SRC-7, SRC-8, JN-15, SNK-10)."""
    x = documents.summaries(documents.projects(_projects(spark, d)), _files(spark, d))
    return x.select("job_id", "title", "source_type", "status", "created_at", "updated_at", "clip_count", "transcript_revision", "storage_bytes", "render_count", "short_count")


@query(_CATALOGUE + " SELECT source_type, status, count(*) AS projects, CAST(sum(bytes) AS BIGINT) AS storage_bytes, bool_and(renders > 0) AS all_rendered FROM cat GROUP BY source_type, status")
def agg12_storage(spark, d):
    """Projects and bytes by source and status, and whether all have renders (AGG-12, AGG-14, FLT-17's facets)."""
    x = documents.summaries(documents.projects(_projects(spark, d)), _files(spark, d))
    return x.groupBy("source_type", "status").agg(F.count("*").alias("projects"), F.sum("storage_bytes").alias("storage_bytes"), F.bool_and(F.col("render_count") > 0).alias("all_rendered"))


@query(S.BRIDGE + ", w AS (SELECT job_id, seg_ix, count(*) AS n, sum(pct) AS p FROM words GROUP BY ALL) SELECT s.job_id, s.seg_ix, start_cs, end_cs, text, n AS n_words, CAST(p AS BIGINT) AS pct FROM segments s JOIN w USING (job_id, seg_ix)")
def src1_transcript_json(spark, d):
    """Each job's segments written as one JSON document and read back in their order (SNK-1, SRC-1)."""
    segs = bridge.segments(spark, d)
    words = bridge.words(segs).groupBy("job_id", "seg_ix").agg(F.array_sort(F.collect_list(F.struct((F.col("start_cs") / 100).alias("start"), (F.col("end_cs") / 100).alias("end"), F.col("word").alias("text"), (F.col("pct") / 100).alias("probability")))).alias("words"))
    rows = segs.join(words, ["job_id", "seg_ix"]).withColumns({"start": F.col("start_cs") / 100, "end": F.col("end_cs") / 100})
    one = F.array_sort(F.collect_list(F.struct("seg_ix", documents.segment_json(rows).alias("j"))))
    docs = rows.groupBy("job_id").agg(F.concat(F.lit("["), F.array_join(F.transform(one, lambda x: x["j"]), ","), F.lit("]")).alias("doc"))
    back = documents.transcripts(docs, "doc")
    cs = lambda c: F.round(F.col(c) * 100).cast("long")
    total = F.aggregate("words", F.lit(0.0), lambda a, w: a + w["probability"])
    return back.select("job_id", "seg_ix", cs("start").alias("start_cs"), cs("end").alias("end_cs"), "text", F.size("words").cast("long").alias("n_words"), F.round(total * 100).cast("long").alias("pct"))
