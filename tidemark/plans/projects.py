"""Queries over projects, renders and framing plans that are derived from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import projects, ranking, tracks
from tidemark.plans import sqltext as S
from tidemark.plans.analytics import _samples
from tidemark.plans.documents import _projects
from tidemark.plans.transcript import _score_sql, clips, query
from tidemark.sources import bridge, documents

_PICK = lambda of, k: f"{S.listed(of)}[CAST({k} % {len(of)} + 1 AS INTEGER)]"
_pick = lambda of, k: F.element_at(F.array(*map(F.lit, of)), (k % len(of) + 1).cast("int"))
_LAYOUTS, _STYLES, _PLATFORMS = ("fill", "focus", "backdrop", "preserve"), ("viral", "cinematic", "clean"), ("tiktok", "shorts", "reels", "auto", "generic")


@query(S.CLIPS + f""" SELECT job_id, clip_ix, CASE WHEN clip_ix % 2 = 0 THEN 'preview_v22m5' ELSE 'short_v22m5' END || '_' || {_PICK(_PLATFORMS, 'job_id')} || '_' || {_PICK(_LAYOUTS, 'clip_ix')} || '_balanced_' || {_PICK(_STYLES, '(job_id + clip_ix)')} || '_auto_' || CASE WHEN (job_id - 50) % 7 * 40 >= 0 THEN 'p' ELSE 'm' END || abs((job_id - 50) % 7 * 40) || '_tr' || (job_id % 4) || '_' || lo * 10 || '_' || hi * 10 || '.mp4' AS render_key FROM clips""")
def mut7_render_keys(spark, d):
    """The file name under which each clip's render is cached (MUT-7)."""
    c = clips(bridge.segments(spark, d))
    j, i = F.col("job_id"), F.col("clip_ix")
    key = projects.render_key(i % 2 == 0, (j - 50) % 7 * 40, j % 4, F.col("lo") / 100, F.col("hi") / 100, _pick(_PLATFORMS, j), _pick(_LAYOUTS, i), F.lit("balanced"), _pick(_STYLES, j + i), F.lit("auto"))
    return c.select("job_id", "clip_ix", key.alias("render_key"))


@query("""WITH p AS (SELECT c_custkey AS k, c_name FROM customer), o AS (SELECT o_orderkey AS ok, o_custkey AS k, (o_orderkey % 9) * 1000 AS s, (o_orderkey % 9) * 1000 + 30000 AS e FROM orders WHERE o_orderkey % 8 = 1),
f AS (SELECT o_custkey AS k, CASE WHEN o_orderkey % 5 = 0 THEN 'cover_custom_short_' || (o_orderkey - o_orderkey % 8 + 1) || '.jpg' ELSE 'cover' || o_orderkey || '_' || (o_orderkey % 9) * 1000 || '_' || ((o_orderkey % 9) * 1000 + 30000) || '.jpg' END AS name, o_orderdate AS m FROM orders),
c AS (SELECT ok, arg_max(name, {'a': name = 'cover_custom_short_' || ok || '.jpg', 'm': m, 'n': name}) AS cover FROM o JOIN f USING (k) WHERE name = 'cover_custom_short_' || ok || '.jpg' OR (starts_with(name, 'cover') AND ends_with(name, '_' || s || '_' || e || '.jpg')) GROUP BY ok)
SELECT ok AS order_key, cover, '{"schema":1,"app":"Clips","app_version":"1","project_id":' || k || ',"project_title":"' || c_name || '","title":' || CASE WHEN ok % 3 = 0 THEN 'null' ELSE '"Clip ' || ok || '"' END || ',"description":"' || CASE WHEN ok % 2 = 0 THEN 'about' ELSE '' END || '","hashtags":' || CASE WHEN ok % 4 = 1 THEN '["#a","#b' || ok % 10 || '"]' ELSE '[]' END || ',"social_caption":"","start":' || s // 1000 || '.0,"end":' || e // 1000 || '.0,"score":' || ok % 99 || ',"source_type":"upload","render_filename":"short_' || ok || '.mp4","transcript_revision":' || CASE WHEN ok % 7 = 0 THEN 0 ELSE ok % 7 END || ',"content_type":"' || CASE ok % 3 WHEN 0 THEN 'anime' WHEN 1 THEN 'podcast' ELSE 'other' END || '","content_structure":"single-story","subject_hint":null}' AS metadata FROM o JOIN p USING (k) LEFT JOIN c USING (ok)""")
def snk6_sidecars(spark, d):
    """The metadata document beside each render, and the cover that goes into its package (SNK-6)."""
    read = lambda t: spark.read.parquet(f"{d}/{t}.parquet")
    k = F.col("o_orderkey")
    orders = read("orders")
    start = (k % 9).cast("double")
    nothing = F.lit(None).cast("string")
    c = orders.where(k % 8 == 1).join(read("customer"), F.col("o_custkey") == F.col("c_custkey")).select(
        k.alias("order_key"), F.col("o_custkey").alias("job_id"), F.col("c_name").alias("project_title"), F.when(k % 3 != 0, F.concat(F.lit("Clip "), k.cast("string"))).alias("title"), F.when(k % 2 == 0, "about").alias("description"), F.when(k % 4 == 1, F.array(F.lit("#a"), F.concat(F.lit("#b"), (k % 10).cast("string")))).alias("hashtags"),
        nothing.alias("social_caption"), start.alias("start"), (start + 30).alias("end"), (k % 99).alias("score"), F.lit("upload").alias("source_type"), F.concat(F.lit("short_"), k.cast("string"), F.lit(".mp4")).alias("render_filename"), F.when(k % 7 != 0, (k % 7).cast("int")).alias("transcript_revision"),
        F.when(k % 3 == 0, "anime").alias("resolved_content_type"), F.when(k % 3 == 1, "podcast").alias("content_type"), nothing.alias("resolved_content_structure"), nothing.alias("content_structure"), nothing.alias("subject_hint"),
    )
    ms = lambda more: ((k % 9) * 1000 + more).cast("string")
    name = F.when(k % 5 == 0, F.concat(F.lit("cover_custom_short_"), (k - k % 8 + 1).cast("string"), F.lit(".jpg"))).otherwise(F.concat(F.lit("cover"), k.cast("string"), F.lit("_"), ms(0), F.lit("_"), ms(30000), F.lit(".jpg")))
    files = orders.select(F.col("o_custkey").alias("job_id"), name.alias("name"), F.col("o_orderdate").alias("modified"))
    return projects.covers(c, files, ["job_id", "order_key"]).select("order_key", "cover", projects.sidecar("Clips", "1").alias("metadata"))


_PLANS = "WITH e AS (SELECT *, user_id * 100000 + date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS track_id FROM events), k AS (SELECT track_id, event_type, value, row_number() OVER (PARTITION BY track_id ORDER BY ts, event_id) AS k FROM e), samples AS (SELECT *, 0.1::DOUBLE + CAST(floor(abs(value) * 100) AS BIGINT) % 800 / 1000.0::DOUBLE AS c FROM k)"


@query(_PLANS + " SELECT track_id, CASE WHEN track_id % 5 = 0 THEN 'center' WHEN count(*) FILTER (event_type = 'click') > 0 THEN 'face' ELSE 'motion' END AS mode, CAST(count(*) AS INTEGER) AS n_keyframes, CAST(sum(CAST(round(c * 1000) AS BIGINT)) AS BIGINT) AS centers, CASE WHEN track_id % 3 = 0 THEN 0 ELSE CAST(count(*) AS INTEGER) END AS sample_count, 0 AS source_width, CASE WHEN track_id % 2 = 0 THEN 'visual' ELSE 'standard' END AS visual_profile FROM samples GROUP BY track_id")
def snk8_plans(spark, d):
    """Framing plans written as JSON and read back; what a document leaves out has its default (SNK-8)."""
    t = F.col("track_id")
    x = _samples(spark, d).groupBy("track_id").agg(F.sort_array(F.collect_list(F.array("t", "c"))).alias("keyframes"), F.count("*").cast("int").alias("n"), F.count_if(F.col("event_type") == "click").alias("faces"))
    x = x.withColumns({"mode": F.when(t % 5 != 0, F.when(F.col("faces") > 0, "face").otherwise("motion")), "sample_count": F.when(t % 3 != 0, F.col("n")), "scene_cut_times": F.array(F.lit(1.5)), "visual_profile": F.when(t % 2 == 0, "visual"), **{c: F.lit(None).cast("int") for c in projects.PLAN_COUNTS if c != "sample_count"}})
    back = x.select("track_id", projects.plan_of(projects.plan_json()).alias("p"))
    total = F.aggregate("p.keyframes", F.lit(0).cast("long"), lambda a, f: a + F.round(f[1] * 1000).cast("long"))
    return back.select("track_id", "p.mode", F.size("p.keyframes").alias("n_keyframes"), total.alias("centers"), "p.sample_count", "p.source_width", "p.visual_profile")


@query("WITH p AS (SELECT c_custkey AS k FROM customer WHERE c_custkey % 13 <> 0 AND c_custkey % 11 <> 0) SELECT concat('job_', k) AS job_id, CAST(CASE WHEN k % 2 = 1 THEN 6 ELSE greatest(3, k % 4 + 1) END AS INTEGER) AS max_clips, 'balanced' AS profile, CASE WHEN k % 3 = 0 THEN 'youtube' ELSE 'upload' END AS source_type, 'auto' AS content_type, 'auto' AS duration_preference FROM p")
def mut6_resumed(spark, d):
    """What each project is taken up again with (MUT-6)."""
    return projects.resumed(documents.projects(_projects(spark, d)))


@query(S.CLIPS + ", e AS (SELECT job_id, count(*) AS n FROM clips WHERE (clip_ix + job_id) % 3 = 0 GROUP BY job_id) SELECT DISTINCT s.job_id, CAST(CASE WHEN s.job_id % 4 = 0 THEN 0 ELSE s.job_id % 4 END + coalesce(n, 0) AS INTEGER) AS transcript_revision, n IS NOT NULL AS transcript_edited FROM segments s LEFT JOIN e ON e.job_id = s.job_id")
def mut2_revisions(spark, d):
    """Each edit of a transcript adds a revision; empty ranges don't count (MUT-2)."""
    segs = bridge.segments(spark, d)
    k = (F.col("clip_ix") + F.col("job_id")) % 3
    edits = clips(segs).where(k < 2).select("job_id", "lo", F.when(k == 0, F.col("hi")).otherwise(F.col("lo")).alias("hi"))
    return projects.revised(segs.select("job_id", F.when(F.col("job_id") % 4 != 0, (F.col("job_id") % 4).cast("int")).alias("transcript_revision")).distinct(), edits)


@query(_score_sql() + ", r AS (SELECT job_id, start_ix, end_ix, score, row_number() OVER (PARTITION BY job_id ORDER BY score DESC, start_ix, end_ix) AS rank FROM scored) SELECT job_id, start_ix, end_ix, score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5")
def srt7_replies(spark, d):
    """The five best of the scored windows of each job, in the order of a reply (SRT-7)."""
    x = ranking.scored(ranking.admitted(ranking.windows(bridge.segments(spark, d)))).withColumn("place", F.struct("start_ix", "end_ix"))
    return projects.replies(x.select("job_id", "place", "start_ix", "end_ix", "score"), 5).drop("place")


@query(_PLANS + """, q AS (SELECT *, k * 0.5::DOUBLE AS t, floor(c * 10) / 10 AS cam FROM samples), w AS (SELECT *, lag(cam) OVER v AS b, lead(cam) OVER v AS f FROM q WINDOW v AS (PARTITION BY track_id ORDER BY t)) SELECT track_id, CAST(t * 2 AS INTEGER) AS k, CAST(round(cam * 10) AS INTEGER) AS camera FROM w WHERE b IS NULL OR f IS NULL OR abs(cam - b) > 0.0005 OR abs(f - cam) > 0.0005""")
def seq3_without_holds(spark, d):
    """Tracks without the samples where the camera holds still (SEQ-3's end)."""
    x = _samples(spark, d).select("track_id", "t", (F.floor(F.col("c") * 10) / 10).alias("camera"))
    return tracks.without_holds(x, "track_id").select("track_id", (F.col("t") * 2).cast("int").alias("k"), F.round(F.col("camera") * 10).cast("int").alias("camera"))
