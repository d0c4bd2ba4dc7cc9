"""Queries over files, caches, states and patches that are derived from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import catalog, cleanup, patches, tracks
from tidemark.plans import sqltext as S
from tidemark.plans.documents import _projects
from tidemark.plans.transcript import query
from tidemark.sources import bridge, documents, fingerprints
from tidemark.sources.shared import shared
from tidemark.sources.statetable import StateTable


def _read(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


_HEX = "hex(encode(coalesce(text, '')))"


@query(f"SELECT doc_id, sha256(encode(CAST(length({_HEX}) // 2 AS VARCHAR)) || unhex(left({_HEX}, 512)) || CASE WHEN length({_HEX}) > 512 THEN unhex(right({_HEX}, 512)) ELSE ''::BLOB END) AS fingerprint FROM documents")
def src5_fingerprint(spark, d):
    """The fingerprint of each document's bytes from its size and 256 bytes at each end (SRC-5)."""
    return _read(spark, d, "documents").select("doc_id", fingerprints.fingerprint(F.encode(F.coalesce("text", F.lit("")), "utf-8"), 256).alias("fingerprint"))


@query(S.BRIDGE + "SELECT job_id, sha256(sha256(CAST(job_id AS VARCHAR)) || '|local:audio:' || (job_id % 2)) AS cache_key, job_id % 3 <> 0 AND job_id % 7 <> 0 AND job_id % 11 <> 0 AS hit FROM (SELECT DISTINCT job_id FROM segments)")
def src4_cache_lookup(spark, d):
    """Which jobs find their transcript in the cache, where some are missing, some empty and some cut off (SRC-4)."""
    segs = bridge.segments(spark, d)
    k = F.col("job_id")
    key = fingerprints.cache_key(F.sha2(k.cast("string").cast("binary"), 256), F.concat(F.lit("local:audio:"), (k % 2).cast("string")))
    rows = segs.select("job_id", "seg_ix", (F.col("start_cs") / 100).alias("start"), (F.col("end_cs") / 100).alias("end"), "text", F.lit(None).cast("array<struct<start double, end double, text string, probability double>>").alias("words"))
    one = F.array_sort(F.collect_list(F.struct("seg_ix", documents.segment_json(rows).alias("j"))))
    docs = rows.groupBy("job_id").agg(F.concat(F.lit("["), F.array_join(F.transform(one, lambda x: x["j"]), ","), F.lit("]")).alias("doc")).withColumn("cache_key", key)
    cached = docs.where("job_id % 3 <> 0").withColumn("doc", F.when(k % 7 == 0, "[]").when(k % 11 == 0, F.left("doc", F.length("doc") - 4)).otherwise(F.col("doc")))
    return fingerprints.matched(docs.select("job_id", "cache_key"), cached.select("cache_key", "doc")).select("job_id", "cache_key", "hit")


@query("""WITH e AS (SELECT user_id, event_type AS status, CAST(floor(value) AS BIGINT) % 101 AS progress, event_id % 2 AS half, row_number() OVER (PARTITION BY user_id, event_id % 2 ORDER BY ts DESC, event_id DESC) AS r FROM events),
a AS (SELECT * FROM e WHERE r = 1 AND half = 0 AND user_id % 3 <> 0), b AS (SELECT * FROM e WHERE r = 1 AND half = 1 AND user_id % 3 <> 1)
SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(b.status, a.status) AS status, coalesce(CASE WHEN b.user_id % 5 <> 0 THEN b.progress END, a.progress) AS progress, CASE WHEN a.user_id IS NULL THEN '2024-05-02' ELSE '2024-05-01' END AS created_on, CASE WHEN b.user_id IS NULL THEN '2024-05-01' ELSE '2024-05-02' END AS updated_on FROM a FULL JOIN b ON a.user_id = b.user_id""")
def snk9_state_table(spark, d):
    """Task states written twice to a table of states: merged by key, stamped, published whole (SNK-9, SNK-2)."""
    table = StateTable(spark, shared(spark, "states"), "user_id", 16)
    e = _read(spark, d, "events").select("user_id", F.col("event_type").alias("status"), (F.floor("value").cast("long") % 101).alias("progress"), "ts", "event_id")
    last = lambda half: catalog.latest(e.where(F.col("event_id") % 2 == half), "user_id", "ts", "event_id").select("user_id", "status", "progress")
    seen = table.upsert(last(0).where("user_id % 3 <> 0"), "2024-05-01 00:00:00")
    table.upsert(last(1).where("user_id % 3 <> 1").withColumn("progress", F.when(F.col("user_id") % 5 != 0, F.col("progress"))), "2024-05-02 00:00:00", expected=seen)
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    return table.read().select("user_id", "status", "progress", day("created_at").alias("created_on"), day("updated_at").alias("updated_on"))


_PATHS = ("project.json", "transcript.json", "audio/{k}.wav", "clips/preview_{k}.mp4", "clips/short_{k}.mp4", "clips/captions_{k}.ass", "clips/reframe_{k}.json", "clips/full_{k}.part.mp4", ".project.json.{k}.tmp", "normalized.mp4", "source.{k}", "clips/cover_{k}.jpg", "audio/part.{k}.tmp", "clips/old/preview_{k}.mp4")
_FILES = f"WITH f AS (SELECT o_custkey AS job_id, replace({S.listed(_PATHS)}[o_orderkey % {len(_PATHS)} + 1], '{{k}}', CAST(o_orderkey AS VARCHAR)) AS path, CASE WHEN o_orderkey % 10 = 0 THEN 0 ELSE CAST(floor(o_totalprice) AS BIGINT) END AS bytes FROM orders)"


def _stored(spark, d):
    k = F.col("o_orderkey")
    name = F.replace(F.element_at(F.array(*map(F.lit, _PATHS)), (k % len(_PATHS) + 1).cast("int")), F.lit("{k}"), k.cast("string"))
    return _read(spark, d, "orders").select(F.col("o_custkey").alias("job_id"), name.alias("path"), F.when(k % 10 == 0, 0).otherwise(F.floor("o_totalprice")).cast("long").alias("bytes"))


@query(_FILES + """, j AS (SELECT *, starts_with(path, 'audio/') OR (starts_with(path, 'clips/') AND NOT contains(substr(path, 7), '/') AND (path GLOB 'clips/preview_*.mp4' OR path GLOB 'clips/captions_*.ass' OR path GLOB 'clips/reframe_*.json')) OR split_part(path, '/', -1) GLOB '*.part.*' OR path GLOB '*.tmp' AS own, path = 'normalized.mp4' OR (path GLOB 'source.*' AND NOT contains(path, '/')) AS src FROM f),
a AS (SELECT job_id, sum(bytes) AS before, count(*) FILTER (own) AS n, coalesce(sum(bytes) FILTER (own), 0) AS b, count(*) FILTER (src AND NOT own) AS sn, coalesce(sum(bytes) FILTER (src AND NOT own), 0) AS sb, bool_or(starts_with(path, 'clips/') AND ends_with(path, '.mp4') AND NOT contains(substr(path, 7), '/') AND NOT starts_with(path, 'clips/preview_') AND NOT own) AS rendered, bool_or(src AND NOT own AND bytes > 0) AS avail FROM j GROUP BY job_id),
r AS (SELECT c_custkey AS job_id, c_custkey % 3 = 0 AS rs, coalesce(before, 0) AS before, coalesce(n, 0) AS n, coalesce(b, 0) AS b, coalesce(sn, 0) AS sn, coalesce(sb, 0) AS sb, coalesce(rendered, false) AS rendered, coalesce(avail, false) AS avail FROM customer LEFT JOIN a ON job_id = c_custkey),
t AS (SELECT *, rs AND NOT rendered AS refused, rs AND rendered AS takes FROM r), u AS (SELECT *, CASE WHEN refused THEN 0 WHEN takes THEN n + sn ELSE n END AS rf, CASE WHEN refused THEN 0 WHEN takes THEN b + sb ELSE b END AS rb FROM t)
SELECT job_id, refused, CAST(rf AS BIGINT) AS removed_files, CAST(rb AS BIGINT) AS removed_bytes, CAST(before AS BIGINT) AS bytes_before, CAST(before - rb AS BIGINT) AS bytes_after, takes AND sn > 0 AS source_removed, avail AND NOT takes AS source_available FROM u""")
def mut4_cleanup(spark, d):
    """What cleaning up each project removes and leaves; every third also gives up its source (MUT-4, SRC-9, AGG-12's delta)."""
    asked = _read(spark, d, "customer").select(F.col("c_custkey").alias("job_id"), (F.col("c_custkey") % 3 == 0).alias("remove_source"))
    return cleanup.cleaned(_stored(spark, d), asked)


@query(_FILES + ", d AS (SELECT DISTINCT job_id FROM f WHERE path = 'transcript.json') SELECT job_id, path, bytes, CASE WHEN split_part(path, '/', -1) GLOB '*.part.*' OR path GLOB '*.tmp' THEN 'leftover' ELSE 'audio' END AS rule FROM f WHERE split_part(path, '/', -1) GLOB '*.part.*' OR path GLOB '*.tmp' OR starts_with(path, 'audio/') AND job_id IN (SELECT job_id FROM d)")
def mut4_stale_files(spark, d):
    """Leftovers of runs that were cut off, and audio that its transcript has made needless (MUT-4)."""
    return cleanup.stale(_stored(spark, d).withColumn("job_id", F.col("job_id").cast("string"))).withColumn("job_id", F.col("job_id").cast("long"))


@query(r"""WITH base AS (SELECT c_custkey AS job_id, i AS clip_ix, unnest(['title', 'description', 'score']) AS key, unnest(['Clip ' || i, NULL, CAST(c_custkey % 90 AS VARCHAR)]) AS value, -1 AS seq FROM customer, range(4) t(i) WHERE i < c_custkey % 4),
o AS (SELECT o_orderkey AS k, o_custkey AS job_id, o_orderkey % 5 AS clip_ix, o_orderkey % 3 AS kind, CASE WHEN o_orderkey % 10 = 0 THEN '  ' ELSE ' Title ' || o_orderkey END AS title, CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE 'About ' || o_orderkey END AS dsc, CASE WHEN o_orderkey % 6 = 0 THEN [] ELSE ['#a b', 'A-B', '', 'x' || o_orderkey % 7, '##q', 'r', 's', 't', 'u', 'v'] END AS tags FROM orders),
c0 AS (SELECT *, CASE WHEN trim(dsc) <> '' THEN dsc ELSE 'First ' || k END AS text, CASE WHEN len(tags) = 0 THEN '' ELSE '#ab #x' || k % 7 || ' #q #r #s #t #u' END AS joined FROM o WHERE kind = 0 AND trim(title) <> ''),
c AS (SELECT job_id, clip_ix, k AS seq, unnest(['title', 'description', 'hashtags', 'social_caption']) AS key, unnest([trim(title), text, joined, CASE WHEN joined <> '' THEN text || chr(10) || chr(10) || joined ELSE text END]) AS value FROM c0),
f AS (SELECT job_id, clip_ix, k AS seq, 'context.user_feedback' AS key, '{"reason":"' || ['weak', 'late'][k % 2 + 1] || '","note":"n' || k || '"}' AS value FROM o WHERE kind = 1),
e AS (SELECT job_id, clip_ix, k AS seq, 'title' AS key, NULL AS value FROM o WHERE kind = 2 AND k % 8 = 2),
n AS (SELECT job_id, -1 AS clip_ix, k AS seq, 'project_notes' AS key, 'note ' || k AS value FROM o WHERE kind = 2 AND k % 8 <> 2),
every AS (SELECT job_id, clip_ix, key, value, seq FROM base UNION ALL SELECT job_id, clip_ix, key, value, seq FROM c UNION ALL SELECT job_id, clip_ix, key, value, seq FROM f UNION ALL SELECT job_id, clip_ix, key, value, seq FROM e UNION ALL SELECT job_id, clip_ix, key, value, seq FROM n UNION ALL SELECT c_custkey, -1, 'name', c_name, -1 FROM customer),
l AS (SELECT *, row_number() OVER (PARTITION BY job_id, clip_ix, key ORDER BY seq DESC) AS r FROM every JOIN customer ON c_custkey = job_id WHERE clip_ix < c_custkey % 4)
SELECT job_id, CAST(clip_ix AS INTEGER) AS clip_ix, key, value FROM l WHERE r = 1""")
def mut3_patches(spark, d):
    """Project documents after all their patches: copy, feedback, notes, and titles set to null (MUT-3, SET-3's user form)."""
    c = _read(spark, d, "customer")
    k, o = F.col("c_custkey"), F.col("o_orderkey")
    fields = lambda i: F.create_map(F.lit("title"), F.concat(F.lit("Clip "), i.cast("string")), F.lit("description"), F.lit(None).cast("string"), F.lit("score"), (k % 90).cast("string"))
    empty = F.expr("cast(null as map<string,string>)")
    clips = F.when(k % 4 > 0, F.transform(F.sequence(F.lit(0).cast("long"), k % 4 - 1), lambda i: F.struct(fields(i).alias("fields"), empty.alias("context")))).otherwise(F.array().cast("array<struct<fields map<string,string>, context map<string,string>>>"))
    projects = c.select(k.alias("job_id"), F.create_map(F.lit("name"), F.col("c_name")).alias("fields"), clips.alias("clips"))
    tags = F.when(o % 6 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("#a b"), F.lit("A-B"), F.lit(""), F.concat(F.lit("x"), (o % 7).cast("string")), *map(F.lit, ("##q", "r", "s", "t", "u", "v"))))
    named = lambda s: F.concat(F.lit(s), o.cast("string"))
    copy = patches.copy_fields(F.when(o % 10 == 0, "  ").otherwise(named(" Title ")), F.when(o % 4 == 0, "").otherwise(named("About ")), tags, F.concat(F.lit("First "), o.cast("string"), F.lit("\n\nsecond")))
    blank = (o % 3 == 2) & (o % 8 == 2)
    note = (o % 3 == 2) & (o % 8 != 2)
    asked = _read(spark, d, "orders").select(
        F.col("o_custkey").alias("job_id"), F.when(note, None).otherwise((o % 5).cast("int")).alias("clip_ix"), o.alias("seq"),
        F.when(o % 3 == 0, copy).when(blank, F.create_map(F.lit("title"), F.lit(None).cast("string"))).when(note, F.create_map(F.lit("project_notes"), named("note "))).alias("fields"),
        F.when(o % 3 == 1, patches.feedback(F.when(o % 2 == 0, "weak").otherwise("late"), named("n"))).alias("context"),
    )
    x = patches.patched(projects, asked)
    own = x.select("job_id", F.lit(-1).alias("clip_ix"), F.explode("fields").alias("key", "value"))
    each = x.select("job_id", F.posexplode("clips").alias("clip_ix", "c"))
    inner = each.select("job_id", "clip_ix", F.explode("c.fields").alias("key", "value")).unionByName(each.select("job_id", "clip_ix", F.explode("c.context").alias("key", "value")).withColumn("key", F.concat(F.lit("context."), "key")))
    return own.unionByName(inner)


_TRACK = "WITH e AS (SELECT *, user_id * 100000 + date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS track_id FROM events), n AS (SELECT track_id, value, row_number() OVER (PARTITION BY track_id ORDER BY ts, event_id) AS k FROM e), p AS (SELECT track_id, k // 2 * 0.5::DOUBLE + k % 2 * 0.0003::DOUBLE AS t, 0.1::DOUBLE + CAST(floor(abs(value) * 100) AS BIGINT) % 800 / 1000.0::DOUBLE AS c FROM n), q AS (SELECT *, lead(t) OVER (PARTITION BY track_id ORDER BY t, c) - t AS gap FROM p), r AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY t DESC, c DESC) AS j FROM q WHERE gap IS NULL OR gap >= 0.0005::DOUBLE)"


@query(_TRACK.replace("WITH e", "WITH RECURSIVE e") + ", f AS (SELECT track_id, j, t, c, printf('clip(%.6f*iw-ow/2,0,iw-ow)', c) AS e FROM r WHERE j = 1 UNION ALL SELECT f.track_id, r.j, r.t, r.c, printf('if(lt(t,%.3f),clip((%.6f+(%.6f)*(t-%.3f)/%.3f)*iw-ow/2,0,iw-ow),%s)', f.t, r.c, f.c - r.c, r.t, greatest(0.001::DOUBLE, f.t - r.t), f.e) FROM f JOIN r ON r.track_id = f.track_id AND r.j = f.j + 1) SELECT track_id, arg_max(e, j) AS expression FROM f GROUP BY track_id")
def mth8_piecewise(spark, d):
    """The crop of each track as one nested expression of time (MTH-8); some points are nearly at the same time."""
    from tidemark.plans.analytics import _samples

    k = F.col("k")
    return tracks.piecewise(_samples(spark, d).withColumn("t", F.floor(k / 2) * 0.5 + k % 2 * 0.0003), "track_id")


@query("""WITH p AS (SELECT c_custkey AS k, concat('job', CASE WHEN c_custkey % 13 = 0 THEN '.' ELSE '_' END, c_custkey) AS job_id, c_custkey % 11 = 0 AS bad, c_name FROM customer),
t AS (SELECT event_id, event_type, ts, value FROM events ORDER BY ts DESC, event_id DESC LIMIT 100)
SELECT 'project' AS section, job_id, CASE WHEN NOT bad AND k % 7 <> 0 THEN c_name END AS title, CASE WHEN NOT bad THEN CASE k % 3 WHEN 0 THEN 'youtube' WHEN 1 THEN 'disk' END END AS source_type, CASE WHEN NOT bad THEN CASE k % 4 WHEN 0 THEN '' WHEN 1 THEN 'analyzing' END END AS status, CASE WHEN NOT bad THEN CASE WHEN k % 2 = 0 THEN CAST(k % 4 + 1 AS INTEGER) ELSE 0 END END AS clip_count, CASE WHEN NOT bad AND k % 5 <> 0 THEN concat('2024-01-', lpad(CAST(k % 28 + 1 AS VARCHAR), 2, '0')) END AS updated_at, bad AS read_error, NULL AS task_id, NULL AS kind, NULL AS stage, NULL AS progress, NULL AS error, NULL AS created_at, NULL AS recoverable FROM p
UNION ALL SELECT 'task', 'job_' || (event_id % 50), NULL, NULL, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'running' END, NULL, NULL, NULL, CAST(event_id AS VARCHAR), event_type, NULL, CAST(CAST(floor(value) AS BIGINT) % 101 AS VARCHAR), CASE WHEN event_type = 'error' THEN 'stopped' END, strftime(ts, '%Y-%m-%d %H:%M:%S'), CASE WHEN event_type = 'error' THEN 'true' ELSE 'false' END FROM t""")
def snk7_diagnostics(spark, d):
    """The redacted rows of a diagnostics bundle: all projects, broken ones too, and the newest hundred tasks (SNK-7)."""
    e = _read(spark, d, "events")
    failed = F.col("event_type") == "error"
    tasks = e.select(F.col("event_id").alias("task_id"), F.col("event_type").alias("kind"), F.when(failed, "failed").otherwise("running").alias("status"), (F.floor("value").cast("long") % 101).alias("progress"), F.concat(F.lit("job_"), (F.col("event_id") % 50).cast("string")).alias("job_id"), F.when(failed, "stopped").alias("error"), F.col("ts").alias("created_at"), failed.alias("recoverable"), F.col("props").alias("spec"))
    return documents.diagnostics(_projects(spark, d), tasks).withColumn("created_at", F.left("created_at", F.lit(19)))
