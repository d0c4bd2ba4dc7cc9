"""Queries over contexts, tracks, quality, texts of documents, catalogs and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import lexicon as lx
from tidemark.functions import text as T
from tidemark.operators import captions, catalog, context, quality, scenes, tracks
from tidemark.plans import sqltext as S
from tidemark.plans.transcript import ORACLE, clips, query, shots
from tidemark.sources import bridge
from tidemark.streaming import sessions as streams


def _read(spark, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


_TITLES = ("Podcast Nova", "anime season 2 funny", "Wild habitat", "boss fight quest", "Plain talk", "A comedy film prank", "interview")
_CLIPTEXT = "string_agg(trim(text), ' ' ORDER BY seg_ix)"


def _votes() -> str:
    v = {k: " + ".join(f"28 * contains(title, {S.q(w)})::INT + 8 * contains(t, {S.q(w)})::INT" for w in ws) for k, ws in lx.TYPE_KEYWORDS.items()}
    v["podcast"] += f" + CASE WHEN length(t) > 1000 AND {S.times_in('t', '?')} >= 4 AND {S.times_in('t', ' i ')} + {S.times_in('t', ' we ')} + {S.times_in('t', ' you ')} >= 18 THEN 12 ELSE 0 END"
    return ", ".join(f"{{'v': -({x}), 'i': {i}, 'kind': '{k}'}}" for i, (k, x) in enumerate(v.items()))


_TALK = f"length(t) > 1000 AND {S.times_in('t', '?')} >= 4 AND {S.times_in('t', ' i ')} + {S.times_in('t', ' we ')} + {S.times_in('t', ' you ')} >= 18"
_TOLD = ", ".join(f"CASE WHEN contains(title, {S.q(w)}) THEN {S.q('title/subject mentions ' + w.strip())} END" for ws in lx.TYPE_KEYWORDS.values() for w in ws)
_KINDS = f"""kt AS (SELECT job_id, lower({_CLIPTEXT}) AS t, lower({S.listed(_TITLES)}[job_id % 7 + 1]) AS title FROM segments WHERE seg_ix < 180 GROUP BY job_id), kv AS (SELECT *, list_sort([{_votes()}]) AS l, list_filter([{_TOLD}, CASE WHEN {_TALK} THEN 'dialogue-heavy transcript' END], lambda x: x IS NOT NULL)[1:4] AS signals FROM kt),
kinds AS (SELECT job_id, CASE WHEN -l[1].v < 24 THEN 'other' ELSE l[1].kind END AS kind, CAST(CASE WHEN -l[1].v < 24 THEN 3500 ELSE least(9200, 5000 + least(-l[1].v, 60) * 55 + (l[2].v - l[1].v) * 40) END AS INTEGER) AS confidence_bp, signals FROM kv)"""
_told = lambda x: x.withColumn("signals", F.array_join("signals", "; "))


@query(S.BRIDGE + ", " + _KINDS + " SELECT job_id, kind, confidence_bp, array_to_string(signals, '; ') AS signals FROM kinds")
def agg4_content_type(spark, d):
    """The content type of each job by keywords in its title and text, and the signals for it (AGG-4)."""
    return _told(_kinds(bridge.segments(spark, d)))


def _kinds(segs):
    title = F.element_at(F.array(*map(F.lit, _TITLES)), (F.col("job_id") % 7 + 1).cast("int"))
    return context.content_type(segs, segs.select("job_id").distinct().withColumn("title", title))


def _structure_sql(kinds: str) -> str:
    """CTEs up to structures(job_id, points, structure, confidence_bp, signals), from kinds(job_id, kind)."""
    return f"""p AS (SELECT job_id, arg_max(end_cs, seg_ix) - arg_min(start_cs, seg_ix) AS dur, count(*) FILTER (seg_ix > 0 AND gap_before >= 220) AS hard, count(*) FILTER (seg_ix > 0 AND gap_before >= 400) AS very FROM gaps GROUP BY job_id),
b AS (SELECT job_id, seg_ix // 8 AS block, list_distinct(flatten(list({S.topic('text')}))) AS t FROM segments GROUP BY ALL), n AS (SELECT job_id, t, lead(t) OVER (PARTITION BY job_id ORDER BY block) AS u FROM b WHERE len(t) > 0), s AS (SELECT job_id, count(*) AS comparisons, count(*) FILTER ({S.jaccard('t', 'u')} < 0.08) AS low FROM n WHERE u IS NOT NULL GROUP BY job_id),
c AS (SELECT job_id, {' + '.join(S.times_in('x', w) for w in lx.COMPILATION_CUES)} AS cues FROM (SELECT job_id, lower({_CLIPTEXT}) AS x FROM segments GROUP BY job_id)),
v AS (SELECT job_id, dur, dur >= 15000 AND hard >= 3 AS v1, very >= 2 AS v2, coalesce(comparisons, 0) >= 4 AND low >= 0.58 * comparisons AS v3, coalesce(cues, 0) AS cues FROM p LEFT JOIN s USING (job_id) LEFT JOIN c USING (job_id)),
a AS (SELECT v.*, kind = 'podcast' AS talk, 150 * v1::INT + 120 * v2::INT + 150 * coalesce(v3, false)::INT + least(250, cues * 90) AS points FROM v LEFT JOIN {kinds} USING (job_id)),
structures AS (SELECT job_id, CAST(points AS INTEGER) AS points, CASE WHEN points >= 260 THEN 'compilation' WHEN talk THEN 'conversation' ELSE 'single-story' END AS structure, CAST(CASE WHEN points >= 260 THEN least(9000, 5500 + points * 8) WHEN talk THEN 7200 WHEN dur >= 6000 THEN 6200 ELSE 5200 END AS INTEGER) AS confidence_bp,
  CASE WHEN points < 260 AND talk THEN ['podcast/interview content'] ELSE list_filter([CASE WHEN v1 THEN 'several long transcript breaks' END, CASE WHEN v2 THEN 'multiple major pauses' END, CASE WHEN v3 THEN 'frequent local topic changes' END, CASE WHEN cues > 0 THEN 'compilation-style wording' END], lambda x: x IS NOT NULL) END AS signals FROM a)"""


@query(S.GAPS + ", " + _KINDS + ", " + _structure_sql("kinds") + " SELECT job_id, points, structure, confidence_bp, array_to_string(signals, '; ') AS signals FROM structures")
def agg5_structure(spark, d):
    """Compilation, conversation or single story, by pauses, topics, wording and the kind that was found (AGG-5)."""
    segs = bridge.segments(spark, d)
    return _told(context.structure(segs, _kinds(segs)))


_ASKED_KINDS = ("auto", " Podcast", "bogus", "anime")
_ASKED_STRUCTURES = ("auto", "compilation", "other", " Conversation ", "auto")
_CONTEXTS = _KINDS + f""", asked AS (SELECT job_id, kind AS found, confidence_bp AS kc0, signals AS ks0, {S.listed(_ASKED_KINDS)}[job_id % 4 + 1] AS ak, {S.listed(_ASKED_STRUCTURES)}[job_id % 5 + 1] AS ast FROM kinds),
held AS (SELECT job_id, ast, CASE ak WHEN ' Podcast' THEN 'podcast' WHEN 'anime' THEN 'anime' ELSE found END AS kind, CASE WHEN ak IN (' Podcast', 'anime') THEN 10000 ELSE kc0 END AS kc, CASE WHEN ak IN (' Podcast', 'anime') THEN ['user-selected content type'] ELSE ks0 END AS ks FROM asked), """ + _structure_sql("held") + """,
contexts AS (SELECT held.job_id, kind, CASE ast WHEN 'compilation' THEN 'compilation' WHEN ' Conversation ' THEN 'conversation' ELSE structure END AS structure, CAST(least(kc, CASE WHEN ast IN ('compilation', ' Conversation ') THEN 10000 ELSE confidence_bp END) AS INTEGER) AS confidence_bp,
  list_concat(ks, CASE WHEN ast IN ('compilation', ' Conversation ') THEN ['user-selected content structure'] ELSE structures.signals END)[1:6] AS signals FROM held JOIN structures USING (job_id))"""


@query(S.GAPS + ", " + _CONTEXTS + " SELECT job_id, kind, structure, confidence_bp, array_to_string(signals, '; ') AS signals FROM contexts")
def agg6_context(spark, d):
    """The context of each job: the user's choice where there is one, else what was found (AGG-6)."""
    return _told(contexts(bridge.segments(spark, d)))


def contexts(segs):
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (F.col("job_id") % len(values) + 1).cast("int"))
    asked = segs.select("job_id").distinct().select("job_id", pick(_ASKED_KINDS).alias("asked_kind"), pick(_ASKED_STRUCTURES).alias("asked_structure"))
    return context.resolved(asked, _kinds(segs), segs)


@query(S.BRIDGE + r""", t AS (SELECT w.job_id, w.seg_ix, word_ix, pct, lower(regexp_replace(word, '[^\p{L}\p{N}_'']+', '', 'g')) AS tok FROM words w), g AS (SELECT job_id, seg_ix, count(*) AS n, sum(pct) AS s, count(*) FILTER (pct < 38) AS n38, count(*) FILTER (pct < 48) AS n48, count(*) FILTER (pct < 25) AS n25, count(*) FILTER (tok <> '') AS toks FROM t GROUP BY ALL),
j AS (SELECT job_id, count(*) AS segment_count, sum(n) AS n, sum(s) AS s, sum(n48) AS n48, sum(n25) AS n25, count(*) FILTER (toks >= 3 AND (s / n / 100 < 0.56 OR n38 / n > 0.28)) AS weak, min(CASE WHEN toks >= 3 THEN s / n / 100 END) AS weakest FROM g GROUP BY job_id) SELECT job_id, CAST(weak AS BIGINT) AS weak_segments, segment_count, CAST(round(10000 * n48 / n) AS BIGINT) AS low_bp, CAST(round(10000 * n25 / n) AS BIGINT) AS very_bp, CAST(round(100 * s / n) AS BIGINT) AS avg_bp, CAST(round(10000 * coalesce(weakest, s / n / 100)) AS BIGINT) AS weakest_bp FROM j""")
def agg1_quality(spark, d):
    """Shares of unlikely words and mean probabilities of each job, in hundredths of a percent, each rounded once (AGG-1)."""
    segs = bridge.segments(spark, d)
    return quality_bp(quality.sums(segs, bridge.words(segs)))


def quality_bp(x: DataFrame) -> DataFrame:
    """quality.sums as whole numbers. Quotients of whole numbers are rounded, so that a half stays one; jobs have words here."""
    bp = lambda c: F.round(c).cast("long")
    weakest = F.coalesce("weakest", F.col("s") / F.col("n") / 100)
    return x.select("job_id", F.col("weak").alias("weak_segments"), "segment_count", bp(F.col("n48") * 10000 / F.col("n")).alias("low_bp"), bp(F.col("n25") * 10000 / F.col("n")).alias("very_bp"), bp(F.col("s") * 100 / F.col("n")).alias("avg_bp"), bp(weakest * 10000).alias("weakest_bp"))


@query(S.CLIPS + "SELECT c.job_id, clip_ix, count(*) AS n, CASE WHEN count(*) >= 4 THEN sum(pct) END AS total FROM clips c JOIN words w ON w.job_id = c.job_id AND w.end_cs > lo AND w.start_cs < hi GROUP BY ALL")
def agg3_confidence(spark, d):
    segs = bridge.segments(spark, d)
    from tidemark.operators import intervals

    x = intervals.interval_join(clips(segs), bridge.words(segs), "job_id", "lo", "hi").groupBy("job_id", "clip_ix").agg(F.count("*").alias("n"), F.sum("pct").alias("total"))
    return x.withColumn("total", F.when(F.col("n") >= 4, F.col("total")))


@query(S.BRIDGE + f", t AS (SELECT job_id, unnest(regexp_extract_all(lower(text), '[a-z0-9'']+', 0)) AS tok FROM segments), c AS (SELECT job_id, tok, count(*) AS n FROM t WHERE length(tok) >= 4 AND NOT list_contains({S.listed(lx.TOPIC_STOP)}, tok) GROUP BY ALL) SELECT job_id, tok, n FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY n DESC, tok DESC) AS k FROM c) WHERE k <= 2")
def agg7_agg8_topics(spark, d):
    """The two most frequent topic words of each job (ties: the later word)."""
    tok = F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9']+"), F.lit(0)))
    c = bridge.segments(spark, d).select("job_id", tok.alias("tok")).where((F.length("tok") >= 4) & ~F.col("tok").isin(*lx.TOPIC_STOP)).groupBy("job_id", "tok").agg(F.count("*").alias("n"))
    k = F.row_number().over(Window.partitionBy("job_id").orderBy(F.desc("n"), F.desc("tok")))
    return c.withColumn("k", k).where("k <= 2").drop("k")


@query(S.BRIDGE + "SELECT job_id, count(*) AS n, min(start_cs) AS first_cs, max(end_cs) AS last_cs, sum(length(text)) AS chars FROM segments GROUP BY job_id")
def agg9_span(spark, d):
    return bridge.segments(spark, d).groupBy("job_id").agg(F.count("*").alias("n"), F.min_by("start_cs", "seg_ix").alias("first_cs"), F.max_by("end_cs", "seg_ix").alias("last_cs"), F.sum(F.length("text")).alias("chars"))


def _samples(spark, d) -> DataFrame:
    """A track for each user and day, as a clip has one: a sample every half second, from the events' values."""
    e = _read(spark, d, "events").withColumn("track_id", F.col("user_id") * 100000 + F.datediff("ts", F.lit("2024-01-01").cast("date")))
    k = F.row_number().over(Window.partitionBy("track_id").orderBy("ts", "event_id"))
    return e.select("track_id", k.alias("k"), "value", "event_type").withColumns({"t": F.col("k") * 0.5, "c": 0.1 + F.floor(F.abs(F.col("value")) * 100).cast("long") % 800 / 1000.0})


_SAMPLES = "WITH e AS (SELECT *, user_id * 100000 + date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS track_id FROM events), k AS (SELECT track_id, event_type, value, row_number() OVER (PARTITION BY track_id ORDER BY ts, event_id) AS k FROM e), samples AS (SELECT *, k * 0.5::DOUBLE AS t, 0.1::DOUBLE + CAST(floor(abs(value) * 100) AS BIGINT) % 800 / 1000.0::DOUBLE AS c FROM k)"


_CLIP = "least(0.9::DOUBLE, greatest(0.1::DOUBLE, {}))".format


@query(_SAMPLES.replace("WITH e", "WITH RECURSIVE e") + f""", r AS (SELECT track_id, k, t, {_CLIP('c')} AS cam, 0 AS o FROM samples WHERE k = 1 UNION ALL
SELECT track_id, k, t, CASE WHEN mv THEN ncam ELSE cam END, CASE WHEN mv AND abs(tg - ncam) <= 0.075 THEN 0 ELSE o2 END FROM (SELECT *, abs(dd) > 0.075 AND (o2 >= 2 OR abs(dd) >= 0.155) AND abs(w) >= 0.018 AS mv, {_CLIP('cam + least(mx, greatest(-mx, w))')} AS ncam FROM (SELECT *, CASE WHEN abs(dd) <= 0.075 THEN 0 ELSE o + 1 END AS o2, {_CLIP('tg - CASE WHEN dd > 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END * 0.05::DOUBLE')} - cam AS w FROM
(SELECT r.track_id, s.k, s.t, r.cam, r.o, {_CLIP('s.c')} AS tg, {_CLIP('s.c')} - r.cam AS dd, 0.16::DOUBLE * greatest(0.001::DOUBLE, s.t - r.t) AS mx FROM r JOIN samples s ON s.track_id = r.track_id AND s.k = r.k + 1))))
SELECT track_id, CAST(k AS INTEGER) AS k, CAST(round(cam * 1000000) AS BIGINT) AS camera_ppm FROM r""")
def seq3_camera(spark, d):
    x = tracks.stabilise(_samples(spark, d), "track_id")
    return x.select("track_id", (F.col("t") * 2).cast("int").alias("k"), F.round(F.col("camera") * 1000000).cast("long").alias("camera_ppm"))


@query(_SAMPLES + "SELECT track_id, CAST(round(list_reduce(list(c ORDER BY t), lambda a, x: a + least(0.08::DOUBLE, greatest(-0.08::DOUBLE, x - a)) * 0.5, 0.5::DOUBLE) * 1000000) AS BIGINT) AS last_ppm FROM samples GROUP BY track_id")
def seq6_smooth(spark, d):
    return tracks.smooth(_samples(spark, d), "track_id").select("track_id", F.round(F.col("last") * 1000000).cast("long").alias("last_ppm"))


@query()
def seq5_simplify(spark, d):
    """Simplified tracks: at most 72 points each, ends kept (checked by tests)."""
    return tracks.simplify(_samples(spark, d), "track_id")


@query(_SAMPLES + ", s AS (SELECT track_id, CAST(k * 50 AS BIGINT) AS t_cs FROM samples), v AS (SELECT track_id, k * 50 AS start_cs, k * 50 + 20 AS end_cs FROM samples WHERE event_type = 'click' AND value < 5), n AS (SELECT DISTINCT track_id FROM v) SELECT s.track_id, s.t_cs, n.track_id IS NULL OR EXISTS (SELECT 1 FROM v WHERE v.track_id = s.track_id AND s.t_cs >= v.start_cs - 12 AND s.t_cs <= v.end_cs + 12) AS active FROM s LEFT JOIN n ON n.track_id = s.track_id")
def jn8_speech_active(spark, d):
    x = _samples(spark, d).withColumn("t_cs", F.col("k").cast("long") * 50)
    speech = x.where("event_type = 'click' and value < 5").select("track_id", F.col("t_cs").alias("start_cs"), (F.col("t_cs") + 20).alias("end_cs"))
    return tracks.speech_active(x.select("track_id", "t_cs"), speech, "track_id").select("track_id", "t_cs", "active")


@query(S.CLIPS + "SELECT job_id, clip_ix, unnest(generate_series(lo, hi - 1, greatest(45, CAST(ceil((hi - lo) / 120) AS BIGINT)))) AS t_cs FROM clips")
def seq11_sample_plan(spark, d):
    return tracks.sample_plan(clips(bridge.segments(spark, d))).select("job_id", "clip_ix", "t_cs")


@query(_SAMPLES + "SELECT track_id, CAST(count(*) FILTER (event_type = 'click') AS BIGINT) AS hits, count(*) AS n, count(*) >= 2 AND count(*) FILTER (event_type = 'click') / greatest(count(*), 1)::DOUBLE >= 0.24 AS likely FROM samples GROUP BY track_id")
def agg10_plan_ratio(spark, d):
    hits = F.count_if(F.col("event_type") == "click")
    return _samples(spark, d).groupBy("track_id").agg(hits.alias("hits"), F.count("*").alias("n"), ((F.count("*") >= 2) & (hits / F.greatest(F.count("*"), F.lit(1)) >= 0.24)).alias("likely"))


@query("WITH e AS (SELECT user_id, event_id, ts, CAST(floor(abs(value) * 1000) AS BIGINT) AS size FROM events), f AS (SELECT *, ts >= (SELECT max(ts) FROM events) - INTERVAL 10 DAY AS fresh FROM e), r AS (SELECT *, sum(size) OVER (PARTITION BY user_id, fresh ORDER BY ts DESC, event_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM f) SELECT user_id, event_id, fresh AND run <= 200000 AS kept FROM r")
def seq9_retention(spark, d):
    e = _read(spark, d, "events").select("user_id", "event_id", "ts", F.floor(F.abs("value") * 1000).cast("long").alias("size"))
    e = e.join(F.broadcast(e.agg(F.max("ts").alias("now"))), F.col("ts") <= F.col("now"))  # one row
    return catalog.retained(e, "user_id", "ts", "size", "event_id", F.col("now"), F.expr("INTERVAL 10 DAYS"), 200_000).select("user_id", "event_id", "kept")


@query("SELECT user_id, arg_max(event_type, {'ts': ts, 'event_id': event_id}) AS status, max(ts) AS at FROM events GROUP BY user_id")
def mut5_latest_state(spark, d):
    return catalog.latest(_read(spark, d, "events").select("user_id", "ts", "event_id", F.col("event_type").alias("status")), "user_id", "ts", "event_id").select("user_id", "status", F.col("ts").alias("at"))


@query("SELECT event_id, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 250")
def srt8_newest_tasks(spark, d):
    return catalog.newest(_read(spark, d, "events").select("event_id", "ts"), "ts", "event_id")


@query("WITH n AS (SELECT o_custkey AS c_custkey, CASE WHEN max(o_totalprice) > 200000 THEN 'large ' || count(*) END AS c_name, count(*) AS n_orders FROM orders GROUP BY o_custkey) SELECT coalesce(n.c_custkey, o.c_custkey) AS c_custkey, coalesce(n.c_name, o.c_name) AS c_name, o.c_acctbal AS c_acctbal, n.n_orders AS n_orders FROM customer o FULL JOIN n ON o.c_custkey = n.c_custkey")
def snk2_upsert(spark, d):
    """All customers, updated by what all orders tell: a new name for some, a count for those with orders."""
    old = _read(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    by = _read(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey"))
    new = by.agg(F.when(F.max("o_totalprice") > 200000, F.concat(F.lit("large "), F.count("*").cast("string"))).alias("c_name"), F.count("*").alias("n_orders"))
    return catalog.upsert(old, new, "c_custkey")


@query(r"SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)) AS host, lower(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)) IN ('spam-farm.example.org', 'www.cheap-pills.example.com') AS listed FROM pages")
def src13_url_host(spark, d):
    p = _read(spark, d, "pages")
    return p.select("page_id", F.lower(F.parse_url("url", F.lit("HOST"))).alias("host"), catalog.copyright_host(F.col("url"), ("spam-farm.example.org", "www.cheap-pills.example.com")).alias("listed"))


@query("SELECT page_id, url FROM pages WHERE contains(lower(concat_ws(' ', url, html)), 'license')")
def flt17_search(spark, d):
    return catalog.found(_read(spark, d, "pages"), " License ", "url", "html").select("page_id", "url")


@query(r"SELECT doc_id, CASE WHEN x = '' THEN 'clip' ELSE x END || '.mp4' AS name FROM (SELECT doc_id, left(trim(regexp_replace(regexp_replace(regexp_replace(trim(coalesce(text, ''), concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))), '\.mp4$', '', 'i'), '[^A-Za-z0-9 _-]+', '', 'g'), '[ _]+', '-', 'g'), '-_'), 80) AS x FROM documents)")
def flt18_safe_name(spark, d):
    return _read(spark, d, "documents").select("doc_id", catalog.safe_name(F.col("text")).alias("name"))


@query("SELECT event_id, CASE WHEN lower(trim(event_type)) IN ('click', 'view') THEN lower(trim(event_type)) ELSE 'auto' END AS kind, coalesce(MAP {'click': 'fill', 'view': 'focus', 'error': 'preserve'}[event_type], 'balanced') AS layout FROM events")
def flt1_flt2_normalise(spark, d):
    """An enum with a fallback, and an alias map."""
    x = F.lower(F.trim("event_type"))
    alias = F.create_map(*map(F.lit, ("click", "fill", "view", "focus", "error", "preserve")))
    return _read(spark, d, "events").select("event_id", F.when(x.isin("click", "view"), x).otherwise("auto").alias("kind"), F.coalesce(F.try_element_at(alias, F.col("event_type")), F.lit("balanced")).alias("layout"))


@query(r"SELECT doc_id, nullif(left(trim(regexp_replace(text, '\s+', ' ', 'g')), 160), '') AS hint FROM documents")
def flt3_hint(spark, d):
    x = F.left(T.clean(F.col("text")), F.lit(160))
    return _read(spark, d, "documents").select("doc_id", F.when(x != "", x).alias("hint"))


@query("SELECT event_id, value BETWEEN 1 AND 180 AND user_id >= 0 AS valid, concat_ws(',', CASE WHEN value < 1 THEN 'short' END, CASE WHEN value > 180 THEN 'long' END, CASE WHEN user_id < 0 THEN 'user' END) AS why FROM events")
def flt4_validation(spark, d):
    why = F.concat_ws(",", F.when(F.col("value") < 1, "short"), F.when(F.col("value") > 180, "long"), F.when(F.col("user_id") < 0, "user"))
    return _read(spark, d, "events").select("event_id", (F.col("value").between(1, 180) & (F.col("user_id") >= 0)).alias("valid"), why.alias("why"))


@query(r"WITH s AS (SELECT doc_id, unnest(regexp_extract_all(regexp_replace(text, '\s+', ' ', 'g'), '[^.!?]+[.!?]*', 0)) AS s FROM documents) SELECT doc_id, count(*) AS n, max(length(trim(s))) AS longest FROM s WHERE trim(s) <> '' GROUP BY doc_id")
def str4_sentences(spark, d):
    s = _read(spark, d, "documents").select("doc_id", F.explode(F.regexp_extract_all(F.regexp_replace("text", r"\s+", " "), F.lit("[^.!?]+[.!?]*"), F.lit(0))).alias("s"))
    return s.where("trim(s) <> ''").groupBy("doc_id").agg(F.count("*").alias("n"), F.max(F.length(F.trim("s"))).cast("long").alias("longest"))


@query("SELECT doc_id, CASE WHEN j = '' THEN '' ELSE '#' || left(j, 36) END AS tag FROM (SELECT doc_id, array_to_string(list_transform(regexp_extract_all(text, '[A-Za-z0-9]+', 0), lambda w: upper(left(w, 1)) || substr(w, 2)), '') AS j FROM documents)")
def str17_hashtag(spark, d):
    from tidemark.operators.copywriting import hashtag

    return _read(spark, d, "documents").select("doc_id", hashtag(F.col("text")).alias("tag"))


@query(S.BRIDGE + "SELECT job_id, CAST(i AS INTEGER) AS chunk_ix, i * 18000 AS start_cs, least(n, (i + 1) * 18000) AS end_cs FROM (SELECT job_id, n, unnest(generate_series(0, (n - 1) // 18000)) AS i FROM (SELECT job_id, CAST(max(end_cs) AS BIGINT) AS n FROM segments GROUP BY job_id))")
def src12_chunks(spark, d):
    n = bridge.segments(spark, d).groupBy("job_id").agg(F.max("end_cs").alias("n"))
    x = n.select("job_id", "n", F.explode(F.sequence(F.lit(0), ((F.col("n") - 1) / 18000).cast("int"))).alias("chunk_ix"))
    return x.select("job_id", "chunk_ix", (F.col("chunk_ix").cast("long") * 18000).alias("start_cs"), F.least(F.col("n"), (F.col("chunk_ix").cast("long") + 1) * 18000).alias("end_cs"))


@query(S.CLIPS + ", w AS (SELECT c.job_id, clip_ix, sum(n_words) AS n, max(hi - lo) AS d FROM clips c JOIN segments s ON s.job_id = c.job_id AND s.end_cs > lo AND s.start_cs < hi GROUP BY ALL) SELECT job_id, clip_ix, CAST(n * 6000 // greatest(d, 100) AS BIGINT) AS wpm, CASE WHEN n * 6000 // greatest(d, 100) BETWEEN 100 AND 205 THEN 'good' ELSE 'off' END AS density FROM w")
def mth2_wpm(spark, d):
    from tidemark.operators import intervals

    segs = bridge.segments(spark, d)
    w = intervals.interval_join(clips(segs), segs, "job_id", "lo", "hi").groupBy("job_id", "clip_ix").agg(F.sum("n_words").alias("n"), F.max(F.col("hi") - F.col("lo")).alias("d"))
    wpm = F.floor(F.col("n") * 6000 / F.greatest(F.col("d"), F.lit(100))).cast("long")
    return w.select("job_id", "clip_ix", wpm.alias("wpm"), F.when(wpm.between(100, 205), "good").otherwise("off").alias("density"))


_LOWS = {k: v for k, v in lx.DURATION_GUIDES.items()}


@query(f"""WITH g AS (SELECT event_id, (MAP {{{', '.join(f"'{k}': [{a}, {b}]" for k, (a, b) in lx.DURATION_GUIDES.items())}}})[{S.listed(tuple(lx.DURATION_GUIDES))}[event_id % 7 + 1]] AS b, ['auto', 'short', 'longer'][event_id % 3 + 1] AS p FROM events),
l AS (SELECT *, CASE p WHEN 'short' THEN greatest(8, CAST(round_even(b[1] * 0.65::DOUBLE, 0) AS INTEGER)) WHEN 'longer' THEN greatest(b[1], CAST(round_even(b[1] * 1.15::DOUBLE, 0) AS INTEGER)) ELSE b[1] END AS lo FROM g) SELECT event_id, lo AS low_s, CASE p WHEN 'short' THEN least(60, greatest(lo + 8, CAST(round_even(b[2] * 0.72::DOUBLE, 0) AS INTEGER))) WHEN 'longer' THEN least(120, greatest(lo + 18, CAST(round_even(b[2] * 1.45::DOUBLE, 0) AS INTEGER))) ELSE b[2] END AS high_s FROM l""")
def mth4_duration_bounds(spark, d):
    kinds = F.array(*map(F.lit, lx.DURATION_GUIDES))
    guide = F.create_map(*[x for k, (a, b) in lx.DURATION_GUIDES.items() for x in (F.lit(k), F.array(F.lit(a), F.lit(b)))])
    e = _read(spark, d, "events").select("event_id", F.element_at(guide, F.element_at(kinds, (F.col("event_id") % 7 + 1).cast("int"))).alias("b"), F.element_at(F.array(F.lit("auto"), F.lit("short"), F.lit("longer")), (F.col("event_id") % 3 + 1).cast("int")).alias("p"))
    low, high = F.col("b")[0], F.col("b")[1]
    e = e.withColumn("low_s", F.when(F.col("p") == "short", F.greatest(F.lit(8), T.half_even(low * 0.65))).when(F.col("p") == "longer", F.greatest(low, T.half_even(low * 1.15))).otherwise(low))
    top = F.when(F.col("p") == "short", F.least(F.lit(60), F.greatest(F.col("low_s") + 8, T.half_even(high * 0.72)))).when(F.col("p") == "longer", F.least(F.lit(120), F.greatest(F.col("low_s") + 18, T.half_even(high * 1.45)))).otherwise(high)
    return e.select("event_id", "low_s", top.alias("high_s"))


@query("WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s FROM e) SELECT user_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) + 1800000000 AS end_us, count(*) AS n FROM s GROUP BY user_id, s.s")
def stm2_sessions(spark, d):
    x = streams.sessions(_read(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")))
    return x.select("user_id", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n")


@query("SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS start_us, event_type, count(*) AS n FROM events GROUP BY ALL")
def stm_hourly_counts(spark, d):
    x = streams.counts(_read(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")))
    return x.select(F.unix_micros("start").alias("start_us"), "event_type", "n")


@query(S.GAPS + ", c AS (SELECT job_id, seg_ix, n_words % 17 AS score, (job_id + seg_ix) % 6 = 0 AS replaced FROM segments), r AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY score DESC, seg_ix) AS rank FROM c WHERE NOT replaced) SELECT job_id, seg_ix, score, rank FROM r WHERE rank <= 3")
def srt3_rank(spark, d):
    """The best three by score, in their order where scores are equal, without those that were replaced (SRT-3, WIN-7)."""
    c = bridge.segments(spark, d).select("job_id", "seg_ix", (F.col("n_words") % 17).alias("score"), ((F.col("job_id") + F.col("seg_ix")) % 6 == 0).alias("replaced"))
    return catalog.best(c.select("job_id", "seg_ix", "score"), c.where("replaced").select("job_id", "seg_ix"), "job_id", "seg_ix", "score")


@query(S.GAPS + ", s AS (SELECT job_id, seg_ix, gap_before, lag(text) OVER w AS p, text, lag(text) OVER w || ' ' || text AS two FROM gaps WINDOW w AS (PARTITION BY job_id ORDER BY seg_ix)) SELECT job_id, seg_ix, coalesce(right(rtrim(p), 1) = '?' AND gap_before < 200, false) AS answers, length(coalesce(two, text)) AS tail_chars FROM s")
def win8_win9_neighbours(spark, d):
    """Whether a segment answers the question before it; the length of the two-segment tail."""
    by = scenes.by_job()
    x = scenes.gaps(bridge.segments(spark, d)).withColumn("p", F.lag("text").over(by))
    return x.select("job_id", "seg_ix", F.coalesce((F.right(F.rtrim("p"), F.lit(1)) == "?") & (F.col("gap_before") < 200), F.lit(False)).alias("answers"), F.length(F.concat_ws(" ", "p", "text")).cast("long").alias("tail_chars"))


@query(S.CLIPS + S.SHOTS + ", e AS (SELECT c.*, s.start_cs AS ss, s.end_cs AS se, c.job_id % 2 = 0 AS comp FROM clips c JOIN (SELECT job_id, min(start_cs) AS start_cs, max(end_cs) AS end_cs FROM segments GROUP BY job_id) s ON s.job_id = c.job_id) SELECT job_id, clip_ix, greatest(0, lo - CASE WHEN comp THEN 1800 ELSE 3000 END, ss) AS context_start, least(hi + CASE WHEN comp THEN 2400 ELSE 3600 END, se) AS context_end FROM e")
def scr9_envelope(spark, d):
    segs = bridge.segments(spark, d)
    span = segs.groupBy("job_id").agg(F.min("start_cs").alias("scene_start"), F.max("end_cs").alias("scene_end"))
    x = clips(segs).withColumnsRenamed({"lo": "start_cs", "hi": "end_cs"}).join(span, "job_id").withColumn("structure", F.when(F.col("job_id") % 2 == 0, "compilation").otherwise("single-story"))
    return context.envelope(x).select("job_id", "clip_ix", "context_start", "context_end")


@query("SELECT sha256(concat_ws('|', CAST(event_id AS VARCHAR), event_type, CAST(CAST(floor(value * 1000) AS BIGINT) AS VARCHAR))) AS cache_key, event_id FROM events")
def mut7_cache_key(spark, d):
    key = F.sha2(F.concat_ws("|", F.col("event_id").cast("string"), "event_type", F.floor(F.col("value") * 1000).cast("long").cast("string")), 256)
    return _read(spark, d, "events").select(key.alias("cache_key"), "event_id")


@query("SELECT l_returnflag, l_linestatus, CAST(sum(l_quantity) AS DOUBLE) AS sum_qty, count(*) AS n FROM lineitem GROUP BY ALL")
def plain_lineitem_summary(spark, d):
    """Plain Spark over a star-schema table; the transcript engine has no operator of its own for it."""
    return _read(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").cast("double").alias("sum_qty"), F.count("*").alias("n"))


_PHRASES = S.CLIPS.replace("WITH x", "WITH RECURSIVE x") + r""", cw AS (SELECT c.job_id, clip_ix, w.seg_ix, word_ix, greatest(w.start_cs, lo) - lo AS a, least(w.end_cs, hi) - lo AS b, word FROM clips c JOIN words w ON w.job_id = c.job_id AND w.end_cs > lo AND w.start_cs < hi),
o AS (SELECT *, row_number() OVER (PARTITION BY job_id, clip_ix ORDER BY a, b, seg_ix, word_ix) AS k FROM cw), r AS (SELECT job_id, clip_ix, k, 0 AS phrase, 1 AS n, length(word) AS chars, a AS first, b AS last, word AS prev FROM o WHERE k = 1 UNION ALL
SELECT job_id, clip_ix, k, phrase + nw::INT, CASE WHEN nw THEN 1 ELSE n + 1 END, CASE WHEN nw THEN length(word) ELSE ch END, CASE WHEN nw THEN a ELSE first END, b, word FROM (SELECT *, a - last > 46 OR regexp_matches(prev, '[.!?]["'')\]]?$') OR (regexp_matches(prev, '[,;:]["'')\]]?$') AND a - last > 20 AND n >= 3) OR n + 1 > 5 OR ch > 31 OR b - first > 270 AS nw FROM
(SELECT r.job_id, r.clip_ix, o.k, r.phrase, r.n, r.first, r.last, r.prev, o.a, o.b, o.word, r.chars + length(o.word) + CASE WHEN regexp_matches(o.word, '^[,.;:!?%)}\]]') OR regexp_matches(r.prev, '[''’\-—(]$') THEN 0 ELSE 1 END AS ch FROM r JOIN o ON o.job_id = r.job_id AND o.clip_ix = r.clip_ix AND o.k = r.k + 1)))
SELECT job_id, clip_ix, phrase, count(*) AS n, min(a) AS start_cs, max(b) AS end_cs FROM r JOIN o USING (job_id, clip_ix, k) GROUP BY ALL"""


@query(_PHRASES)
def seq1_phrases(spark, d):
    from tidemark.operators import intervals

    segs = bridge.segments(spark, d)
    held = intervals.clamp(intervals.interval_join(clips(segs), bridge.words(segs), "job_id", "lo", "hi"), "lo", "hi")
    return captions.phrases(held, ["job_id", "clip_ix"]).groupBy("job_id", "clip_ix", "phrase").agg(F.count("*").alias("n"), F.min("rel_start").alias("start_cs"), F.max("rel_end").alias("end_cs"))


def _wrap_sql(x: str, words: int, chars: int) -> str:
    """Lines of a text, joined by line feeds."""
    last = "regexp_extract(a, '[^\\x0A]*$')"
    return f"list_reduce(list_filter(regexp_split_to_array({x}, '\\s+'), lambda w: w <> ''), lambda a, w: CASE WHEN len(string_split({last}, ' ')) < {words} AND length({last}) + 1 + length(w) <= {chars} THEN concat(a, ' ', w) ELSE concat(a, chr(10), w) END)"


@query(S.BRIDGE + f"SELECT job_id, seg_ix, CAST(i - 1 AS INTEGER) AS line_ix, l[i] AS line FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM (SELECT job_id, seg_ix, string_split({_wrap_sql('text', 8, 44)}, chr(10)) AS l FROM segments))")
def str21_wrap(spark, d):
    """Greedy caption lines of each segment."""
    return bridge.segments(spark, d).select("job_id", "seg_ix", F.posexplode(captions.wrapped(F.col("text"), 8, 44)).alias("line_ix", "line"))


@query(S.CLIPS + f""", h AS (SELECT c.job_id, clip_ix, seg_ix, lo / 100::DOUBLE AS lo, hi / 100::DOUBLE AS hi, greatest(0::DOUBLE, greatest(start_cs, lo) / 100::DOUBLE - lo / 100::DOUBLE + 0.12::DOUBLE) AS a, least(30::DOUBLE, least(end_cs, hi) / 100::DOUBLE - lo / 100::DOUBLE + 0.12::DOUBLE) AS b, string_split({_wrap_sql('text', 5, 31)}, chr(10)) AS l FROM clips c JOIN segments s ON s.job_id = c.job_id AND s.end_cs > lo AND s.start_cs < hi),
k AS (SELECT *, greatest(b - a, 0.2::DOUBLE) / len(l) AS step, unnest(range(0, len(l))) AS i FROM h WHERE b > a), c2 AS (SELECT *, a + i * step AS x, least(a + (i + 1) * step, 30::DOUBLE) AS y FROM k) SELECT job_id, clip_ix, seg_ix, CAST(i AS INTEGER) AS cue_ix, l[i + 1] AS cue, CAST(round(x * 1000) AS BIGINT) AS start_ms, CAST(round(y * 1000) AS BIGINT) AS end_ms FROM c2 WHERE y > x + 0.03::DOUBLE""")
def jn7_fallback_cues(spark, d):
    """Cues of segments without word times, in equal steps (JN-7)."""
    from tidemark.operators import intervals

    segs = bridge.segments(spark, d)
    sec = lambda c: F.col(c) / 100
    held = intervals.interval_join(clips(segs), segs, "job_id", "lo", "hi").select("job_id", "clip_ix", "seg_ix", sec("lo").alias("lo"), sec("hi").alias("hi"), sec("start_cs").alias("start"), sec("end_cs").alias("end"), "text")
    ms = lambda c: F.round(F.col(c) * 1000).cast("long")
    return captions.fallback_cues(held, 5, 31, 0.12).select("job_id", "clip_ix", "seg_ix", "cue_ix", "cue", ms("cue_start").alias("start_ms"), ms("cue_end").alias("end_ms"))


@query(S.BRIDGE + r""", t AS (SELECT job_id, seg_ix, string_agg(CASE WHEN word_ix % 5 = 3 THEN ', ' || word WHEN word_ix % 7 = 5 THEN word || ' -' ELSE word END, ' ' ORDER BY word_ix) AS x FROM words GROUP BY ALL) SELECT job_id, seg_ix, regexp_replace(regexp_replace(x, ' ([,.;:!?%)}\]])', '\1', 'g'), '([''’—(-]) ', '\1', 'g') AS joined FROM t""")
def str20_joined_words(spark, d):
    """Tokens joined without blanks before marks or after hyphens; marks are put in as tokens by place (STR-20)."""
    w = bridge.words(bridge.segments(spark, d))
    parts = F.when(F.col("word_ix") % 5 == 3, F.array(F.lit(","), F.col("word"))).when(F.col("word_ix") % 7 == 5, F.array(F.col("word"), F.lit("-"))).otherwise(F.array("word"))
    x = w.groupBy("job_id", "seg_ix").agg(F.array_sort(F.collect_list(F.struct("word_ix", parts.alias("p")))).alias("w"))
    return x.select("job_id", "seg_ix", captions.joined(F.flatten(F.transform("w", lambda x: x["p"]))).alias("joined"))


_BREAK = r"""SELECT job_id, seg_ix, CASE WHEN len(w) < 7 OR length(x) < 30 THEN x ELSE coalesce(list_sort(list_filter(list_transform(range(3, len(w) - 2), lambda k: {{'score': abs(length(array_to_string(w[1:k], ' ')) - length(array_to_string(w[k + 1:], ' '))) + CASE WHEN p[k] IN ({weak}) THEN 24 ELSE 0 END + CASE WHEN p[k + 1] IN ({second}) THEN 18 ELSE 0 END - CASE WHEN right(w[k], 1) IN (',', ';', ':') THEN 8 ELSE 0 END - CASE WHEN p[k + 1] IN ({good}) THEN 4 ELSE 0 END, 'k': k, 'a': array_to_string(w[1:k], ' '), 'b': array_to_string(w[k + 1:], ' ')}}), lambda r: length(r.a) <= 37 AND length(r.b) <= 37))[1].a || chr(10) || list_sort(list_filter(list_transform(range(3, len(w) - 2), lambda k: {{'score': abs(length(array_to_string(w[1:k], ' ')) - length(array_to_string(w[k + 1:], ' '))) + CASE WHEN p[k] IN ({weak}) THEN 24 ELSE 0 END + CASE WHEN p[k + 1] IN ({second}) THEN 18 ELSE 0 END - CASE WHEN right(w[k], 1) IN (',', ';', ':') THEN 8 ELSE 0 END - CASE WHEN p[k + 1] IN ({good}) THEN 4 ELSE 0 END, 'k': k, 'a': array_to_string(w[1:k], ' '), 'b': array_to_string(w[k + 1:], ' ')}}), lambda r: length(r.a) <= 37 AND length(r.b) <= 37))[1].b, x) END AS lines FROM t""".format(weak=", ".join(map(S.q, lx.WEAK_EDGES)), second=", ".join(map(S.q, lx.WEAK_SECOND_LINES)), good=", ".join(map(S.q, lx.GOOD_SECOND_LINES)))


@query(S.BRIDGE + f", s AS (SELECT job_id, seg_ix, {S.clean('left(text, 70)')} AS x FROM segments), t AS (SELECT *, string_split(x, ' ') AS w, list_transform(string_split(x, ' '), lambda v: lower(regexp_replace(v, '[^A-Za-z0-9'']+', '', 'g'))) AS p FROM s) " + _BREAK)
def str22_balanced_lines(spark, d):
    """The two balanced lines of a calm caption of up to 70 characters, the length of a caption phrase (STR-22)."""
    return bridge.segments(spark, d).select("job_id", "seg_ix", captions.balanced(F.left("text", F.lit(70)), "cinematic").alias("lines"))


_FACES = "WITH f AS (SELECT user_id, date_trunc('hour', ts) AS sampled, CAST(floor(value * 100) AS BIGINT) % 100 + 1 AS side, CAST(floor(value * 7) AS BIGINT) % 101 AS y FROM events), m AS (SELECT *, max(side * side) OVER (PARTITION BY user_id, sampled) AS top FROM f)"


@query(_FACES + ", c AS (SELECT user_id, sampled, count(*) AS n, sum(y * side * side) / greatest(1, sum(side * side))::DOUBLE / 100 + 0.0035::DOUBLE AS y FROM m WHERE side * side >= top * 0.35::DOUBLE GROUP BY user_id, sampled) SELECT user_id, sampled, n AS important, CAST(round(y * 1000000) AS BIGINT) AS y_ppm, CASE WHEN y < 0.38::DOUBLE THEN 'upper' WHEN y < 0.68::DOUBLE THEN 'middle' ELSE 'lower' END AS band FROM c")
def agg16_face_centroid(spark, d):
    """The height of the faces of a sample, weighed by area, without faces much smaller than the largest (AGG-16)."""
    e = _read(spark, d, "events").select("user_id", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("sampled"), (F.floor(F.col("value") * 100).cast("long") % 100 + 1).alias("side"), (F.floor(F.col("value") * 7).cast("long") % 101 / 100 + 0.0035).alias("y"))
    x = tracks.face_bands(e.withColumn("area", F.col("side") * F.col("side")), ["user_id", "sampled"])
    return x.select("user_id", "sampled", "important", F.round(F.col("center_y") * 1000000).cast("long").alias("y_ppm"), "band")


@query(_SAMPLES.replace("WITH e", "WITH RECURSIVE e") + f""", g AS (SELECT *, track_id * 1000 + sum(CASE WHEN event_type = 'error' AND value > 9 THEN 1 ELSE 0 END) OVER (PARTITION BY track_id ORDER BY k) AS shot FROM samples), n AS (SELECT *, row_number() OVER (PARTITION BY shot ORDER BY k) AS j FROM g), r AS (SELECT track_id, shot, k, j, t, {_CLIP('c')} AS cam, 0 AS o FROM n WHERE j = 1 UNION ALL
SELECT track_id, shot, k, j, t, CASE WHEN mv THEN ncam ELSE cam END, CASE WHEN mv AND abs(tg - ncam) <= 0.075 THEN 0 ELSE o2 END FROM (SELECT *, abs(dd) > 0.075 AND (o2 >= 2 OR abs(dd) >= 0.155) AND abs(w) >= 0.018 AS mv, {_CLIP('cam + least(mx, greatest(-mx, w))')} AS ncam FROM (SELECT *, CASE WHEN abs(dd) <= 0.075 THEN 0 ELSE o + 1 END AS o2, {_CLIP('tg - CASE WHEN dd > 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END * 0.05::DOUBLE')} - cam AS w FROM
(SELECT s.track_id, s.shot, s.k, s.j, s.t, r.cam, r.o, {_CLIP('s.c')} AS tg, {_CLIP('s.c')} - r.cam AS dd, 0.16::DOUBLE * greatest(0.001::DOUBLE, s.t - r.t) AS mx FROM r JOIN n s ON s.shot = r.shot AND s.j = r.j + 1))))
SELECT track_id, CAST(k AS INTEGER) AS k, CAST(round(cam * 1000000) AS BIGINT) AS camera_ppm FROM r""")
def seq4_scene_reset(spark, d):
    """The camera begins anew in each shot of a track (SEQ-4)."""
    cut = F.sum(F.when((F.col("event_type") == "error") & (F.col("value") > 9), 1).otherwise(0)).over(Window.partitionBy("track_id").orderBy("k"))
    x = tracks.stabilise(_samples(spark, d).withColumn("shot", F.col("track_id") * 1000 + cut), "shot")
    return x.select(F.floor(F.col("shot") / 1000).cast("long").alias("track_id"), (F.col("t") * 2).cast("int").alias("k"), F.round(F.col("camera") * 1000000).cast("long").alias("camera_ppm"))


@query("WITH e AS (SELECT user_id, ts, event_id, event_type, CAST(floor(value * 11) AS BIGINT) - 20 AS p FROM events), l AS (SELECT user_id, arg_max(event_type, {'ts': ts, 'event_id': event_id}) AS s, arg_max(p, {'ts': ts, 'event_id': event_id}) AS p, max(ts) AS ts, bool_or(event_type = 'error' AND p > 100) AS stop FROM e GROUP BY user_id) SELECT user_id, CASE WHEN stop THEN 'cancelled' WHEN s = 'error' THEN 'failed' WHEN s = 'purchase' THEN 'completed' ELSE 'running' END AS status, CASE WHEN s = 'purchase' AND NOT stop THEN 100 ELSE greatest(0, least(100, p)) END AS progress, ts FROM l")
def mut5_task_lifecycle(spark, d):
    """The state of each task after its events: clamped progress, failures, a cancel that was asked for (MUT-5, STM-3)."""
    p = (F.floor(F.col("value") * 11) - 20).cast("long")
    e = _read(spark, d, "events").select("user_id", "ts", "event_id", F.col("event_type").alias("kind"), p.alias("progress"), ((F.col("event_type") == "error") & (p > 100)).alias("cancel"))
    return catalog.task_states(e, "user_id", "ts", "event_id", failed="error", done="purchase").select("user_id", "status", "progress", "ts")
