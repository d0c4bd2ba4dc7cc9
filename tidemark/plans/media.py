"""Queries over media facts, layouts and processing rules, on rows derived from the event stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import lexicon as lx
from tidemark.operators import layouts, media
from tidemark.plans import sqltext as S
from tidemark.plans.transcript import query

_MODES = ("face", "speaker", "motion", "saliency", "portrait", "static")
_CONTENTS = ("anime", "Film", "gameplay", "documentary-educational", "meme", "podcast", "other")
_ASKED = ("auto", "fill", " Preserve ", "nonsense", "auto", "auto", "auto", "auto", "auto", "backdrop")
_STYLES = ("auto", "meme", "auto", "clean", "auto", "loud", "auto")
_SIZES = ("auto", "Immersive", "auto", "auto", "tiny")
_SOURCES = ((1920, 1080), (1080, 1920), (640, 480), (0, 0), (2560, 1080))


def _pick(values, by: str):
    return F.element_at(F.array(*map(F.lit, values)), (F.col(by) % len(values) + 1).cast("int"))


def _stats(spark, d: str) -> DataFrame:
    """Tracking statistics of a clip for each user and day of the stream."""
    e = spark.read.parquet(f"{d}/events.parquet").select("user_id", F.date_trunc("day", F.col("ts").cast("timestamp_ntz")).cast("date").alias("day"), "event_type", "value", "event_id")
    n = lambda *kinds: F.count_if(F.col("event_type").isin(*kinds)).cast("int")
    x = e.groupBy("user_id", "day").agg(
        F.count("*").cast("int").alias("sample_count"), n("view", "click").alias("face"), F.count_if((F.col("event_type") == "error") & (F.col("value") > 5)).cast("int").alias("multi"), F.count_if((F.col("event_type") == "signup") & (F.col("value") > 12)).cast("int").alias("cuts"),
        n("purchase").alias("subtitle"), F.count_if((F.col("event_type") == "view") & (F.col("value") < 3)).cast("int").alias("face_upper"), n("click").alias("face_middle"), F.count_if((F.col("event_type") == "view") & (F.col("value") >= 3)).cast("int").alias("face_lower"),
        n("signup").alias("speaker"), F.count_if((F.col("event_type") == "signup") & (F.col("value") < 4)).cast("int").alias("switches"), F.min("event_id").alias("k"),
    )
    x = x.withColumns({"mode": _pick(_MODES, "k"), "content_type": _pick(_CONTENTS, "user_id"), "asked": _pick(_ASKED, "k"), "style_asked": _pick(_STYLES, "k"), "size_asked": _pick(_SIZES, "k")})
    return x.withColumns({"source_width": _pick([w for w, _ in _SOURCES], "k"), "source_height": _pick([h for _, h in _SOURCES], "k")})


def _sql_pick(values, by: str) -> str:
    return "[" + ", ".join(S.q(v) if isinstance(v, str) else str(v) for v in values) + f"][{by} % {len(values)} + 1]"


_STATS = f"""WITH g AS (SELECT user_id, CAST(date_trunc('day', ts) AS DATE) AS day, CAST(count(*) AS INTEGER) AS n, CAST(count(*) FILTER (event_type IN ('view', 'click')) AS INTEGER) AS face, CAST(count(*) FILTER (event_type = 'error' AND value > 5) AS INTEGER) AS multi, CAST(count(*) FILTER (event_type = 'signup' AND value > 12) AS INTEGER) AS cuts,
 CAST(count(*) FILTER (event_type = 'purchase') AS INTEGER) AS subtitle, count(*) FILTER (event_type = 'view' AND value < 3) AS up, count(*) FILTER (event_type = 'click') AS mid, count(*) FILTER (event_type = 'view' AND value >= 3) AS low, count(*) FILTER (event_type = 'signup') AS speaker, count(*) FILTER (event_type = 'signup' AND value < 4) AS switches, min(event_id) AS k FROM events GROUP BY ALL),
p AS (SELECT *, face / n::DOUBLE AS fr, multi / n::DOUBLE AS mr, cuts / n::DOUBLE AS cr, subtitle / n::DOUBLE AS sr, subtitle >= 2 AND subtitle / n::DOUBLE >= 0.24::DOUBLE AS likely, {_sql_pick(_MODES, 'k')} AS mode, lower(trim({_sql_pick(_CONTENTS, 'user_id')})) AS raw, lower(trim({_sql_pick(_ASKED, 'k')})) AS asked, lower(trim({_sql_pick(_STYLES, 'k')})) AS sa, lower(trim({_sql_pick(_SIZES, 'k')})) AS za, {_sql_pick([w for w, _ in _SOURCES], 'k')} AS sw, {_sql_pick([h for _, h in _SOURCES], 'k')} AS sh FROM g),
c AS (SELECT *, CASE raw WHEN 'anime-animation' THEN 'anime' WHEN 'film' THEN 'film-tv' WHEN 'tv' THEN 'film-tv' WHEN 'podcast-interview' THEN 'podcast' WHEN 'documentary-educational' THEN 'documentary' WHEN 'meme' THEN 'meme-comedy' WHEN 'comedy' THEN 'meme-comedy' WHEN 'gameplay-commentary' THEN 'gameplay' ELSE raw END AS kind FROM p),
l AS (SELECT *, CASE WHEN asked IN ('fill', 'focus', 'backdrop', 'preserve') THEN asked WHEN mode = 'portrait' THEN 'preserve' WHEN kind = 'anime' THEN 'focus' WHEN kind = 'film-tv' THEN 'focus' WHEN kind = 'gameplay' AND cr < 0.16::DOUBLE THEN 'backdrop' WHEN mode IN ('face', 'speaker') AND fr >= 0.42::DOUBLE AND mr < 0.14::DOUBLE AND cr < 0.10::DOUBLE THEN 'fill' WHEN mr >= 0.10::DOUBLE OR cr >= 0.10::DOUBLE THEN 'focus' WHEN mode IN ('motion', 'saliency') THEN 'backdrop' ELSE 'focus' END AS layout FROM c),
s AS (SELECT *, CASE WHEN sa = 'meme' THEN 'viral' WHEN sa IN ('viral', 'cinematic', 'clean') THEN sa WHEN kind IN ('anime', 'film-tv') THEN 'cinematic' WHEN kind = 'meme-comedy' THEN 'viral' WHEN kind = 'documentary' THEN 'clean' WHEN layout = 'fill' AND mode IN ('face', 'speaker') THEN 'viral' WHEN layout = 'backdrop' AND mode IN ('motion', 'saliency') THEN CASE WHEN kind = 'gameplay' THEN 'viral' ELSE 'clean' END WHEN layout = 'preserve' THEN 'clean' WHEN layout = 'focus' THEN 'cinematic' ELSE 'clean' END AS style,
 CASE WHEN za IN ('compact', 'balanced', 'immersive') THEN za WHEN layout NOT IN ('focus', 'backdrop') THEN 'balanced' WHEN kind IN ('anime', 'film-tv') THEN 'compact' WHEN mr >= 0.16::DOUBLE OR cr >= 0.14::DOUBLE THEN 'compact' ELSE 'balanced' END AS size FROM l)"""


def _decided(spark, d: str) -> DataFrame:
    x = _stats(spark, d).withColumn("kind", layouts.content(F.col("content_type")))
    x = x.withColumn("layout", layouts.layout(F.col("asked"), F.col("kind")))
    return x.withColumn("style", layouts.caption_style(F.col("style_asked"), F.col("kind"), F.col("layout"))).withColumn("size", layouts.frame_size(F.col("size_asked"), F.col("kind"), F.col("layout")))


@query(_STATS + """, z AS (SELECT *, up + mid + low AS total, CASE WHEN kind = 'anime' AND NOT likely THEN 0.24::DOUBLE ELSE 0.18::DOUBLE END AS step, CASE WHEN likely THEN ['middle', 'upper', 'lower'] WHEN style = 'viral' THEN ['middle', 'lower', 'upper'] ELSE ['lower', 'middle', 'upper'] END AS pref FROM s),
b AS (SELECT *, list_sort(list_transform(pref, lambda b, i: {'cost': CASE b WHEN 'upper' THEN up WHEN 'middle' THEN mid ELSE low END / nullif(total, 0)::DOUBLE + (i - 1) * step, 'i': i, 'band': b})) AS costs FROM z)
SELECT user_id, day, kind, layout, style, size, CASE WHEN kind = 'anime' AND style = 'cinematic' AND layout = 'focus' THEN 'lower' WHEN total = 0 THEN pref[1] ELSE costs[1].band END AS zone,
 CASE WHEN kind = 'anime' AND style = 'cinematic' THEN 'Anime · cinematic' WHEN kind = 'film-tv' AND style = 'cinematic' THEN 'Film / TV · cinematic' WHEN layout = 'preserve' THEN 'Full composition' WHEN mode = 'speaker' AND speaker > 0 AND switches > 0 THEN 'Active-speaker dialogue' WHEN mode = 'speaker' AND speaker > 0 THEN 'Speaker-aware dialogue' WHEN layout = 'fill' AND mode = 'face' THEN 'Talking head' WHEN layout = 'focus' AND (multi > 0 OR cuts > 0) THEN 'Cinematic / group scene' WHEN layout = 'backdrop' AND mode IN ('motion', 'saliency') THEN 'Visual / gameplay' WHEN style = 'cinematic' THEN 'Wide dialogue scene' ELSE 'Wide / contextual footage' END AS profile FROM b""")
def sel4_layout_decisions(spark, d):
    """Layout, caption style, frame size, caption zone and profile of each clip (SEL-4, FLT-2, FLT-19)."""
    k, p = F.col("kind"), F.col("layout")
    return _decided(spark, d).select("user_id", "day", "kind", "layout", "style", "size", layouts.zone(F.col("style"), k, p).alias("zone"), layouts.profile(F.col("style"), k, p).alias("profile"))


@query(_STATS + """, w AS (SELECT *, least(720::DOUBLE / nullif(sw, 0), 1280::DOUBLE / nullif(sh, 0)) AS scale FROM s), v AS (SELECT user_id, day, layout, size, CAST(CASE WHEN layout = 'preserve' AND sw > 0 AND sh > 0 THEN greatest(1, least(720, round_even(sw * scale, 0))) ELSE 720 END AS INTEGER) AS w, CAST(CASE WHEN layout IN ('focus', 'backdrop') THEN CASE size WHEN 'compact' THEN 800 WHEN 'immersive' THEN 1040 ELSE 900 END WHEN layout = 'preserve' AND sw > 0 AND sh > 0 THEN greatest(1, least(1280, round_even(sh * scale, 0))) ELSE 1280 END AS INTEGER) AS h FROM w)
SELECT user_id, day, CAST((720 - w) // 2 AS INTEGER) AS x, CAST((1280 - h) // 2 AS INTEGER) AS y, w, h FROM v""")
def mth7_picture_window(spark, d):
    return _decided(spark, d).select("user_id", "day", layouts.picture_window(F.col("layout"), F.col("size")).alias("p")).select("user_id", "day", "p.*")


@query(_STATS + " SELECT user_id, day, CAST(round(fr * 1000000) AS BIGINT) AS face_ppm, CAST(round(mr * 1000000) AS BIGINT) AS multi_ppm, CAST(round(cr * 1000000) AS BIGINT) AS cut_ppm, CAST(round(sr * 1000000) AS BIGINT) AS subtitle_ppm, likely FROM s")
def agg10_plan_ratios(spark, d):
    """All four ratios of a clip's samples and whether burned-in subtitles are likely (AGG-10)."""
    ppm = lambda c: F.round(layouts.ratio(c) * 1000000).cast("long")
    return _stats(spark, d).select("user_id", "day", ppm("face").alias("face_ppm"), ppm("multi").alias("multi_ppm"), ppm("cuts").alias("cut_ppm"), ppm("subtitle").alias("subtitle_ppm"), layouts.subtitles_likely().alias("likely"))


_LANGS = ("jpn", "en-US", "eng", "", "pt_BR", "GER", "xx-yy", "zh")
_NAMES = ("English Dub", "Main", "eng dub 5.1", "Commentary", "")


def _probes(spark, d: str) -> DataFrame:
    """A probe document for each event: a video stream (not always), one to three audio streams."""
    e = spark.read.parquet(f"{d}/events.parquet").select("event_id", (F.col("event_id") % 97).alias("m"))
    audio = F.array_join(F.transform(F.sequence(F.lit(1).cast("long"), F.col("m") % 3 + 1), lambda i: F.format_string('{"index": %d, "codec_type": "audio", "codec_name": "%s", "channels": 2, "tags": {"language": "%s", "title": "%s"}, "disposition": {"default": %d}}', i, F.when(F.col("m") % 4 == 0, "flac").otherwise("aac"), F.element_at(F.array(*map(F.lit, _LANGS)), ((F.col("m") + i) % len(_LANGS) + 1).cast("int")), F.element_at(F.array(*map(F.lit, _NAMES)), ((F.col("m") * 3 + i) % len(_NAMES) + 1).cast("int")), F.when(i == F.col("m") % 4, 1).otherwise(0))), ", ")
    video = F.when(F.col("m") % 11 != 0, F.format_string('{"index": 0, "codec_type": "video", "codec_name": "%s", "width": %d, "height": 1080, "avg_frame_rate": "%d/%d", "tags": {"rotate": "%d"}, "side_data_list": [{"rotation": %d}]}, ', F.when(F.col("m") % 5 == 0, "vp9").otherwise("h264"), 640 + F.col("m"), F.col("m") * 1000, F.col("m") % 3 * 1001, F.col("m") % 2 * 90, F.col("m") % 3 * -90)).otherwise("")
    json = F.format_string('{"format": {"format_name": "mov,mp4", "duration": "%d.5"}, "streams": [%s%s]}', "m", video, audio)
    return e.select("event_id", json.alias("probe"), F.format_string("clip%d%s", "m", F.element_at(F.array(*map(F.lit, (".mp4", ".MKV", ".mov", ""))), (F.col("m") % 4 + 1).cast("int"))).alias("path"))


_PROBES = f"""WITH e AS (SELECT event_id, event_id % 97 AS m FROM events), a AS (SELECT event_id, m, i, {S.listed(_LANGS)}[(m + i) % {len(_LANGS)} + 1] AS lang, {S.listed(_NAMES)}[(m * 3 + i) % {len(_NAMES)} + 1] AS title, i = m % 4 AS dflt FROM (SELECT *, unnest(generate_series(1, m % 3 + 1)) AS i FROM e)),
c AS (SELECT *, replace(lower(trim(lang)), '_', '-') AS raw FROM a), t AS (SELECT *, coalesce(MAP {{{', '.join(f"{S.q(k)}: {S.q(v)}" for k, v in lx.LANGUAGE_ALIASES.items())}}}[raw], split_part(raw, '-', 1)) AS code FROM c),
g AS (SELECT event_id, m, CAST(count(*) AS INTEGER) AS audio_streams, CAST(coalesce(min(i) FILTER (dflt), 1) AS INTEGER) AS default_audio_track, CAST(coalesce(min(i) FILTER (code = 'en' OR contains(lower(title), 'english') OR contains(lower(title), 'eng dub')), min(i) FILTER (dflt), 1) AS INTEGER) AS chosen_track, string_agg(code, ',' ORDER BY i) AS codes FROM t GROUP BY ALL),
v AS (SELECT *, m % 11 <> 0 AS has_video, CASE WHEN m % 11 = 0 OR m % 3 = 0 THEN 0::DOUBLE ELSE m * 1000 / (m % 3 * 1001)::DOUBLE END AS fps, CASE WHEN m % 11 = 0 THEN 0 ELSE CAST(m % 3 * -90 AS INTEGER) END AS rotation, CASE WHEN m % 11 = 0 THEN NULL WHEN m % 5 = 0 THEN 'vp9' ELSE 'h264' END AS video_codec, CASE WHEN m % 4 = 0 THEN 'flac' ELSE 'aac' END AS audio_codec FROM g)"""


@query(_PROBES + " SELECT event_id, m + 0.5::DOUBLE AS duration, has_video, video_codec, audio_codec, CAST(CASE WHEN has_video THEN 640 + m ELSE 0 END AS INTEGER) AS width, CAST(round(fps * 1000) AS BIGINT) AS fps_milli, rotation, audio_streams, default_audio_track, chosen_track, codes FROM v")
def src6_probe_rows(spark, d):
    """Media rows from probe documents, and the audio track chosen for English (SRC-6, FLT-6, FLT-2)."""
    x = media.probed(_probes(spark, d))
    codes = F.array_join(F.transform("audio_tracks", lambda t: media.language(t["language"])), ",")
    return x.select("event_id", "duration", "has_video", "video_codec", "audio_codec", "width", F.round(F.col("fps") * 1000).cast("long").alias("fps_milli"), "rotation", "audio_streams", "default_audio_track", media.english_track(F.col("audio_tracks"), F.col("default_audio_track")).alias("chosen_track"), codes.alias("codes"))


@query(_PROBES + " SELECT event_id, concat_ws(', ', CASE WHEN m % 4 NOT IN (0, 2) THEN 'container' END, CASE WHEN video_codec IS NULL OR video_codec <> 'h264' THEN 'video codec' END, CASE WHEN audio_codec <> 'aac' THEN 'audio codec' END, CASE WHEN fps <> 0 AND (fps < 20 OR fps > 61) THEN 'frame rate' END, CASE WHEN rotation % 360 <> 0 THEN 'rotation metadata' END) AS reasons FROM v")
def flt5_normalise_reasons(spark, d):
    return media.probed(_probes(spark, d)).select("event_id", F.array_join(media.normalise_reasons(F.col("path")), ", ").alias("reasons"))


_HINT = r"left(trim(regexp_replace(text, '\s+', ' ', 'g'), ' .,_-'), 160)"


@query(rf"""WITH h AS (SELECT doc_id, coalesce({_HINT}, '') AS hint FROM documents), w AS (SELECT doc_id, hint, list_filter(regexp_extract_all(hint, '[A-Za-z0-9][A-Za-z0-9''’.-]{{2,}}', 0), lambda x: lower(x) NOT IN ('the', 'and', 'for', 'with', 'from')) AS l FROM h),
p AS (SELECT *, list_filter(list_transform(l, lambda x, i: CASE WHEN list_position(list_transform(list_concat([hint], l), lambda y: lower(y)), lower(x)) < i + 1 THEN NULL ELSE x END), lambda x: x IS NOT NULL) AS k FROM w)
SELECT doc_id, hint AS speech_hint, CASE WHEN hint <> '' THEN left(hint, 120) || '.' END AS prompt, CASE WHEN hint <> '' THEN left(array_to_string(list_concat([hint], k), ', '), 220) END AS hotwords FROM p""")
def flt3_speech_hints(spark, d):
    """Trusted hints, prompts and hot words for speech (FLT-3), from the texts."""
    c, hint = F.col("text"), media.speech_hint(F.col("text"))
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", hint.alias("speech_hint"), F.when(hint != "", F.concat(F.left(hint, F.lit(120)), F.lit("."))).alias("prompt"), media.hotwords(c).alias("hotwords"))


_ERRORS = ("Unable to allocate 141 MiB for an array", "connection refused", "std::bad_alloc", "Out of memory: killed", "file not found", "MKL_malloc failed")


@query(f"SELECT event_id, m AS message, regexp_matches(lower(m), 'unable to allocate|cannot allocate memory|failed to allocate memory|mkl_malloc|bad_alloc|bad allocation|not enough memory|out of memory') AS memory FROM (SELECT event_id, {_sql_pick(_ERRORS, 'event_id')} AS m FROM events)")
def flt16_memory_errors(spark, d):
    x = spark.read.parquet(f"{d}/events.parquet").select("event_id", _pick(_ERRORS, "event_id").alias("message"))
    return x.withColumn("memory", media.memory_error(F.col("message")))


_PROFILE_NAMES = ("low-memory", "Balanced ", "fast", "turbo")


@query(f"""WITH e AS (SELECT event_id, event_id % 5000 AS duration, coalesce(nullif(CASE WHEN lower(trim(p)) IN ('low-memory', 'balanced', 'fast') THEN lower(trim(p)) END, ''), 'balanced') AS profile FROM (SELECT event_id, {_sql_pick(_PROFILE_NAMES, 'event_id')} AS p FROM events)),
b AS (SELECT *, CASE profile WHEN 'low-memory' THEN 180 WHEN 'balanced' THEN 300 ELSE 600 END AS c, CASE profile WHEN 'low-memory' THEN 2 WHEN 'balanced' THEN 4 ELSE 6 END AS threads FROM e), l AS (SELECT *, CASE WHEN duration >= 1800 THEN least(c, CASE WHEN profile = 'fast' THEN 480 ELSE 300 END) ELSE c END AS c1 FROM b)
SELECT event_id, profile, threads, CASE WHEN duration >= 2700 THEN least(c1, CASE profile WHEN 'low-memory' THEN 120 WHEN 'balanced' THEN 180 ELSE 300 END) ELSE c1 END AS chunk_seconds FROM l""")
def mth10_chunk_policy(spark, d):
    """Profiles by name and chunk lengths by source length (MTH-10, MTH-11)."""
    x = spark.read.parquet(f"{d}/events.parquet").select("event_id", (F.col("event_id") % 5000).alias("duration"), media.profile(_pick(_PROFILE_NAMES, "event_id")).alias("p"))
    return x.select("event_id", F.col("p.name").alias("profile"), "p.threads", media.chunk_seconds(F.col("duration"), F.col("p")).alias("chunk_seconds"))


@query("""WITH e AS (SELECT user_id, event_id, ts, CAST(floor(value * 4) AS BIGINT) + 1 AS took FROM events), r AS (SELECT *, row_number() OVER w AS k, sum(took) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s, count(*) OVER (PARTITION BY user_id) AS n FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, CAST(round_even(s / k::DOUBLE * (n - k), 0) AS INTEGER) AS sec FROM r), m AS (SELECT *, greatest(1, CAST(round_even(sec / 60::DOUBLE, 0) AS INTEGER)) AS mins FROM s) SELECT user_id, event_id, CASE WHEN sec < 60 THEN format('about {} sec remaining', greatest(1, sec)) WHEN mins < 60 THEN format('about {} min remaining', mins) WHEN mins % 60 > 0 THEN format('about {} hr {} min remaining', mins // 60, mins % 60) ELSE format('about {} hr remaining', mins // 60) END AS eta FROM m""")
def agg13_chunk_eta(spark, d):
    """The remaining time after each chunk, from the running mean of the chunks so far (AGG-13)."""
    e = spark.read.parquet(f"{d}/events.parquet").select("user_id", "event_id", "ts", (F.floor(F.col("value") * 4) + 1).alias("took"))
    by = Window.partitionBy("user_id").orderBy("ts", "event_id")
    run = by.rowsBetween(Window.unboundedPreceding, 0)
    left = F.count("*").over(Window.partitionBy("user_id")) - F.row_number().over(by)
    return e.select("user_id", "event_id", media.remaining(F.sum("took").over(run) / F.count("*").over(run) * left).alias("eta"))


@query("""WITH x AS (SELECT l_orderkey, l_linenumber, CAST(floor(l_extendedprice * 100 * (1 + l_linenumber * l_linenumber * l_linenumber * 40)) AS BIGINT) AS b, CAST(floor(l_extendedprice) AS BIGINT) AS s FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN b < 1048576 THEN format('{} KB', greatest(1, CAST(floor(b / 1024::DOUBLE + 0.5::DOUBLE) AS BIGINT))) WHEN b < 1073741824 THEN format('{:.1f} MB', b / 1048576::DOUBLE) ELSE format('{:.2f} GB', b / 1073741824::DOUBLE) END AS size, CASE WHEN s >= 3600 THEN format('{}:{:02d}:{:02d}', s // 3600, s % 3600 // 60, s % 60) ELSE format('{}:{:02d}', s // 60, s % 60) END AS clock FROM x""")
def str28_labels(spark, d):
    """Sizes and times as labels (STR-28)."""
    x = spark.read.parquet(f"{d}/lineitem.parquet")
    cube = F.col("l_linenumber") * F.col("l_linenumber") * F.col("l_linenumber") * 40 + 1
    return x.select("l_orderkey", "l_linenumber", media.human_bytes(F.floor(F.col("l_extendedprice") * 100 * cube).cast("long")).alias("size"), media.clock(F.floor("l_extendedprice")).alias("clock"))
