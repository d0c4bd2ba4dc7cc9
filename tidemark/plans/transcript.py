"""Queries over segments and words: joins, windows, scenes, texts, scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import lexicon as lx
from tidemark.functions import text as T
from tidemark.operators import intervals, ranking, scenes
from tidemark.plans import sqltext as S
from tidemark.sources import bridge

QUERIES: dict = {}
ORACLE: dict = {}


def query(sql: str | None = None):
    """Registers a function of (spark, sf_dir) under its name, with its DuckDB statement."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return keep


def clips(segs: DataFrame) -> DataFrame:
    """Clips of 30 s, one in each 45 s of a job."""
    last = segs.groupBy("job_id").agg(F.max("end_cs").alias("m"))
    x = last.select("job_id", F.explode(F.sequence(F.lit(0), (F.col("m") / 4500).cast("int"))).alias("clip_ix"))
    return x.select("job_id", "clip_ix", (F.col("clip_ix").cast("long") * 4500).alias("lo"), (F.col("clip_ix").cast("long") * 4500 + 3000).alias("hi"))


def shots(segs: DataFrame) -> DataFrame:
    """A cut every 7.3 s."""
    last = segs.groupBy("job_id").agg(F.max("end_cs").alias("m")).where("m >= 730")
    return last.select("job_id", F.explode(F.sequence(F.lit(730).cast("long"), F.col("m").cast("long"), F.lit(730).cast("long"))).alias("cut_cs"))


@query(S.BRIDGE + "SELECT job_id, seg_ix, start_cs, end_cs, n_words, text FROM segments")
def bridge_segments(spark: SparkSession, d: str) -> DataFrame:
    return bridge.segments(spark, d).drop("plain")


@query(S.BRIDGE + "SELECT * FROM words")
def bridge_words(spark, d):
    return bridge.words(bridge.segments(spark, d))


@query(S.GAPS + "SELECT job_id, seg_ix, gap_before, gap_after FROM gaps")
def win1_gaps(spark, d):
    return scenes.gaps(bridge.segments(spark, d)).select("job_id", "seg_ix", "gap_before", "gap_after")


_SHIFT = S.GAPS + f""", toks AS (SELECT *, {S.topic('text')} AS t FROM gaps),
sides AS (SELECT *, list_distinct(flatten(coalesce(list(t) OVER (PARTITION BY job_id ORDER BY seg_ix ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING), []))) AS l, list_distinct(flatten(list(t) OVER (PARTITION BY job_id ORDER BY seg_ix ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING))) AS r FROM toks),
shifts AS (SELECT *, len(l) >= 3 AND len(r) >= 3 AND {S.jaccard('l', 'r')} < 0.09 AS shift FROM sides)"""


@query(_SHIFT + "SELECT job_id, seg_ix, shift FROM shifts")
def win2_topic_shift(spark, d):
    return scenes.topic_shifts(bridge.segments(spark, d)).select("job_id", "seg_ix", "shift")


_SCENES = _SHIFT + S.SHOTS + r""", shot AS (SELECT s.*, EXISTS (SELECT 1 FROM shots h WHERE h.job_id = s.job_id AND abs(s.start_cs - h.cut_cs) <= 150) AS shot, s.job_id % 2 = 0 AS comp, regexp_matches(lower(text), '\b(next (clip|one|scene)|meanwhile|back to)\b') AS cue FROM shifts s),
why AS (SELECT *, CASE WHEN seg_ix = 0 THEN NULL WHEN gap_before >= CASE WHEN comp THEN 220 ELSE 350 END THEN 'long pause' WHEN comp AND (cue OR (gap_before >= 80 AND shift)) THEN 'local topic change' WHEN gap_before >= 120 AND shift THEN 'topic change' WHEN shot AND gap_before >= 50 AND (shift OR gap_before >= 120) THEN 'shot change' END AS why FROM shot),
placed AS (SELECT *, CAST(count(why) OVER (PARTITION BY job_id ORDER BY seg_ix) AS INTEGER) AS scene_id, lead(why) OVER (PARTITION BY job_id ORDER BY seg_ix) AS nxt FROM why),
scenes AS (SELECT job_id, scene_id, min(seg_ix) AS first_ix, max(seg_ix) AS last_ix, arg_min(start_cs, seg_ix) AS start_cs, arg_max(end_cs, seg_ix) AS end_cs, coalesce(arg_max(coalesce(nxt, ''), seg_ix), '') AS b FROM placed GROUP BY job_id, scene_id)"""


def _scenes(spark, d) -> DataFrame:
    segs = bridge.segments(spark, d)
    return scenes.scenes(segs.withColumn("compilation", F.col("job_id") % 2 == 0), shots(segs))


@query(_SCENES + "SELECT job_id, scene_id, first_ix, last_ix, start_cs, end_cs, CASE b WHEN '' THEN 'end of source' ELSE b END AS boundary FROM scenes")
def win3_scenes(spark, d):
    return _scenes(spark, d)


@query(_SCENES + "SELECT job_id, arg_max(scene_id, (end_cs - start_cs) * 100000 - scene_id) AS longest, max(end_cs - start_cs) AS length_cs FROM scenes GROUP BY job_id")
def agg11_longest_scene(spark, d):
    length = F.col("end_cs") - F.col("start_cs")
    return _scenes(spark, d).groupBy("job_id").agg(F.max_by("scene_id", F.struct(length, -F.col("scene_id"))).alias("longest"), F.max(length).alias("length_cs"))


@query(S.CLIPS + "SELECT c.job_id, clip_ix, string_agg(trim(text), ' ' ORDER BY seg_ix) AS dialogue FROM clips c JOIN segments s ON s.job_id = c.job_id AND s.end_cs > lo AND s.start_cs < hi AND trim(text) <> '' GROUP BY c.job_id, clip_ix")
def jn1_dialogue(spark, d):
    segs = bridge.segments(spark, d)
    x = intervals.interval_join(clips(segs), segs.where("trim(text) <> ''").withColumn("text", F.trim("text")), "job_id", "lo", "hi")
    return intervals.in_order(["job_id", "clip_ix"], "text", ["seg_ix"], " ", "dialogue")(x)


@query(S.CLIPS + "SELECT c.job_id, clip_ix, seg_ix FROM clips c JOIN segments s ON s.job_id = c.job_id AND s.end_cs >= lo AND s.start_cs <= hi")
def jn2_range(spark, d):
    segs = bridge.segments(spark, d)
    return intervals.interval_join(clips(segs), segs, "job_id", "lo", "hi", closed=True).select("job_id", "clip_ix", "seg_ix")


@query(S.CLIPS + "SELECT c.job_id, clip_ix, seg_ix FROM clips c JOIN segments s ON s.job_id = c.job_id AND s.end_cs >= lo AND s.start_cs <= hi")
def jn2_range_bucketed(spark, d):
    segs = bridge.segments(spark, d)
    return intervals.bucketed_interval_join(clips(segs), segs, "job_id", "lo", "hi", 6000, closed=True).select("job_id", "clip_ix", "seg_ix")


@query(S.CLIPS + """SELECT job_id, clip_ix, seg_ix, word_ix, a AS rel_start, b AS rel_end, word FROM (SELECT c.job_id, clip_ix, w.seg_ix, word_ix, greatest(w.start_cs, lo) - lo AS a, least(w.end_cs, hi) - lo AS b, word, pct FROM clips c JOIN segments s ON s.job_id = c.job_id AND s.end_cs > lo AND s.start_cs < hi JOIN words w ON w.job_id = s.job_id AND w.seg_ix = s.seg_ix)
WHERE b > a + 1 AND NOT (regexp_replace(word, '[^A-Za-z0-9'']', '', 'g') <> '' AND (pct < 5 AND length(regexp_replace(word, '[^A-Za-z0-9'']', '', 'g')) <= 2 OR pct < 16 AND lower(regexp_replace(word, '[^A-Za-z0-9'']', '', 'g')) IN ('um','uh','erm','er','hmm','mm','uhm')))""")
def jn3_caption_words(spark, d):
    segs = bridge.segments(spark, d)
    held = intervals.interval_join(clips(segs), segs, "job_id", "lo", "hi").select("job_id", "clip_ix", "lo", "hi", "seg_ix")
    x = intervals.clamp(held.join(bridge.words(segs), ["job_id", "seg_ix"]), "lo", "hi").where("rel_end > rel_start + 1")
    plain = F.regexp_replace("word", "[^A-Za-z0-9']", "")
    bad = (plain != "") & ((F.col("pct") < 5) & (F.length(plain) <= 2) | (F.col("pct") < 16) & F.lower(plain).isin(*lx.CAPTION_FILLERS))
    return x.where(~bad).select("job_id", "clip_ix", "seg_ix", "word_ix", "rel_start", "rel_end", "word")


@query(S.CLIPS + "SELECT c.job_id, clip_ix, w.seg_ix, word_ix FROM clips c JOIN segments s ON s.job_id = c.job_id AND s.end_cs >= lo AND s.start_cs <= hi JOIN words w ON w.job_id = s.job_id AND w.seg_ix = s.seg_ix WHERE w.end_cs > lo AND w.start_cs < hi")
def jn4_edit_words(spark, d):
    segs = bridge.segments(spark, d)
    held = intervals.interval_join(clips(segs), segs, "job_id", "lo", "hi", closed=True).select("job_id", "clip_ix", "lo", "hi", "seg_ix")
    return held.join(bridge.words(segs), ["job_id", "seg_ix"]).where(intervals.overlaps(F.col("start_cs"), F.col("end_cs"), F.col("lo"), F.col("hi"))).select("job_id", "clip_ix", "seg_ix", "word_ix")


@query(S.BRIDGE + "SELECT s.job_id, s.seg_ix, count(*) AS n FROM segments s JOIN words w ON w.job_id = s.job_id AND w.end_cs > s.start_cs - 1 AND w.start_cs < s.end_cs + 1 GROUP BY s.job_id, s.seg_ix")
def jn5_word_assembly(spark, d):
    segs = bridge.segments(spark, d)
    left = segs.select("job_id", "seg_ix", (F.col("start_cs") - 1).alias("lo"), (F.col("end_cs") + 1).alias("hi"))
    return intervals.bucketed_interval_join(left, bridge.words(segs).drop("seg_ix"), "job_id", "lo", "hi", 3000).groupBy("job_id", "seg_ix").agg(F.count("*").alias("n"))


def _stamp(cs, sep: str):
    return F.format_string(f"%02d:%02d:%02d{sep}%03d", (cs / 360000).cast("long"), (cs / 6000).cast("long") % 60, (cs / 100).cast("long") % 60, cs % 100 * 10)


def _sql_stamp(cs: str, sep: str) -> str:
    return f"format('{{:02d}}:{{:02d}}:{{:02d}}{sep}{{:03d}}', {cs} // 360000, {cs} // 6000 % 60, {cs} // 100 % 60, {cs} % 100 * 10)"


_SUBS = S.CLIPS + ", subs AS (SELECT c.job_id, clip_ix, seg_ix, greatest(start_cs, lo) - lo AS a, least(end_cs, hi) - lo AS b, trim(text) AS t FROM clips c JOIN segments s ON s.job_id = c.job_id AND s.end_cs > lo AND s.start_cs < hi WHERE trim(text) <> ''), numbered AS (SELECT *, row_number() OVER (PARTITION BY job_id, clip_ix ORDER BY seg_ix) AS k FROM subs WHERE b > a)"


def subtitles(segs: DataFrame) -> DataFrame:
    return intervals.clamp(intervals.interval_join(clips(segs), segs.where("trim(text) <> ''"), "job_id", "lo", "hi"), "lo", "hi")


@query(_SUBS + "SELECT job_id, clip_ix, seg_ix, a AS rel_start, b AS rel_end, t AS text FROM numbered")
def jn6_subtitles(spark, d):
    return subtitles(bridge.segments(spark, d)).select("job_id", "clip_ix", "seg_ix", "rel_start", "rel_end", F.trim("text").alias("text"))


@query(_SUBS + f"SELECT job_id, clip_ix, string_agg(concat(k, chr(10), {_sql_stamp('a', ',')}, ' --> ', {_sql_stamp('b', ',')}, chr(10), t), concat(chr(10), chr(10)) ORDER BY k) || chr(10) AS srt FROM numbered GROUP BY job_id, clip_ix")
def snk3_srt(spark, d):
    x = subtitles(bridge.segments(spark, d)).withColumn("k", F.row_number().over(Window.partitionBy("job_id", "clip_ix").orderBy("seg_ix")))
    x = x.withColumn("block", F.concat(F.col("k").cast("string"), F.lit("\n"), _stamp(F.col("rel_start"), ","), F.lit(" --> "), _stamp(F.col("rel_end"), ","), F.lit("\n"), F.trim("text")))
    return intervals.in_order(["job_id", "clip_ix"], "block", ["k"], "\n\n", "srt")(x).withColumn("srt", F.concat("srt", F.lit("\n")))


@query(_SUBS + f"SELECT job_id, clip_ix, concat('WEBVTT', chr(10), chr(10), string_agg(concat({_sql_stamp('a', '.')}, ' --> ', {_sql_stamp('b', '.')}, chr(10), t, chr(10)), chr(10) ORDER BY k)) AS vtt FROM numbered GROUP BY job_id, clip_ix")
def snk4_vtt(spark, d):
    x = subtitles(bridge.segments(spark, d))
    x = x.withColumn("block", F.concat(_stamp(F.col("rel_start"), "."), F.lit(" --> "), _stamp(F.col("rel_end"), "."), F.lit("\n"), F.trim("text"), F.lit("\n")))
    return intervals.in_order(["job_id", "clip_ix"], "block", ["seg_ix"], "\n", "vtt")(x).withColumn("vtt", F.concat(F.lit("WEBVTT\n\n"), "vtt"))


@query(S.BRIDGE.rstrip() + S.SHOTS + "SELECT s.job_id, seg_ix FROM segments s WHERE EXISTS (SELECT 1 FROM shots h WHERE h.job_id = s.job_id AND abs(s.start_cs - h.cut_cs) <= 150)")
def jn9_shot_near(spark, d):
    segs = bridge.segments(spark, d)
    return scenes.near_shots(segs, shots(segs)).where("shot").select("job_id", "seg_ix")


@query(S.CLIPS + S.SHOTS + "SELECT c.job_id, clip_ix, count(cut_cs) AS cuts FROM clips c LEFT JOIN shots h ON h.job_id = c.job_id AND cut_cs BETWEEN lo AND hi GROUP BY c.job_id, clip_ix")
def jn10_shot_count(spark, d):
    segs = bridge.segments(spark, d)
    x = clips(segs).join(shots(segs).withColumnRenamed("job_id", "_j"), (F.col("job_id") == F.col("_j")) & F.col("cut_cs").between(F.col("lo"), F.col("hi")), "left")
    return x.groupBy("job_id", "clip_ix").agg(F.count("cut_cs").alias("cuts"))


@query(S.CLIPS + ", asked AS (SELECT job_id, clip_ix AS ask_ix, lo + (clip_ix % 3) * 4 AS a, hi - (clip_ix % 4) * 2 AS b FROM clips) SELECT q.job_id, ask_ix, min(clip_ix) AS clip_ix FROM asked q JOIN clips c ON c.job_id = q.job_id AND abs(lo - a) < 5 AND abs(hi - b) < 5 GROUP BY q.job_id, ask_ix")
def jn11_saved_match(spark, d):
    c = clips(bridge.segments(spark, d))
    asked = c.select(F.col("job_id").alias("_j"), F.col("clip_ix").alias("ask_ix"), (F.col("lo") + F.col("clip_ix") % 3 * 4).alias("a"), (F.col("hi") - F.col("clip_ix") % 4 * 2).alias("b"))
    near = (F.abs(F.col("lo") - F.col("a")) < 5) & (F.abs(F.col("hi") - F.col("b")) < 5)
    return asked.join(c, (F.col("job_id") == F.col("_j")) & near).groupBy("job_id", "ask_ix").agg(F.min("clip_ix").alias("clip_ix"))


_FLAGS = {"starts_clean": S.starts_clean("text"), "ends_clean": S.ends_clean("text")}


@query(S.GAPS + f""", f AS (SELECT *, {S.starts_clean('text')} AS starts_clean, {S.ends_clean('text')} AS ends_clean, regexp_replace({S.clean('text')}, '["”’ ]+$', '') AS u FROM gaps)
SELECT job_id, seg_ix, starts_clean, ends_clean, ({S.last_word('u', 90)} = '' OR {S.last_word('u', 90)} IN ({', '.join(map(S.q, lx.TRAILING_DEPENDENCIES))}) OR regexp_matches(lower(u), '\\b(and then|the reason (is|was)|what happened (is|was))[^\\p{{L}}\\p{{N}}_]*$')) AS unfinished,
 greatest({', '.join(f"CASE WHEN contains(lower({S.clean('text')}), {S.q(p)}) THEN {S.last_at(f'lower({S.clean("text")})', p)} + {len(p)} ELSE -1 END" for p in lx.CLOSURE_CUES)}, {', '.join(S.pattern_end(f'lower({S.clean("text")})', p) for p in lx.CLOSURE_PATTERNS)}) AS closure_end,
 len({S.words(S.opening('text'))}) BETWEEN 1 AND 14 AND ({S.starts_any(S.opening('text'), lx.REACTION_STARTS)} OR {S.opening('text')} IN ('yes','no','yeah','wow','whoa')) AS short_reaction,
 CASE {' '.join(f"WHEN {S.any_in('lower(text)', c)} THEN '{k}'" for k, c in lx.MOMENT_CUES.items())} ELSE 'unknown' END AS moment FROM f""")
def flt7_text_flags(spark, d):
    """Openings, endings, unfinished thoughts, closure, reactions, moment types (FLT-7, 8, 9, 12, 13, STR-25)."""
    c = F.col("text")
    return bridge.segments(spark, d).select("job_id", "seg_ix", T.starts_clean(c).alias("starts_clean"), T.ends_clean(c).alias("ends_clean"), T.unfinished(c).alias("unfinished"), T.closure_end(c).alias("closure_end"), T.short_reaction(c).alias("short_reaction"), T.moment_type(c).alias("moment"))


@query(S.GAPS + f""", u AS (SELECT *, regexp_replace({S.clean('text')}, '["”’ ]+$', '') AS u, right({S.clean('text')}, 1) AS e FROM gaps) SELECT job_id, seg_ix, CASE WHEN {S.last_word('u', 90)} = '' OR {S.last_word('u', 90)} IN ({', '.join(map(S.q, lx.TRAILING_DEPENDENCIES))}) OR regexp_matches(lower(u), '\\b(and then|the reason (is|was)|what happened (is|was))[^\\p{{L}}\\p{{N}}_]*$') THEN -1 WHEN e IN ('.', '!', '?', '…') THEN 2 WHEN gap_after >= 60 THEN 1 ELSE 0 END AS ending FROM u""")
def flt10_ending_quality(spark, d):
    c = F.col("text")
    q = F.when(T.unfinished(c), -1).when(F.right(T.clean(c), F.lit(1)).isin(".", "!", "?", "…"), 2).when(F.col("gap_after") >= 60, 1).otherwise(0)
    return scenes.gaps(bridge.segments(spark, d)).select("job_id", "seg_ix", q.alias("ending"))


@query(S.BRIDGE + f"SELECT job_id, seg_ix, len({S.words('text')}) AS n_tokens, array_to_string({S.topic('text')}, ' ') AS topics, {S.times_in('lower(text)', 'e ')} AS n_e FROM segments")
def str2_tokens(spark, d):
    c = F.col("text")
    return bridge.segments(spark, d).select("job_id", "seg_ix", F.size(T.words(c)).cast("long").alias("n_tokens"), F.array_join(F.array_sort(T.topic_tokens(c)), " ").alias("topics"), T.times_in(F.lower(c), "e ").cast("long").alias("n_e"))


@query(S.BRIDGE + f", t AS (SELECT *, {S.topic('text')} AS a, lead({S.topic('text')}) OVER (PARTITION BY job_id ORDER BY seg_ix) AS b FROM segments) SELECT job_id, seg_ix, CAST(len(list_intersect(a, b)) AS INTEGER) AS both_n, CAST(len(list_distinct(list_concat(a, b))) AS INTEGER) AS either_n, CAST(least(len(a), len(b)) AS INTEGER) AS least_n FROM t WHERE b IS NOT NULL")
def set4_set5_neighbours(spark, d):
    """Jaccard and overlap parts of each segment with the next (SET-4, SET-5)."""
    x = bridge.segments(spark, d).withColumn("a", T.topic_tokens(F.col("text")))
    x = x.withColumn("b", F.lead("a").over(scenes.by_job())).where("b is not null")
    return x.select("job_id", "seg_ix", F.size(F.array_intersect("a", "b")).alias("both_n"), F.size(F.array_union("a", "b")).alias("either_n"), F.least(F.size("a"), F.size("b")).alias("least_n"))


@query(S.BRIDGE + "SELECT job_id, start_cs, end_cs, seg_ix, word FROM (SELECT *, row_number() OVER (PARTITION BY job_id, start_cs, end_cs, lower(word) ORDER BY seg_ix, word) AS k FROM (SELECT * FROM words UNION ALL SELECT job_id, seg_ix + 1, word_ix, start_cs + CASE WHEN pct < 10 THEN 1 ELSE 0 END, end_cs, translate(word, 'aeio', 'AEIO'), pct FROM words WHERE pct < 20)) WHERE k = 1")
def set1_word_dedup(spark, d):
    """Words told twice: one of each start, end (in hundredths) and word in any case, the first by segment (SET-1, SET-6)."""
    w = bridge.words(bridge.segments(spark, d))
    again = w.where("pct < 20").withColumns({"seg_ix": F.col("seg_ix") + 1, "start_cs": F.col("start_cs") + F.when(F.col("pct") < 10, 1).otherwise(0), "word": F.translate("word", "aeio", "AEIO")})
    k = F.row_number().over(Window.partitionBy("job_id", "start_cs", "end_cs", F.lower("word")).orderBy("seg_ix", "word"))
    return w.union(again).withColumn("k", k).where("k = 1").select("job_id", "start_cs", "end_cs", "seg_ix", "word")


_ENDINGS = ("", " and this was the answer we kept", " but the reason is", ". That is proof. What happened next", " until", "; however we left", " That is the result of it, and then")
_ENDED = S.BRIDGE + f", c AS (SELECT job_id, seg_ix, lower({S.clean(f"concat(text, ({S.listed(_ENDINGS)})[(job_id + seg_ix) % {len(_ENDINGS)} + 1])")}) AS x FROM segments), r AS (SELECT *, rtrim(x, concat(' .!?…', chr(34), '”’')) AS y FROM c)"


def _closure_sql(x: str) -> str:
    return "greatest(" + ", ".join([*(f"CASE WHEN contains({x}, {S.q(p)}) THEN {S.last_at(x, p)} + {len(p)} ELSE -1 END" for p in lx.CLOSURE_CUES), *(S.pattern_end(x, p) for p in lx.CLOSURE_PATTERNS)]) + ")"


@query(_ENDED + f", z AS (SELECT *, substr(y, CAST(floor(length(y) * 0.66::DOUBLE) AS INTEGER) + 1) AS third FROM r) SELECT job_id, seg_ix, {_closure_sql('x')} AS closure_end, {' OR '.join(f'regexp_matches(right(y, 180), {S.q(p)})' for p in lx.OPEN_LOOP_PATTERNS)} OR {S.any_in('third', lx.LATE_PIVOTS)} AND {_closure_sql('third')} < 0 AS open_loop FROM z")
def flt11_flt12_closure(spark, d):
    """Where a thought is closed, and whether a loop is open near its end; endings are put in by place (FLT-11, FLT-12)."""
    from tidemark.operators import scene_ranking

    end = F.element_at(F.array(*map(F.lit, _ENDINGS)), ((F.col("job_id") + F.col("seg_ix")) % len(_ENDINGS) + 1).cast("int"))
    x = bridge.segments(spark, d).withColumn("text", F.concat("text", end))
    return x.select("job_id", "seg_ix", T.closure_end(F.col("text")).alias("closure_end"), scene_ranking.open_loop(F.col("text")).alias("open_loop"))


@query(S.BRIDGE + r""", t AS (SELECT job_id, seg_ix, word_ix, lower(regexp_replace(word, '[^\p{L}\p{N}_'']+', '', 'g')) AS tok FROM words), n AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY seg_ix, word_ix) AS k FROM t WHERE tok <> ''),
e AS (SELECT a.job_id, a.k, a.tok = lag(a.tok, 2) OVER w AS e2, a.tok = lag(a.tok, 3) OVER w AS e3, a.tok = lag(a.tok, 4) OVER w AS e4 FROM n a WINDOW w AS (PARTITION BY job_id ORDER BY k)),
r AS (SELECT job_id, CAST(coalesce(e2, false) AND coalesce(lag(e2) OVER w, false) AS INTEGER) + CAST(coalesce(e3, false) AND coalesce(lag(e3) OVER w, false) AND coalesce(lag(e3, 2) OVER w, false) AS INTEGER) + CAST(coalesce(e4, false) AND coalesce(lag(e4) OVER w, false) AND coalesce(lag(e4, 2) OVER w, false) AND coalesce(lag(e4, 3) OVER w, false) AS INTEGER) AS hits FROM e WINDOW w AS (PARTITION BY job_id ORDER BY k))
SELECT job_id, CAST(count(*) AS BIGINT) AS n_tokens, CAST(sum(hits) AS BIGINT) AS repeated FROM r GROUP BY job_id""")
def win6_ngram_repeat(spark, d):
    from tidemark.operators import quality

    return quality.repeats(bridge.words(bridge.segments(spark, d)))


@query(S.GAPS + f""", w AS (SELECT job_id, seg_ix AS start_ix, start_cs, text AS start_text, gap_before, unnest(generate_series(1, count(*) OVER (PARTITION BY job_id ORDER BY seg_ix ROWS BETWEEN CURRENT ROW AND 29 FOLLOWING))) AS k FROM gaps),
c AS (SELECT w.*, g.seg_ix AS end_ix, g.end_cs - w.start_cs AS d_cs FROM w JOIN gaps g ON g.job_id = w.job_id AND g.seg_ix = w.start_ix + w.k - 1) SELECT job_id, start_ix, end_ix, d_cs FROM c WHERE d_cs BETWEEN 1800 AND 6500""")
def jn12_windows(spark, d):
    return ranking.windows(bridge.segments(spark, d)).select("job_id", "start_ix", "end_ix", (F.col("end_cs") - F.col("start_cs")).alias("d_cs"))


def _score_sql() -> str:
    return S.GAPS + f""", w AS (SELECT job_id, seg_ix AS start_ix, start_cs, text AS start_text, gap_before, count(*) OVER v AS n_in, list(text) OVER v AS texts, unnest(generate_series(1, count(*) OVER v)) AS k FROM gaps WINDOW v AS (PARTITION BY job_id ORDER BY seg_ix ROWS BETWEEN CURRENT ROW AND 29 FOLLOWING)),
c AS (SELECT w.*, g.seg_ix AS end_ix, g.end_cs, g.text AS end_text, g.gap_after, g.end_cs - w.start_cs AS d_cs FROM w JOIN gaps g ON g.job_id = w.job_id AND g.seg_ix = w.start_ix + w.k - 1 WHERE g.end_cs - w.start_cs BETWEEN 1800 AND 6500),
a AS (SELECT *, d_cs / 100.0::DOUBLE AS d, {S.clean("array_to_string(texts[1:k], ' ')")} AS text FROM c WHERE {S.ends_clean('end_text')} OR gap_after >= 45 OR (d_cs BETWEEN 2600 AND 5000 AND k = n_in)),
""" + scored_sql("a")


_REASONS = (
    ("ideal", 15, "Strong Shorts length"), ("NOT ideal AND usable", 8, "Usable short-form length"), ("cs", 8, "Clean standalone opening"), ("hk", 14, "Strong opening hook"), ("qu", 8, "Question-led hook"), ("onum", 5, "Specific opening detail"),
    ("gap_before >= 35", 4, "Natural start boundary"), ("ce", 8, "Clean ending"), ("gap_after >= 35", 4, "Natural end boundary"), ("pe", 13, "Ends on a clear payoff"), ("late", 7, "Contains a payoff or takeaway"), ("pv", 6, "Has a story/idea turn"),
    ("nu", 5, "Specific detail or number"), ("it", 6, "High-interest language"), ("wpm BETWEEN 100 AND 205", 6, "Good speaking density"),
)
#: The note of a scored window.
NOTE = "'Best at ' || best_at[1].d || ' + ' || best_at[2].d || '.' || CASE WHEN worst_at[1].v < 45 THEN ' ' || worst_at[1].d || ' is the main trade-off.' ELSE '' END"


def scored_sql(a: str) -> str:
    """CTEs f0 to scored over windows a(start_text, end_text, text, d, gap_before, gap_after, ...)."""
    num = r"'\b\d+(?:\.\d+)?%?\b|[$£€]\s?\d'"
    return f"""f0 AS (SELECT *, lower(text) AS low, lower({S.clean('end_text')}) AS e, {S.opening('start_text')} AS o, {S.words('text')} AS ws FROM {a}),
f1 AS (SELECT *, len(ws) AS n, {S.starts_clean('start_text')} AS cs, {S.starts_any('o', lx.HOOK_PHRASES)} OR {S.any_in('left(o, 110)', lx.HOOK_PHRASES)} AS hk, contains(left({S.clean('start_text')}, 180), '?') AS qu, regexp_matches(left({S.clean('start_text')}, 220), {num}) AS onum, {S.ends_clean('end_text')} AS ce, {S.any_in('e', lx.PAYOFF_PHRASES)} AS pe, {S.any_in('substr(low, length(low) // 2 + 1)', lx.PAYOFF_PHRASES)} AS pl,
 (length(low) - greatest({', '.join(S.last_at('low', p) for p in lx.PAYOFF_PHRASES)}))::DOUBLE / greatest(length(low), 1) AS tail, {S.starts_clean('end_text')} AS ecs, {S.any_in('low', lx.PIVOT_PHRASES)} AS pv, regexp_matches(text, {num}) AS nu, {S.any_in('low', lx.INTEREST_TERMS)} AS it,
 (len(list_filter(ws, lambda t: list_contains({S.listed(lx.FILLER_WORDS)}, t))) + {' + '.join(S.times_in('low', p) for p in lx.FILLER_PHRASES)})::DOUBLE / greatest(len(ws), 1) AS fr, list_filter(ws, lambda t: length(t) > 3) AS lw, {S.last_word('e', 100)} IN ({', '.join(map(S.q, lx.TRAILING_DEPENDENCIES))}) AS tr FROM f0),
f2 AS (SELECT *, n / greatest(d, 1.0::DOUBLE) * 60 AS wpm, CASE WHEN len(lw) > 0 THEN len(list_distinct(lw))::DOUBLE / len(lw) END AS ur, least(12.0::DOUBLE, 5 + fr * 50) AS p, NOT pe AND pl AS late, d BETWEEN 24 AND 48 AS ideal, d BETWEEN 18 AND 60 AS usable FROM f1),
s AS (SELECT *,
 36.0::DOUBLE + CASE WHEN ideal THEN 15 WHEN usable THEN 8 ELSE -least(18.0::DOUBLE, abs(d - 36) * 0.65) END + CASE WHEN cs THEN 8 ELSE -15 END + 14 * hk::INT + 8 * qu::INT + 5 * onum::INT + 4 * (gap_before >= 35)::INT + CASE WHEN ce THEN 8 ELSE -12 END + 4 * (gap_after >= 35)::INT + CASE WHEN pe THEN 13 ELSE 0 END + CASE WHEN late THEN 7 ELSE 0 END - CASE WHEN late AND tail > 0.20 THEN 18 ELSE 0 END - CASE WHEN NOT ecs AND NOT pe THEN 10 ELSE 0 END + 6 * pv::INT + 5 * nu::INT + 6 * it::INT + CASE WHEN wpm BETWEEN 100 AND 205 THEN 6 WHEN wpm < 65 OR wpm > 250 THEN -9 ELSE 0 END + CASE WHEN n BETWEEN 45 AND 155 THEN 6 WHEN n < 28 THEN -12 WHEN n > 190 THEN -7 ELSE 0 END - CASE WHEN fr > 0.07 THEN p ELSE 0 END - CASE WHEN ur < 0.42 THEN 6 ELSE 0 END - 12 * tr::INT AS raw,
 35.0::DOUBLE + CASE WHEN cs THEN 10 ELSE -18 END + 35 * hk::INT + 20 * qu::INT + 10 * onum::INT + 7 * it::INT AS h,
 35.0::DOUBLE + CASE WHEN cs THEN 20 ELSE -24 END + 10 * (gap_before >= 35)::INT + CASE WHEN ce THEN 16 ELSE -18 END + 8 * (gap_after >= 35)::INT - 10 * tr::INT AS st,
 28.0::DOUBLE + CASE WHEN ce THEN 8 ELSE -12 END + 5 * (gap_after >= 35)::INT + CASE WHEN pe THEN 45 ELSE 0 END + CASE WHEN late THEN 28 ELSE 0 END - CASE WHEN late AND tail > 0.20 THEN 20 ELSE 0 END - CASE WHEN NOT ecs AND NOT pe THEN 12 ELSE 0 END + 12 * pv::INT - CASE WHEN n < 28 THEN 8 ELSE 0 END - 18 * tr::INT AS py,
 38.0::DOUBLE + CASE WHEN ideal THEN 24 WHEN usable THEN 13 ELSE -12 END + 8 * hk::INT + 7 * qu::INT + CASE WHEN pe THEN 8 ELSE 0 END - CASE WHEN late AND tail > 0.20 THEN 8 ELSE 0 END + 8 * pv::INT + 4 * nu::INT + 15 * it::INT + CASE WHEN wpm BETWEEN 100 AND 205 THEN 10 WHEN wpm < 65 OR wpm > 250 THEN -12 ELSE 0 END - CASE WHEN fr > 0.07 THEN p ELSE 0 END - CASE WHEN ur < 0.42 THEN 8 ELSE 0 END AS rt,
 42.0::DOUBLE + 7 * cs::INT + 5 * onum::INT + 4 * (gap_before >= 35)::INT + 8 * ce::INT + 8 * nu::INT + CASE WHEN wpm BETWEEN 100 AND 205 THEN 10 WHEN wpm < 65 OR wpm > 250 THEN -15 ELSE 0 END + CASE WHEN n BETWEEN 45 AND 155 THEN 10 WHEN n < 28 THEN -18 WHEN n > 190 THEN -10 ELSE 0 END - CASE WHEN fr > 0.07 THEN p * 1.5 ELSE 0 END - CASE WHEN ur < 0.42 THEN 10 ELSE 0 END + CASE WHEN ur > 0.66 THEN 5 ELSE 0 END AS cl FROM f2),
b AS (SELECT *, CAST(greatest(1, least(99, round_even(h, 0))) AS INTEGER) AS hook, CAST(greatest(1, least(99, round_even(st, 0))) AS INTEGER) AS standalone, CAST(greatest(1, least(99, round_even(py, 0))) AS INTEGER) AS payoff, CAST(greatest(1, least(99, round_even(rt, 0))) AS INTEGER) AS retention, CAST(greatest(1, least(99, round_even(cl, 0))) AS INTEGER) AS clarity FROM s),
scored AS (SELECT *, CAST(greatest(1, least(98, round_even(raw * 0.62 + (hook * 0.25 + standalone * 0.22 + payoff * 0.22 + retention * 0.19 + clarity * 0.12) * 0.38, 0))) AS INTEGER) AS score, {S.starts_clean('start_text')} OR gap_before >= 45 OR {S.any_in(f'left(lower({S.clean("start_text")}), 120)', lx.HOOK_PHRASES)} AS good,
 list_transform(list_reverse_sort(list_filter([{', '.join(f"CASE WHEN {cond} THEN {{'w': {w}, 'why': {S.q(why)}}} END" for cond, w, why in _REASONS)}], lambda r: r IS NOT NULL))[1:4], lambda r: r.why) AS reasons,
 list_sort([{', '.join(f"{{'v': -{x}, 'k': {k}, 'd': '{x}'}}" for k, x in enumerate(ranking._DIMENSIONS))}]) AS best_at, list_sort([{', '.join(f"{{'v': {x}, 'k': {k}, 'd': '{x.capitalize()}'}}" for k, x in enumerate(ranking._DIMENSIONS))}]) AS worst_at FROM b)"""


@query(_score_sql() + f" SELECT job_id, start_ix, end_ix, score, hook, standalone, payoff, retention, clarity, array_to_string(reasons, '; ') AS reasons, {NOTE} AS note FROM scored")
def scr1_score(spark, d):
    """The score of each admitted window, its dimensions, best reasons and note (SCR-1, SRT-4, SRT-5)."""
    x = ranking.scored(ranking.admitted(ranking.windows(bridge.segments(spark, d))))
    return x.select("job_id", "start_ix", "end_ix", "score", *ranking._DIMENSIONS, F.array_join("reasons", "; ").alias("reasons"), "note")


def _greedy_sql(most: int = 3) -> str:
    sig = f"list_distinct(list_filter(({S.words('hook_text')})[1:18], lambda t: length(t) > 3))"
    out = _score_sql() + f""", h AS (SELECT *, {S.clean('text')} AS ct FROM scored), h2 AS (SELECT *, regexp_extract(ct, '^(.*?[.!?])\\s', 1) AS fs FROM h), h3 AS (SELECT *, CASE WHEN fs = '' THEN ct ELSE fs END AS fs2 FROM h2),
cand AS (SELECT job_id, start_ix, end_ix, CASE WHEN good THEN score ELSE greatest(1, score - 7) END AS score, greatest(0, start_cs - 12) AS clip_start, end_cs + 16 AS clip_end, CASE WHEN length(fs2) > 180 THEN rtrim(left(fs2, 179)) || '…' ELSE fs2 END AS hook_text FROM h3), c1 AS (SELECT *, {sig} AS sig FROM cand)"""
    for k in range(1, most + 1):
        out += f""", b{k} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY score DESC, clip_end - clip_start, start_ix, end_ix) AS rn FROM c{k}) WHERE rn = 1),
c{k + 1} AS (SELECT c.* FROM c{k} c JOIN b{k} b ON b.job_id = c.job_id WHERE NOT (greatest(0, least(c.clip_end, b.clip_end) - greatest(c.clip_start, b.clip_start))::DOUBLE / greatest(100, least(c.clip_end - c.clip_start, b.clip_end - b.clip_start)) > 0.48 OR CASE WHEN least(len(c.sig), len(b.sig)) > 0 THEN len(list_intersect(c.sig, b.sig))::DOUBLE / least(len(c.sig), len(b.sig)) ELSE 0 END > 0.72))"""
    short = f"""(SELECT job_id, 0 AS start_ix, CAST(max(seg_ix) AS INTEGER) AS end_ix, arg_min(start_cs, seg_ix) AS start_cs, arg_max(end_cs, seg_ix) AS end_cs, {S.clean("string_agg(text, ' ' ORDER BY seg_ix)")} AS text, arg_min(text, seg_ix) AS start_text, arg_max(text, seg_ix) AS end_text, 1000 AS gap_before, 1000 AS gap_after, (arg_max(end_cs, seg_ix) - arg_min(start_cs, seg_ix)) / 100.0::DOUBLE AS d FROM segments WHERE job_id NOT IN (SELECT job_id FROM c1) GROUP BY job_id)"""
    out += ", whole AS (WITH " + scored_sql(short) + " SELECT job_id, start_ix, end_ix, greatest(0, start_cs - 12) AS clip_start, end_cs + 16 AS clip_end, score FROM scored)"
    return out + " " + " UNION ALL ".join(f"SELECT job_id, start_ix, end_ix, clip_start, clip_end, score, {k} AS rank FROM b{k}" for k in range(1, most + 1)) + " UNION ALL SELECT job_id, start_ix, end_ix, clip_start, clip_end, score, 1 FROM whole"


@query(_greedy_sql())
def flagship_best_clips(spark, d):
    """The best three clips of each job by the segment-window ranker, or its whole transcript where no window fits (SCR-1, SCR-2, SEL-1)."""
    return ranking.best(bridge.segments(spark, d))
