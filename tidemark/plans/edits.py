"""Queries over edits of transcripts and clips, and over two versions of a transcript."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import edits, intervals, quality
from tidemark.plans import sqltext as S
from tidemark.plans.transcript import clips, query
from tidemark.sources import bridge


def _edits(spark, d: str) -> tuple[DataFrame, DataFrame]:
    """The segments in seconds, and an edit of each clip: its words with a letter before each, some left out or added by place."""
    segs = bridge.segments(spark, d)
    c = clips(segs)
    held = intervals.interval_join(c, segs, "job_id", "lo", "hi", closed=True).select("job_id", "clip_ix", "lo", "hi", "seg_ix")
    words = held.join(bridge.words(segs), ["job_id", "seg_ix"]).where(intervals.overlaps(F.col("start_cs"), F.col("end_cs"), F.col("lo"), F.col("hi")))
    by_clip = words.groupBy("job_id", "clip_ix").agg(F.array_sort(F.collect_list(F.struct((F.col("start_cs") / 100).alias("start"), (F.col("end_cs") / 100).alias("end"), "word"))).alias("w"))
    x = c.join(by_clip, ["job_id", "clip_ix"], "left").withColumn("w", F.coalesce("w", F.expr("cast(array() as array<struct<start: double, end: double, word: string>>)")))
    k = (F.col("clip_ix") + F.col("job_id")) % 4
    upper = F.transform("w", lambda w: F.concat(F.lit("x"), w["word"]))
    text = F.when(k == 0, F.array_join(upper, "  ")).when(k == 1, F.array_join(F.filter(upper, lambda w, i: i % 3 != 1), " ")).when(k == 2, F.concat(F.array_join(upper, " "), F.lit(" AND two more"))).otherwise(F.when(F.col("job_id") % 2 == 0, "  ").otherwise("just three words"))
    x = x.select("job_id", "clip_ix", (F.col("lo") / 100).alias("lo"), (F.col("hi") / 100).alias("hi"), text.alias("text"), F.transform("w", lambda w: F.struct(w["start"].alias("start"), w["end"].alias("end"))).alias("old"))
    return segs.select("job_id", "seg_ix", (F.col("start_cs") / 100).alias("start"), (F.col("end_cs") / 100).alias("end"), "text"), x


_UP = "list_transform(w, lambda x: concat('x', x.word))"
_EDITS = S.CLIPS + rf""", ew AS (SELECT c.job_id, clip_ix, list({{'start': w.start_cs / 100::DOUBLE, 'end': w.end_cs / 100::DOUBLE, 'word': word}} ORDER BY w.start_cs, w.end_cs, word) AS w FROM clips c JOIN segments s ON s.job_id = c.job_id AND s.end_cs >= lo AND s.start_cs <= hi JOIN words w ON w.job_id = s.job_id AND w.seg_ix = s.seg_ix WHERE w.end_cs > lo AND w.start_cs < hi GROUP BY ALL),
e0 AS (SELECT c.job_id, c.clip_ix, lo / 100::DOUBLE AS lo, hi / 100::DOUBLE AS hi, (c.clip_ix + c.job_id) % 4 AS k, coalesce(w, []) AS w FROM clips c LEFT JOIN ew ON ew.job_id = c.job_id AND ew.clip_ix = c.clip_ix),
e1 AS (SELECT *, CASE k WHEN 0 THEN array_to_string({_UP}, ' ') WHEN 1 THEN array_to_string(list_filter({_UP}, lambda x, i: (i - 1) % 3 <> 1), ' ') WHEN 2 THEN array_to_string({_UP}, ' ') || ' AND two more' ELSE CASE WHEN job_id % 2 = 0 THEN '' ELSE 'just three words' END END AS text FROM e0),
e2 AS (SELECT *, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS t, list_transform(list_zip(w[1:-2], w[2:]), lambda p: (least(hi, p[1]['end']) + greatest(lo, p[2].start)) / 2.0::DOUBLE) AS mids FROM e1),
e3 AS (SELECT *, CASE WHEN len(w) > 0 THEN list_concat([greatest(lo, w[1].start)], list_transform(mids, lambda x, i: greatest(greatest(lo, w[1].start), list_max(mids[1:i]))), [least(hi, w[-1]['end'])]) END AS b0 FROM e2),
e4 AS (SELECT *, CASE WHEN b0[-1] <= b0[1] THEN [lo, hi] ELSE b0 END AS b FROM e3),
tok AS (SELECT *, unnest(range(0, len(t))) AS i FROM e4),
pos AS (SELECT *, i / len(t)::DOUBLE * len(w) AS pa, (i + 1) / len(t)::DOUBLE * len(w) AS pb FROM tok),
lerp AS (SELECT *, CASE WHEN pa >= len(b) - 1 THEN b[-1] ELSE b[CAST(floor(pa) AS INTEGER) + 1] * (1 - (pa - floor(pa))) + b[CAST(floor(pa) AS INTEGER) + 2] * (pa - floor(pa)) END AS va, CASE WHEN pb >= len(b) - 1 THEN b[-1] ELSE b[CAST(floor(pb) AS INTEGER) + 1] * (1 - (pb - floor(pb))) + b[CAST(floor(pb) AS INTEGER) + 2] * (pb - floor(pb)) END AS vb FROM pos),
ed AS (SELECT job_id, clip_ix, lo, hi, text, len(w) AS n_old, CAST(i AS INTEGER) AS i, t[i + 1] AS word, CASE WHEN len(w) = len(t) THEN greatest(lo, w[i + 1].start) WHEN len(w) > 0 THEN va ELSE lo + greatest(0.1::DOUBLE, hi - lo) * (i / len(t)::DOUBLE) END AS a, CASE WHEN len(w) = len(t) THEN least(hi, w[i + 1]['end']) WHEN len(w) > 0 THEN CASE WHEN vb <= va THEN least(hi, va + 0.05::DOUBLE) ELSE vb END ELSE lo + greatest(0.1::DOUBLE, hi - lo) * ((i + 1) / len(t)::DOUBLE) END AS z FROM lerp)"""


@query(_EDITS + " SELECT job_id, clip_ix, i AS word_ix, word, CAST(round(a * 10000) AS BIGINT) AS start_e4, CAST(round(z * 10000) AS BIGINT) AS end_e4 FROM ed")
def seq8_retimed_words(spark, d):
    """Edited words on the rhythm of the old ones (SEQ-8, MTH-6, JN-16)."""
    x = edits.retimed(_edits(spark, d)[1]).select("job_id", "clip_ix", F.posexplode("words").alias("word_ix", "w"))
    e4 = lambda c: F.round(F.col(c) * 10000).cast("long")
    return x.select("job_id", "clip_ix", "word_ix", "w.word", e4("w.start").alias("start_e4"), e4("w.end").alias("end_e4"))


@query(_EDITS + """, f AS (SELECT * FROM clips WHERE clip_ix % 2 = 0), kept AS (SELECT job_id, start_cs, end_cs, text FROM segments s WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.job_id = s.job_id AND s.end_cs >= f.lo AND s.start_cs <= f.hi)),
new AS (SELECT job_id, CASE WHEN any_value(n_old) = 0 THEN any_value(lo) ELSE arg_min(a, i) END AS a, CASE WHEN any_value(n_old) = 0 THEN any_value(hi) ELSE greatest(arg_min(a, i) + 0.05::DOUBLE, least(any_value(hi), arg_max(z, i))) END AS z, string_agg(word, ' ' ORDER BY i) AS text FROM ed WHERE clip_ix % 2 = 0 GROUP BY job_id, clip_ix)
SELECT job_id, start_cs * 100 AS start_e4, end_cs * 100 AS end_e4, text FROM kept UNION ALL SELECT job_id, CAST(round(a * 10000) AS BIGINT), CAST(round(z * 10000) AS BIGINT), text FROM new""")
def set7_edited_transcript(spark, d):
    """The transcript after an edit of every second clip: touched segments go, edited ones come in (SET-7, MUT-2)."""
    segs, asked = _edits(spark, d)
    out = edits.replaced(segs, edits.retimed(asked.where("clip_ix % 2 = 0")))
    return out.select("job_id", F.round(F.col("start") * 10000).cast("long").alias("start_e4"), F.round(F.col("end") * 10000).cast("long").alias("end_e4"), "text")


@query(S.CLIPS + ", a AS (SELECT job_id, clip_ix, lo, hi, (clip_ix + job_id) % 5 AS k FROM clips) SELECT job_id, clip_ix, CASE WHEN k = 0 THEN lo + 150 ELSE lo END AS start_cs, CASE WHEN k = 0 THEN hi + 250 ELSE hi END AS end_cs, CASE k WHEN 1 THEN 'end before start' WHEN 2 THEN 'over 180 seconds' END AS refused FROM a")
def mut1_clip_times(spark, d):
    """New times for some clips, refused where they end too early or are too long (MUT-1, FLT-4)."""
    c = clips(bridge.segments(spark, d)).select("job_id", "clip_ix", (F.col("lo") / 100).alias("start"), (F.col("hi") / 100).alias("end"))
    k = (F.col("clip_ix") + F.col("job_id")) % 5
    asked = c.where(k < 3).select("job_id", "clip_ix", (F.col("start") + 1.5).alias("new_start"), F.when(k == 0, F.col("end") + 2.5).when(k == 1, F.col("start") + 1.5).otherwise(F.col("start") + 200).alias("new_end"))
    x = edits.timed(c, asked, ["job_id", "clip_ix"])
    return x.select("job_id", "clip_ix", F.round(F.col("start") * 100).cast("long").alias("start_cs"), F.round(F.col("end") * 100).cast("long").alias("end_cs"), "refused")


def _quality_sql(pct: str, words: str = "words") -> str:
    """CTEs q0 to q3: the quality row of each job, with pct as the words' probability."""
    return rf"""t AS (SELECT job_id, seg_ix, word_ix, {pct} AS pct, lower(regexp_replace(word, '[^\p{{L}}\p{{N}}_'']+', '', 'g')) AS tok FROM {words}), g AS (SELECT job_id, seg_ix, count(*) AS n, sum(pct) AS s, count(*) FILTER (pct < 38) AS n38, count(*) FILTER (pct < 48) AS n48, count(*) FILTER (pct < 25) AS n25, count(*) FILTER (tok <> '') AS toks FROM t GROUP BY ALL),
j AS (SELECT job_id, count(*) AS segment_count, sum(n) AS n, sum(s) AS s, sum(n48) AS n48, sum(n25) AS n25, count(*) FILTER (toks >= 3 AND (s / n / 100 < 0.56::DOUBLE OR n38 / n > 0.28::DOUBLE)) AS weak, min(CASE WHEN toks >= 3 THEN s / n / 100 END) AS weakest FROM g GROUP BY job_id),
m AS (SELECT job_id, tok, row_number() OVER (PARTITION BY job_id ORDER BY seg_ix, word_ix) AS k FROM t WHERE tok <> ''),
e AS (SELECT job_id, k, coalesce(tok = lag(tok, 2) OVER w, false) AS e2, coalesce(tok = lag(tok, 3) OVER w, false) AS e3, coalesce(tok = lag(tok, 4) OVER w, false) AS e4 FROM m WINDOW w AS (PARTITION BY job_id ORDER BY k)),
r AS (SELECT job_id, (e2 AND coalesce(lag(e2) OVER w, false))::INT + (e3 AND coalesce(lag(e3) OVER w, false) AND coalesce(lag(e3, 2) OVER w, false))::INT + (e4 AND coalesce(lag(e4) OVER w, false) AND coalesce(lag(e4, 2) OVER w, false) AND coalesce(lag(e4, 3) OVER w, false))::INT AS h FROM e WINDOW w AS (PARTITION BY job_id ORDER BY k)),
rr AS (SELECT job_id, count(*) AS word_count, sum(h) AS h FROM r GROUP BY job_id),
q AS (SELECT j.job_id, word_count, segment_count, weak, s / n / 100::DOUBLE AS avg_p, n48 / n::DOUBLE AS low, n25 / n::DOUBLE AS very, h / greatest(1, word_count)::DOUBLE AS rep, coalesce(weakest, s / n / 100::DOUBLE) AS weakest FROM j JOIN rr USING (job_id)),
qq AS (SELECT *, greatest(0::DOUBLE, least(100::DOUBLE, avg_p * 100 - low * 24 - very * 26 - least(18::DOUBLE, rep * 120) - least(12::DOUBLE, weak * 2.5::DOUBLE))) AS score, avg_p < 0.72::DOUBLE OR low > 0.18::DOUBLE OR very > 0.07::DOUBLE OR rep > 0.035::DOUBLE OR weakest < 0.5::DOUBLE OR weak >= 2 AS needs FROM q)"""


@query(S.BRIDGE + ", " + _quality_sql("pct") + " SELECT job_id, CAST(round(score * 1000) AS BIGINT) AS score_milli, CAST(round(rep * 1000000) AS BIGINT) AS rep_ppm, CAST(word_count AS BIGINT) AS word_count, CAST(weak AS BIGINT) AS weak, needs FROM qq")
def agg1_quality_score(spark, d):
    """Score, repetition, word count and whether a transcript needs refinement (AGG-1)."""
    segs = bridge.segments(spark, d)
    x = quality.quality(segs, bridge.words(segs))
    return x.select("job_id", F.round(F.col("score") * 1000).cast("long").alias("score_milli"), F.round(F.col("rep") * 1000000).cast("long").alias("rep_ppm"), F.col("word_count").cast("long").alias("word_count"), F.col("weak_segments").cast("long").alias("weak"), F.col("needs_refinement").alias("needs"))


def _second(sql: str) -> str:
    """The same CTEs under other names, for the second transcript."""
    import re

    return re.sub(r"\b(t|g|j|m|e|r|rr|q|qq)\b(?= AS \(| USING| JOIN|\.| GROUP| WHERE| WINDOW)|(?<=FROM )\b(t|g|j|m|e|r|rr|q|qq)\b|(?<=JOIN )\b(rr)\b", lambda x: "b" + x.group(0), sql)


@query(S.BRIDGE + ", " + _quality_sql("pct") + ", words2 AS (SELECT job_id, seg_ix, word_ix, word, CASE WHEN job_id % 3 = 0 THEN least(99, pct + 9) WHEN job_id % 3 = 1 THEN greatest(0, pct - 4) ELSE pct END AS pct FROM words WHERE job_id % 7 <> 5), " + _second(_quality_sql("pct", "words2")) + """,
pair AS (SELECT qq.job_id, round(qq.score, 2) AS s1, round(bqq.score, 2) AS s2, round(qq.low, 4) AS l1, round(bqq.low, 4) AS l2, round(qq.weakest, 4) AS w1, round(bqq.weakest, 4) AS w2, bqq.job_id IS NOT NULL AS has2 FROM qq LEFT JOIN bqq ON bqq.job_id = qq.job_id)
SELECT job_id, coalesce(has2 AND (s2 >= s1 + 1.5::DOUBLE OR l2 <= l1 - 0.04::DOUBLE OR (w2 >= w1 + 0.10::DOUBLE AND s2 >= s1 - 5)), false) AS use_second FROM pair""")
def agg2_better_transcript(spark, d):
    """Which of two transcripts of a job is taken (AGG-2)."""
    segs = bridge.segments(spark, d)
    words = bridge.words(segs)
    pct = F.when(F.col("job_id") % 3 == 0, F.least(F.lit(99), F.col("pct") + 9)).when(F.col("job_id") % 3 == 1, F.greatest(F.lit(0), F.col("pct") - 4)).otherwise(F.col("pct"))
    again = words.where("job_id % 7 <> 5").withColumn("pct", pct)
    return quality.better(quality.quality(segs, words), quality.quality(segs.where("job_id % 7 <> 5"), again)).select("job_id", "use_second")
