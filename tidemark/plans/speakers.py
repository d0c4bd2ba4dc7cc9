"""Queries over the faces of samples, which are derived from the events: 30 daily samples make a clip of a user's."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import speakers
from tidemark.plans.transcript import query


def samples(spark, d: str) -> DataFrame:
    """(clip_id, t, cut, speech, motion, faces): a face for each event but sign-ups, near one of three places."""
    e = spark.read.parquet(f"{d}/events.parquet")
    day = F.datediff("ts", F.lit("2024-01-01").cast("date"))
    v = F.floor(F.col("value") * 100).cast("long")
    center = F.element_at(F.array(F.lit(0.25), F.lit(0.5), F.lit(0.72)), (F.col("event_id") % 3 + 1).cast("int")) + (v % 9 - 4) / 100.0
    face = F.struct("event_id", center.alias("center"), (v % 2500 + 1000).cast("double").alias("area"), (center - 0.05).alias("left"), (center + 0.05).alias("right"), (v % 300 / 10000.0).alias("activity"))
    x = e.select((F.col("user_id") * 1000 + F.floor(day / 30)).alias("clip_id"), (day % 30 / 2.0).alias("t"), "event_type", "value", F.when(F.col("event_type") != "signup", face).alias("face"))
    x = x.groupBy("clip_id", "t").agg(
        F.bool_or((F.col("event_type") == "error") & (F.col("value") > 60)).alias("cut"), F.bool_or(F.col("event_type") != "view").alias("speech"),
        F.max(F.when(F.col("event_type") == "signup", F.floor(F.col("value")).cast("long") % 100 / 100.0)).alias("motion"), F.sort_array(F.collect_list("face")).alias("faces"),
    )
    return x.withColumn("faces", F.transform("faces", lambda f: F.struct(*[f[c].alias(c) for c in ("center", "area", "left", "right", "activity")])))


def told(x: DataFrame) -> DataFrame:
    ppm = lambda c: F.round(F.col(c) * 1000000).cast("long")
    return x.select("clip_id", (F.col("t") * 2).cast("int").alias("day"), ppm("target").alias("target_ppm"), ppm("camera").alias("camera_ppm"), "follows", "switched")


_D = "{}::DOUBLE".format
_CLIP = "least(0.9::DOUBLE, greatest(0.1::DOUBLE, {}))".format
_RESET = ", ".join(f"CASE WHEN n.cut THEN {v} ELSE r.{c} END AS {c}" for c, v in (("active", "NULL"), ("pending", "NULL"), ("pn", "0"), ("sa", "999"), ("sf", "999"), ("prev", "NULL"), ("cam", "0.5::DOUBLE")))
SQL = f"""
WITH RECURSIVE e AS (SELECT *, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS day, CAST(floor(value * 100) AS BIGINT) AS v FROM events),
f AS (SELECT user_id * 1000 + day // 30 AS clip_id, day % 30 AS d, event_id, event_type, value, CAST([0.25, 0.5, 0.72] AS DOUBLE[])[event_id % 3 + 1] + (v % 9 - 4) / 100.0::DOUBLE AS center, (v % 2500 + 1000)::DOUBLE AS area, v % 300 / 10000.0::DOUBLE AS act FROM e),
s AS (SELECT clip_id, d, bool_or(event_type = 'error' AND value > 60) AS cut, bool_or(event_type <> 'view') AS speech, max(CASE WHEN event_type = 'signup' THEN CAST(floor(value) AS BIGINT) % 100 / 100.0::DOUBLE END) AS motion,
  list({{'center': center, 'area': area, 'act': act, 'id': event_id}} ORDER BY event_id) FILTER (event_type <> 'signup') AS faces, max(area) FILTER (event_type <> 'signup') AS big FROM f GROUP BY clip_id, d),
i AS (SELECT *, coalesce(len(faces), 0) AS n, coalesce(list_filter(faces, lambda x: x.area >= big * {_D(speakers.IMPORTANT)}), []) AS imp, row_number() OVER (PARTITION BY clip_id ORDER BY d) AS k FROM s),
g AS (SELECT *, list_sort(list_transform(imp, lambda x: {{'a': -x.act, 'id': x.id, 'c': x.center}})) AS ranked, (list_min(list_transform(imp, lambda x: x.center - 0.05::DOUBLE)) + list_max(list_transform(imp, lambda x: x.center + 0.05::DOUBLE))) / 2 AS middle FROM i),
n AS (SELECT *, ranked[1].c AS top, coalesce(speech AND NOT cut AND k > 1 AND len(imp) >= 2 AND -ranked[1].a >= 0.010::DOUBLE AND -ranked[1].a >= -ranked[2].a + 0.0035::DOUBLE, false) AS sure FROM g),
r AS (SELECT clip_id, 0::BIGINT AS k, NULL::BIGINT AS d, NULL::DOUBLE AS active, NULL::DOUBLE AS pending, 0 AS pn, 999 AS sa, 999 AS sf, NULL::DOUBLE AS prev, 0.5::DOUBLE AS cam, NULL::DOUBLE AS target, NULL::VARCHAR AS follows, false AS switched FROM n WHERE k = 1 UNION ALL
SELECT clip_id, k, d, active1, pending1, pn1, sa1, CASE WHEN kind = 'none' THEN sf + 1 ELSE 0 END, CASE WHEN kind = 'none' THEN prev ELSE raw END, {_CLIP('cam + least(mx, greatest(-mx, target1 - cam)) * al')}, target1, follows1, switched1 FROM
(SELECT *, CASE WHEN starts_with(follows1, 'speaker') THEN 0.095::DOUBLE WHEN starts_with(follows1, 'face') THEN 0.11::DOUBLE ELSE 0.08::DOUBLE END AS mx, CASE WHEN starts_with(follows1, 'speaker') THEN 0.56::DOUBLE WHEN starts_with(follows1, 'face') THEN 0.62::DOUBLE ELSE 0.42::DOUBLE END AS al, {_CLIP('raw')} AS target1 FROM
(SELECT *, CASE follows1 WHEN 'speaker' THEN active1 WHEN 'speaker_hold' THEN active WHEN 'face_group' THEN middle WHEN 'face' THEN largest WHEN 'face_hold' THEN prev WHEN 'motion' THEN motion ELSE 0.5::DOUBLE END AS raw FROM
(SELECT *, CASE WHEN kind IN ('jump', 'blend', 'wait') THEN 'speaker' WHEN kind = 'quiet' AND speech AND active IS NOT NULL AND sa + 1 <= 2 AND visible THEN 'speaker_hold' WHEN kind = 'quiet' THEN 'face_group' WHEN kind = 'one' THEN 'face' WHEN prev IS NOT NULL AND sf + 1 <= 2 AND NOT cut THEN 'face_hold' WHEN NOT cut AND motion IS NOT NULL THEN 'motion' ELSE 'center' END AS follows1,
  CASE kind WHEN 'jump' THEN top WHEN 'blend' THEN active * (1 - 0.28::DOUBLE) + top * 0.28::DOUBLE WHEN 'one' THEN largest WHEN 'wait' THEN CASE WHEN wn >= 2 THEN wp ELSE active END ELSE active END AS active1,
  CASE WHEN kind = 'wait' AND wn < 2 THEN wp WHEN kind IN ('jump', 'blend', 'wait') THEN NULL ELSE pending END AS pending1, CASE WHEN kind = 'wait' AND wn < 2 THEN wn WHEN kind IN ('jump', 'blend', 'wait') THEN 0 ELSE pn END AS pn1,
  CASE WHEN kind IN ('jump', 'blend', 'wait', 'one') THEN 0 WHEN kind = 'quiet' THEN sa + 1 ELSE sa END AS sa1, kind = 'jump' AND active IS NOT NULL OR kind = 'wait' AND wn >= 2 AS switched1 FROM
(SELECT *, CASE WHEN n = 0 THEN 'none' WHEN len(imp) < 2 THEN 'one' WHEN NOT sure THEN 'quiet' WHEN active IS NULL OR NOT visible THEN 'jump' WHEN abs(top - active) <= 0.17::DOUBLE THEN 'blend' ELSE 'wait' END AS kind, CASE WHEN near THEN pn + 1 ELSE 1 END AS wn, CASE WHEN near THEN pending * 0.5::DOUBLE + top * 0.5::DOUBLE ELSE top END AS wp FROM
(SELECT *, coalesce(len(list_filter(imp, lambda x: abs(x.center - active) <= 0.18::DOUBLE)) > 0, false) AS visible, coalesce(abs(top - pending) <= 0.12::DOUBLE, false) AS near, list_sort(list_transform(faces, lambda x: {{'a': -(x.area * CASE WHEN prev IS NULL THEN 1.0::DOUBLE ELSE greatest(0.15::DOUBLE, 1.0::DOUBLE - abs(x.center - prev)) END), 'id': x.id, 'c': x.center}}))[1].c AS largest FROM
(SELECT n.clip_id, n.k, n.d, n.cut, n.speech, n.motion, n.n, n.faces, n.imp, n.middle, n.top, n.sure, {_RESET} FROM r JOIN n ON n.clip_id = r.clip_id AND n.k = r.k + 1)))))))
SELECT CAST(clip_id AS BIGINT) AS clip_id, CAST(d AS INTEGER) AS day, CAST(round(target * 1000000) AS BIGINT) AS target_ppm, CAST(round(cam * 1000000) AS BIGINT) AS camera_ppm, follows, switched FROM r WHERE k > 0
"""


@query(SQL)
def seq7_speakers(spark, d):
    """The followed speaker of every sample, with hysteresis (SEQ-7), and the camera that begins anew at cuts (SEQ-6)."""
    return told(speakers.followed(samples(spark, d), "clip_id"))
