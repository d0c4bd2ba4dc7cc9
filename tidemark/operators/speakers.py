"""Who the camera follows: the active speaker among the faces of a clip's samples, with hysteresis.

samples(key, t, cut, speech, motion, faces): one row a sample of a clip, faces as array<struct<center, area, left, right,
activity>> in the order of detection, motion the centre of what moves or null. A clip has a bounded number of samples
(120 by the sample plan), so its samples are folded in one expression; clips are spread over all tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import let

# Fixed values.
#: Share of the largest face's area from which a face is important.
IMPORTANT = 0.35
#: Activity of the mouth that counts, and by how much it must exceed the second's.
ACTIVE, AHEAD = 0.010, 0.0035
#: How far a face may be from a centre to be the followed one, to be blended with it, to be the pending one.
VISIBLE, SAME, PENDING = 0.18, 0.17, 0.12
#: Weight of the new centre in a blend; samples that confirm a pending speaker; samples without activity that a speaker is held for.
BLEND, CONFIRM, HOLD = 0.28, 2, 2
LEAST_NEARNESS = 0.15
#: Samples without a face that the last one is held for.
FACE_HOLD = {"standard": 2, "visual": 2, "cinematic": 1}
#: Largest step and weight of the camera, by profile and (in the standard one) by what it follows.
CAMERA = {"cinematic": (0.050, 0.30), "visual": (0.070, 0.38), "speaker": (0.095, 0.56), "face": (0.11, 0.62), "other": (0.08, 0.42)}
LEFT_EDGE, RIGHT_EDGE, MIDDLE = 0.10, 0.90, 0.5
LONG_AGO = 999

FACE = "struct<center: double, area: double, left: double, right: double, activity: double>"
#: What a clip remembers between two samples.
STATE = "active double, pending double, pending_n int, since_active int, since_face int, previous double, camera double"
TARGET = "t double, target double, camera double, follows string, switched boolean"


def seen(samples: DataFrame, key: str, profile: str = "standard") -> DataFrame:
    """samples with what of the faces hangs on no other sample: n, important centres, group centre, the one who speaks."""
    f = F.col("faces")
    top_area = F.array_max(F.transform(f, lambda x: x["area"]))
    x = samples.withColumn("n", F.size(F.coalesce(f, F.array().cast(f"array<{FACE}>")))).withColumn("_i", F.filter(f, lambda x: x["area"] >= top_area * IMPORTANT))
    first = F.col("t") == F.min("t").over(_clip(key))
    ranked = F.array_sort(F.transform("_i", lambda x, k: F.struct((-x["activity"]).alias("a"), k.alias("k"), x["center"].alias("c"))))
    speaks = F.lit(profile == "standard") & F.col("speech") & ~F.col("cut") & ~first & (F.size("_i") >= 2)
    sure = speaks & (-F.get(ranked, F.lit(0))["a"] >= ACTIVE) & (-F.get(ranked, F.lit(0))["a"] >= -F.get(ranked, F.lit(1))["a"] + AHEAD)
    return x.select(
        key, "t", "cut", "speech", "motion", "n", F.transform(f, lambda x: F.struct(x["center"].alias("center"), x["area"].alias("area"))).alias("faces"),
        F.transform("_i", lambda x: x["center"]).alias("important"), ((F.array_min(F.transform("_i", lambda x: x["left"])) + F.array_max(F.transform("_i", lambda x: x["right"]))) / 2).alias("middle"),
        F.coalesce(sure, F.lit(False)).alias("sure"), F.get(ranked, F.lit(0))["c"].alias("speaker"),
    )


def _clip(key: str):
    from pyspark.sql import Window

    return Window.partitionBy(key)


def _step(profile: str):
    null = F.lit(None).cast("double")

    def step(a: Column, x: Column) -> Column:
        cut = x["cut"]
        fresh = F.struct(*[F.when(cut, v).otherwise(a[c]).alias(c) for c, v in (("active", null), ("pending", null), ("pending_n", F.lit(0)), ("since_active", F.lit(LONG_AGO)), ("since_face", F.lit(LONG_AGO)), ("previous", null), ("camera", F.lit(MIDDLE)))])
        return let(fresh, lambda s: let(_seen_by(s, x), lambda b: let(_moved(s, x, b), lambda m: _done(a, x, s, m))))

    def _seen_by(s, x):
        visible = F.exists(x["important"], lambda c: F.abs(c - s["active"]) <= VISIBLE)
        kind = (
            F.when(x["n"] == 0, "none").when(F.size(x["important"]) < 2, "one").when(~x["sure"], "quiet")
            .when(s["active"].isNull() | ~visible, "jump").when(F.abs(x["speaker"] - s["active"]) <= SAME, "blend").otherwise("wait")
        )
        near = s["pending"].isNotNull() & (F.abs(x["speaker"] - s["pending"]) <= PENDING)
        nearness = lambda c: F.when(s["previous"].isNull(), 1.0).otherwise(F.greatest(F.lit(LEAST_NEARNESS), 1.0 - F.abs(c - s["previous"])))
        largest = F.array_min(F.transform(x["faces"], lambda f, k: F.struct((-(f["area"] * nearness(f["center"]))).alias("a"), k.alias("k"), f["center"].alias("c"))))["c"]
        return F.struct(kind.alias("kind"), F.coalesce(visible, F.lit(False)).alias("visible"), F.when(near, s["pending_n"] + 1).otherwise(1).alias("n"), F.when(near, s["pending"] * 0.5 + x["speaker"] * 0.5).otherwise(x["speaker"]).alias("pending"), largest.alias("largest"))

    def _moved(s, x, b):
        kind, confirmed = b["kind"], b["n"] >= CONFIRM
        active = F.when(kind == "jump", x["speaker"]).when(kind == "blend", s["active"] * (1 - BLEND) + x["speaker"] * BLEND).when((kind == "wait") & confirmed, b["pending"]).when(kind == "one", b["largest"]).otherwise(s["active"])
        waits = (kind == "wait") & ~confirmed
        ends = kind.isin("jump", "blend") | (kind == "wait")
        since = F.when(kind.isin("jump", "blend", "wait", "one"), 0).when(kind == "quiet", s["since_active"] + 1).otherwise(s["since_active"])
        held = (kind == "quiet") & F.lit(profile == "standard") & x["speech"] & s["active"].isNotNull() & (s["since_active"] + 1 <= HOLD) & b["visible"]
        lost = s["since_face"] + 1
        keeps = (kind == "none") & s["previous"].isNotNull() & (lost <= FACE_HOLD[profile]) & ~x["cut"]
        moves = (kind == "none") & ~x["cut"] & x["motion"].isNotNull()
        follows = F.when(kind.isin("jump", "blend", "wait"), "speaker").when(held, "speaker_hold").when(kind == "quiet", "face_group").when(kind == "one", "face").when(keeps, "face_hold").when(moves, "motion").otherwise("center")
        raw = F.when(kind.isin("jump", "blend", "wait"), active).when(held, s["active"]).when(kind == "quiet", x["middle"]).when(kind == "one", b["largest"]).when(keeps, s["previous"]).when(moves, x["motion"]).otherwise(MIDDLE)
        return F.struct(
            active.alias("active"), F.when(waits, b["pending"]).when(ends, null).otherwise(s["pending"]).alias("pending"), F.when(waits, b["n"]).when(ends, 0).otherwise(s["pending_n"]).alias("pending_n"), since.alias("since_active"),
            F.when(kind == "none", lost).otherwise(0).alias("since_face"), F.when(kind == "none", s["previous"]).otherwise(raw).alias("previous"), follows.alias("follows"),
            F.least(F.lit(RIGHT_EDGE), F.greatest(F.lit(LEFT_EDGE), raw)).alias("target"), ((kind == "jump") & s["active"].isNotNull() | (kind == "wait") & confirmed).alias("switched"),
        )

    def _done(a, x, s, m):
        by = lambda i: F.lit(CAMERA[profile][i]) if profile in CAMERA else F.when(m["follows"].startswith("speaker"), CAMERA["speaker"][i]).when(m["follows"].startswith("face"), CAMERA["face"][i]).otherwise(CAMERA["other"][i])
        moved = s["camera"] + F.least(by(0), F.greatest(-by(0), m["target"] - s["camera"])) * by(1)
        camera = F.least(F.lit(RIGHT_EDGE), F.greatest(F.lit(LEFT_EDGE), moved))
        kept = [m[c].alias(c) for c in ("active", "pending", "pending_n", "since_active", "since_face", "previous")]
        told = F.struct(x["t"].alias("t"), m["target"].alias("target"), camera.alias("camera"), m["follows"].alias("follows"), m["switched"].alias("switched"))
        return F.struct(*kept, camera.alias("camera"), F.concat(a["path"], F.array(told)).alias("path"))

    return step


def followed(samples: DataFrame, key: str, profile: str = "standard") -> DataFrame:
    """(key, t, target, camera, follows, switched) of every sample: the followed centre, the smoothed camera, what is followed.

    Someone else must speak in two samples running before the camera turns, unless the one followed has gone. A cut
    begins anew. Of equally active or large faces, the first detected counts. A sample without faces holds the last
    face for a while, then follows motion, then the middle. Null faces are none; null cut or speech counts as false.
    """
    x = samples.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("cut", "speech")})
    names = ("t", "cut", "speech", "motion", "n", "faces", "important", "middle", "sure", "speaker")
    rows = seen(x, key, profile).groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*names))).alias("x"))
    start = F.expr(f"named_struct('active', cast(null as double), 'pending', cast(null as double), 'pending_n', 0, 'since_active', {LONG_AGO}, 'since_face', {LONG_AGO}, 'previous', cast(null as double), 'camera', cast({MIDDLE} as double), 'path', cast(array() as array<struct<{TARGET.replace(' ', ':').replace(',:', ',')}>>))")
    return rows.select(key, F.explode(F.aggregate("x", start, _step(profile))["path"]).alias("p")).select(key, "p.*")
