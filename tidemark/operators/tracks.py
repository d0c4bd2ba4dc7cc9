"""Tracks over time: camera stabilising, smoothing, simplification; speech-time tests and sample plans."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _ordered(points: DataFrame, key: str) -> DataFrame:
    return points.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("t", "c"))).alias("p"))


def stabilise(points: DataFrame, key: str, dead: float = 0.075, settle: float = 0.05, trigger: int = 2, jump: float = 0.155, least: float = 0.018, speed: float = 0.16) -> DataFrame:
    """(key, t, camera) for points(key, t, c): a camera that holds still in a comfort zone and moves no faster than speed.

    A fold over each track; a track is one clip's samples, of bounded number.
    """
    clip = lambda x: F.least(F.lit(0.9), F.greatest(F.lit(0.1), x))
    start = F.struct(clip(F.col("p")[0]["c"]).alias("camera"), F.lit(0).alias("out"), F.array(F.struct(F.col("p")[0]["t"].alias("t"), clip(F.col("p")[0]["c"]).alias("camera"))).alias("path"))

    def step(a, x):
        target = clip(x["c"])
        d = target - a["camera"]
        outside = F.when(F.abs(d) <= dead, 0).otherwise(a["out"] + 1)
        wanted = clip(target - F.when(d > 0, 1.0).otherwise(-1.0) * settle) - a["camera"]
        moves = (F.abs(d) > dead) & ((outside >= max(1, trigger)) | (F.abs(d) >= jump)) & (F.abs(wanted) >= least)
        most = speed * F.greatest(F.lit(0.001), x["t"] - F.element_at(a["path"], -1)["t"])
        now = F.when(moves, clip(a["camera"] + F.least(most, F.greatest(-most, wanted)))).otherwise(a["camera"])
        count = F.when(moves & (F.abs(target - now) <= dead), 0).otherwise(outside)
        return F.struct(now.alias("camera"), count.alias("out"), F.concat(a["path"], F.array(F.struct(x["t"].alias("t"), now.alias("camera")))).alias("path"))

    folded = _ordered(points, key).select(key, F.aggregate(F.slice("p", F.lit(2), F.greatest(F.lit(0), F.size("p") - 1)), start, step)["path"].alias("path"))
    return folded.select(key, F.explode("path").alias("x")).select(key, "x.t", "x.camera")


def without_holds(path: DataFrame, key: str) -> DataFrame:
    """The path's ends and the samples where the camera moves."""
    from pyspark.sql import Window

    by = Window.partitionBy(key).orderBy("t")
    before, after = F.lag("camera").over(by), F.lead("camera").over(by)
    x = path.withColumns({"_b": before, "_a": after})
    return x.where("_b is null or _a is null or abs(camera - _b) > 0.0005 or abs(_a - camera) > 0.0005").drop("_a", "_b")


def smooth(points: DataFrame, key: str, step: float = 0.08, alpha: float = 0.5) -> DataFrame:
    """(key, last): an exponential mean from 0.5 whose moves are cut to step before they are weighed."""
    fold = lambda a, x: a + F.least(F.lit(step), F.greatest(F.lit(-step), x["c"] - a)) * alpha
    return _ordered(points, key).select(key, F.aggregate("p", F.lit(0.5), fold).alias("last"))


def simplify(points: DataFrame, key: str, most: int = 72) -> DataFrame:
    """(key, t, c): each track as at most `most` points of a Ramer-Douglas-Peucker simplification, ends kept.

    Points less than half a millisecond before the next are left out, and so are points without a time. Tracks of at most
    `most` points are whole then and stay in columns; only longer ones go to Python, a track at a time.
    """
    from pyspark.sql import Window

    def one(x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values("t", kind="stable")
        t, c = x["t"].to_numpy(float), x["c"].to_numpy(float)
        kept, tolerance = list(range(len(t))), 0.004
        while len(kept) > most and tolerance < 0.08 * 1.45:
            kept, todo = [0, len(t) - 1], [(0, len(t) - 1)]
            while todo:
                a, b = todo.pop()
                if b - a > 1:
                    expected = c[a] + (c[b] - c[a]) * (t[a + 1 : b] - t[a]) / max(1e-9, t[b] - t[a])
                    error = abs(c[a + 1 : b] - expected)
                    k = int(error.argmax())
                    if error[k] > tolerance:
                        kept.append(a + 1 + k)
                        todo += [(a, a + 1 + k), (a + 1 + k, b)]
            kept.sort()
            tolerance *= 1.45
        if len(kept) > most:
            kept = [kept[round(i * (len(kept) - 1) / (most - 1))] for i in range(most)]
        return pd.DataFrame({key: x[key].iloc[0], "t": t[kept], "c": c[kept]})

    kind = dict(points.dtypes)[key]
    by = Window.partitionBy(key)
    x = points.where("t is not null").select(key, F.col("t").cast("double").alias("t"), F.col("c").cast("double").alias("c"))
    x = x.withColumn("_near", F.lead("t").over(by.orderBy("t", "c")) - F.col("t") < 0.0005).where("_near is null or not _near").drop("_near").withColumn("_n", F.count("*").over(by))
    short, long = x.where(F.col("_n") <= most).drop("_n"), x.where(F.col("_n") > most).drop("_n")
    return short.unionByName(long.groupBy(key).applyInPandas(one, f"{key} {kind}, t double, c double"))


def speech_active(samples: DataFrame, speech: DataFrame, key: str, slack_cs: int = 12) -> DataFrame:
    """samples(key, t_cs) with active: within the slack of an interval of speech(key, start_cs, end_cs), or no intervals at all."""
    s = speech.withColumnRenamed(key, "_key")
    hit = samples.join(s, (F.col(key) == F.col("_key")) & (F.col("t_cs") >= F.col("start_cs") - slack_cs) & (F.col("t_cs") <= F.col("end_cs") + slack_cs), "left_semi").select(key, "t_cs", F.lit(True).alias("_hit")).distinct()
    some = speech.select(key, F.lit(True).alias("_some")).distinct()
    return samples.join(hit, [key, "t_cs"], "left").join(some, key, "left").withColumn("active", F.coalesce("_hit", F.col("_some").isNull())).drop("_hit", "_some")


def sample_plan(clips: DataFrame, most: int = 120, least_cs: int = 45) -> DataFrame:
    """clips(lo, hi) with one row for each sample time t_cs: evenly spread, at most `most`, least_cs apart or more."""
    step = F.greatest(F.lit(least_cs), F.ceil((F.col("hi") - F.col("lo")) / most)).cast("long")
    return clips.withColumn("t_cs", F.explode(F.sequence(F.col("lo"), F.col("hi") - 1, step)))


def face_bands(faces: DataFrame, sample: list[str], least: float = 0.35) -> DataFrame:
    """(sample, important, center_y, band) for faces(sample, y, area): the mean height by area of all faces not much smaller than the largest."""
    top = faces.groupBy(*sample).agg(F.max("area").alias("_top"))
    x = faces.join(top, sample).where(F.col("area") >= F.col("_top") * least)
    x = x.groupBy(*sample).agg(F.count("*").alias("important"), (F.sum(F.col("y") * F.col("area")) / F.greatest(F.lit(1), F.sum("area"))).alias("center_y"))
    return x.withColumn("band", F.when(F.col("center_y") < 0.38, "upper").when(F.col("center_y") < 0.68, "middle").otherwise("lower"))


def piecewise(track: DataFrame, key: str) -> DataFrame:
    """(key, expression): the crop's left edge as nested conditions over time, from points(key, t, c), with a line between neighbours.

    A fold from the last point to the first. Points less than half a millisecond before the next are left out; a track
    of one point is a constant. Tracks are simplified before, so the nesting is bounded.
    """
    from pyspark.sql import Window

    near = F.lead("t").over(Window.partitionBy(key).orderBy("t", "c")) - F.col("t") < 0.0005
    kept = track.where("t is not null and c is not null").withColumn("_near", F.coalesce(near, F.lit(False))).where("not _near")
    p = F.array_sort(F.collect_list(F.struct("t", "c")))
    edge = lambda c: F.format_string("clip(%.6f*iw-ow/2,0,iw-ow)", c)

    def step(a, x):
        span = F.greatest(F.lit(0.001), a["t"] - x["t"])
        line = F.format_string("if(lt(t,%.3f),clip((%.6f+(%.6f)*(t-%.3f)/%.3f)*iw-ow/2,0,iw-ow),", a["t"], x["c"], a["c"] - x["c"], x["t"], span)
        return F.struct(x["t"].alias("t"), x["c"].alias("c"), F.concat(line, a["e"], F.lit(")")).alias("e"))

    last = F.element_at("p", -1)
    start = F.struct(last["t"].alias("t"), last["c"].alias("c"), edge(last["c"]).alias("e"))
    return kept.groupBy(key).agg(p.alias("p")).select(key, F.aggregate(F.reverse(F.slice("p", F.lit(1), F.size("p") - 1)), start, step)["e"].alias("expression"))
