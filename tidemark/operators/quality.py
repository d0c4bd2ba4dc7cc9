"""Transcript quality from word probabilities."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def repeats(words: DataFrame) -> DataFrame:
    """(job_id, n_tokens, repeated): places where a run of 2, 3 or 4 tokens is followed by itself."""
    t = words.select("job_id", "seg_ix", "word_ix", F.lower(F.regexp_replace("word", r"[^\p{L}\p{N}_']+", "")).alias("tok")).where("tok <> ''")
    by = Window.partitionBy("job_id").orderBy("seg_ix", "word_ix")
    same = t.withColumns({f"e{n}": F.coalesce(F.col("tok") == F.lag("tok", n).over(by), F.lit(False)).cast("int") for n in (2, 3, 4)})
    hits = [(F.sum(f"e{n}").over(by.rowsBetween(-(n - 1), 0)) == n).cast("int") for n in (2, 3, 4)]
    return same.select("job_id", reduce(lambda a, b: a + b, hits).alias("h")).groupBy("job_id").agg(F.count("*").alias("n_tokens"), F.sum("h").cast("long").alias("repeated"))


def sums(segs: DataFrame, words: DataFrame) -> DataFrame:
    """(job_id, segment_count, n, s, n48, n25, weak, weakest) for each job of segs: what quality's measures are made of.

    n words with probabilities whose sum is s hundredths, n48 and n25 of them below 0.48 and 0.25; weak long segments and
    the least mean of a long segment.
    """
    live = segs.where("trim(text) <> ''").select("job_id", "seg_ix")
    w = live.join(words, ["job_id", "seg_ix"], "left").withColumn("tok", F.lower(F.regexp_replace("word", r"[^\p{L}\p{N}_']+", "")) != "")
    by_seg = w.groupBy("job_id", "seg_ix").agg(F.count("pct").alias("n"), F.sum("pct").alias("s"), F.count_if(F.col("pct") < 38).alias("n38"), F.count_if(F.col("pct") < 48).alias("n48"), F.count_if(F.col("pct") < 25).alias("n25"), F.count_if("tok").alias("toks"))
    long = (F.col("n") > 0) & (F.col("toks") >= 3)
    mean = F.col("s") / F.col("n") / 100
    weak = long & ((mean < 0.56) | (F.col("n38") / F.col("n") > 0.28))
    return by_seg.groupBy("job_id").agg(F.count("*").alias("segment_count"), F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("n48").alias("n48"), F.sum("n25").alias("n25"), F.count_if(weak).alias("weak"), F.min(F.when(long, mean)).alias("weakest"))


def quality(segs: DataFrame, words: DataFrame) -> DataFrame:
    """One row of quality measures for each job of segs(job_id, seg_ix, text); words carry pct, a probability in hundredths."""
    live = segs.where("trim(text) <> ''").select("job_id", "seg_ix")
    x = sums(segs, words).join(repeats(words.join(live, ["job_id", "seg_ix"], "left_semi")), "job_id", "left")
    share = lambda c: F.when(F.col("n") > 0, F.col(c) / F.col("n")).otherwise(0.0)
    x = x.withColumns({"avg_p": F.when(F.col("n") > 0, F.col("s") / F.col("n") / 100).otherwise(0.74), "low": share("n48"), "very": share("n25"), "rep": F.coalesce("repeated", F.lit(0)) / F.greatest(F.lit(1), F.coalesce("n_tokens", F.lit(0)))})
    score = F.col("avg_p") * 100 - F.col("low") * 24 - F.col("very") * 26 - F.least(F.lit(18.0), F.col("rep") * 120) - F.least(F.lit(12.0), F.col("weak") * 2.5)
    x = x.withColumns({"weakest": F.coalesce("weakest", "avg_p"), "score": F.greatest(F.lit(0.0), F.least(F.lit(100.0), score))})
    needs = (F.col("avg_p") < 0.72) | (F.col("low") > 0.18) | (F.col("very") > 0.07) | (F.col("rep") > 0.035) | (F.col("weakest") < 0.5) | (F.col("weak") >= 2)
    return x.select("job_id", "score", "avg_p", "weakest", F.col("weak").alias("weak_segments"), "low", "very", "rep", F.coalesce("n_tokens", F.lit(0)).alias("word_count"), "segment_count", needs.alias("needs_refinement"))


def better(first: DataFrame, second: DataFrame) -> DataFrame:
    """(job_id, use_second): a second transcript is taken where its rounded measures are clearly better somewhere."""
    a, b = (q.select("job_id", F.round("score", 2).alias(f"s{k}"), F.round("low", 4).alias(f"l{k}"), F.round("weakest", 4).alias(f"w{k}"), F.col("segment_count").alias(f"n{k}")) for k, q in ((1, first), (2, second)))
    x = a.join(b, "job_id", "full_outer")
    none = F.coalesce("n1", F.lit(0)) == 0
    gain = (F.col("s2") >= F.col("s1") + 1.5) | (F.col("l2") <= F.col("l1") - 0.04) | (F.col("w2") >= F.col("w1") + 0.10) & (F.col("s2") >= F.col("s1") - 5)
    return x.select("job_id", F.coalesce((F.coalesce("n2", F.lit(0)) > 0) & (none | gain), F.lit(False)).alias("use_second"))
