"""Transcript and clip edits: new words on the old rhythm, segments replaced in a range, clip times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tokens(c: Column) -> Column:
    return F.filter(F.split(F.coalesce(c, F.lit("")), r"\s+"), lambda w: w != "")


def _let(value: Column, f) -> Column:
    """f(value) with value worked out once."""
    return F.transform(F.array(value), f)[0]


def blended(values: Column, at: Column) -> Column:
    """The value at a fractional place (from 0) of a list, between its neighbours; the ends beyond the ends."""
    last = F.size(values) - 1

    def one(p: Column) -> Column:
        left = F.floor(p).cast("int")
        inside = F.get(values, left) * (1.0 - (p - left)) + F.get(values, F.least(last, left + 1)) * (p - left)
        return F.when(F.size(values) == 0, 0.0).when(p <= 0, F.get(values, F.lit(0))).when(p >= last, F.get(values, last)).otherwise(inside)

    return _let(at, one)


def retimed(edits: DataFrame) -> DataFrame:
    """edits(lo, hi, text, old) with the words of the edited segment: struct(start, end, word), none for empty text.

    old: struct(start, end) of the words that overlap the range, in order. As
    many words as before take their times; another number is laid over the
    boundaries of the old ones, pauses included; without old words they are
    spread evenly. old is one range's words, of bounded number.
    """
    lo, hi, n, m = F.col("lo"), F.col("hi"), F.size("_t"), F.size("old")
    x = edits.withColumn("_t", tokens(F.col("text")))
    same = F.zip_with("old", "_t", lambda o, w: F.struct(F.greatest(lo, o["start"]).alias("start"), F.least(hi, o["end"]).alias("end"), w.alias("word")))
    middle = F.transform(F.slice("old", F.lit(1), F.greatest(F.lit(0), m - 1)), lambda o, i: (F.least(hi, o["end"]) + F.greatest(lo, F.get("old", i + 1)["start"])) / 2.0)
    first, last = F.greatest(lo, F.get("old", F.lit(0))["start"]), F.least(hi, F.element_at("old", -1)["end"])
    # each boundary is no earlier than the one before
    risen = _let(middle, lambda v: F.transform(v, lambda _, i: F.greatest(first, F.array_max(F.slice(v, F.lit(1), i + 1)))))
    walls = F.when(last <= first, F.array(lo, hi)).otherwise(F.concat(F.array(first), risen, F.array(last)))
    old_n = F.greatest(F.lit(1), m)

    def laid(walls: Column, w: Column, i: Column) -> Column:
        ends = F.struct(blended(walls, i / n * old_n).alias("a"), blended(walls, (i + 1) / n * old_n).alias("b"))
        return _let(ends, lambda e: F.struct(e["a"].alias("start"), F.when(e["b"] <= e["a"], F.least(hi, e["a"] + 0.05)).otherwise(e["b"]).alias("end"), w.alias("word")))

    again = _let(walls, lambda v: F.transform("_t", lambda w, i: laid(v, w, i)))
    span = F.greatest(F.lit(0.1), hi - lo)
    even = F.transform("_t", lambda w, i: F.struct((lo + span * (i / n)).alias("start"), (lo + span * ((i + 1) / n)).alias("end"), w.alias("word")))
    return x.withColumn("words", F.when(m == n, same).when(m > 0, again).otherwise(even)).drop("_t")


def segment_of(edited: DataFrame) -> DataFrame:
    """The edited segment of each range with words: from its first word to its last, 0.05 s at least."""
    start, end = F.get("words", F.lit(0))["start"], F.element_at("words", -1)["end"]
    none = F.size("old") == 0
    x = edited.where(F.size("words") > 0)
    return x.withColumns({"start": F.when(none, F.col("lo")).otherwise(start), "end": F.when(none, F.col("hi")).otherwise(F.greatest(start + 0.05, F.least(F.col("hi"), end))), "text": F.array_join(tokens(F.col("text")), " ")})


def replaced(segments: DataFrame, edits: DataFrame, job: str = "job_id") -> DataFrame:
    """segments(job, start, end, text) without those that touch a range of edits(job, lo, hi), and with edits' own (start, end, text)."""
    ranges = edits.select(F.col(job).alias("_j"), "lo", "hi")
    kept = segments.join(ranges, (F.col(job) == F.col("_j")) & (F.col("end") >= F.col("lo")) & (F.col("start") <= F.col("hi")), "left_anti")
    new = segment_of(edits).select(job, "start", "end", "text")
    return kept.select(job, "start", "end", "text").unionByName(new)


def timed(clips: DataFrame, asked: DataFrame, keys: list[str], most: float = 180.0) -> DataFrame:
    """clips(keys, start, end) with the times that asked(keys, new_start, new_end) gives, and why not where it can't be."""
    x = clips.join(asked, keys, "left")
    why = F.when(F.col("new_start").isNull(), F.lit(None)).when(F.col("new_end") <= F.col("new_start"), "end before start").when(F.col("new_end") - F.col("new_start") > most, "over 180 seconds")
    good = F.col("new_start").isNotNull() & why.isNull()
    return x.withColumns({"refused": why, "start": F.when(good, F.round("new_start", 3)).otherwise(F.col("start")), "end": F.when(good, F.round("new_end", 3)).otherwise(F.col("end"))}).drop("new_start", "new_end")
