"""Interval joins. Strictness at the ends differs by operator and is always named."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def overlaps(start: Column, end: Column, lo: Column, hi: Column, closed: bool = False, slack=0) -> Column:
    """Whether [start, end] meets [lo, hi]: open (a shared end doesn't count) or closed; slack widens [lo, hi]."""
    lo, hi = lo - slack, hi + slack
    return (end >= lo) & (start <= hi) if closed else (end > lo) & (start < hi)


def interval_join(left: DataFrame, right: DataFrame, key: str, lo: str, hi: str, closed: bool = False, slack=0, how: str = "inner") -> DataFrame:
    """left(key, lo, hi, ...) with the rows of right(key, start_cs, end_cs, ...) that meet its interval.

    The key makes it an equi-join with the overlap as its residual condition.
    """
    right = right.withColumnRenamed(key, "_key")
    return left.join(right, (F.col(key) == F.col("_key")) & overlaps(F.col("start_cs"), F.col("end_cs"), F.col(lo), F.col(hi), closed, slack), how).drop("_key")


def bucketed_interval_join(left: DataFrame, right: DataFrame, key: str, lo: str, hi: str, width: int, closed: bool = False) -> DataFrame:
    """The same rows as interval_join, dealt by (key, time bucket): for keys that hold a large share of all rows.

    Both sides are listed under every bucket that they touch, and a pair counts in the first bucket that both touch.
    """
    span = lambda a, b: F.sequence((a / width).cast("long"), (b / width).cast("long"))
    l = left.withColumn("_bucket", F.explode(span(F.floor(F.col(lo)), F.floor(F.col(hi)))))
    r = right.withColumnRenamed(key, "_key").withColumn("_b", F.explode(span(F.col("start_cs"), F.col("end_cs"))))
    both = l.join(r, (F.col(key) == F.col("_key")) & (F.col("_bucket") == F.col("_b")) & overlaps(F.col("start_cs"), F.col("end_cs"), F.col(lo), F.col(hi), closed))
    first = F.greatest((F.floor(F.col(lo)) / width).cast("long"), (F.col("start_cs") / width).cast("long"))
    return both.where(F.col("_bucket") == first).drop("_key", "_b", "_bucket")


def clamp(df: DataFrame, lo: str, hi: str) -> DataFrame:
    """Times cut to [lo, hi] and counted from lo; empty ones go."""
    a, b = F.greatest("start_cs", lo) - F.col(lo), F.least("end_cs", hi) - F.col(lo)
    return df.withColumns({"rel_start": a, "rel_end": b}).where("rel_end > rel_start")


def in_order(group: list[str], value: str, order: list[str], sep: str, name: str):
    """groupBy(group) joining value by sep in the given order."""

    def run(df: DataFrame) -> DataFrame:
        rows = F.array_sort(F.collect_list(F.struct(*order, F.col(value).alias("_v"))))
        return df.groupBy(*group).agg(F.array_join(F.transform(rows, lambda x: x["_v"]), sep).alias(name))

    return run
