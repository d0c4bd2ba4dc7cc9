"""Projects, tasks and caches as tables: upserts, latest states, retention, searches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The rows of both; where both have the key, new values replace old ones unless they are null."""
    both = old.alias("o").join(new.alias("n"), key, "full_outer")
    names = list(dict.fromkeys([*old.columns, *new.columns]))
    pick = lambda c: F.coalesce(*[F.col(f"{a}.{c}") for a, df in (("n", new), ("o", old)) if c in df.columns])
    return both.select(key, *[pick(c).alias(c) for c in names if c != key])


def migrate(projects: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """projects with missing or null fields set to their defaults; no field is dropped or retyped."""
    return projects.withColumns({c: F.coalesce(F.col(c), v) if c in projects.columns else v for c, v in defaults.items()})


def latest(events: DataFrame, key: str, at: str, tie: str) -> DataFrame:
    """The last event of each key: one partial aggregation."""
    rest = [c for c in events.columns if c != key]
    return events.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(at, tie)).alias("_x")).select(key, "_x.*")


def task_states(events: DataFrame, key: str, at: str, tie: str, failed: str, done: str) -> DataFrame:
    """The state of each task from events(key, at, tie, kind, progress, cancel): one partial aggregation."""
    last = F.max_by(F.struct("kind", "progress"), F.struct(at, tie))
    x = events.groupBy(key).agg(last.alias("_l"), F.max(at).alias(at), F.bool_or("cancel").alias("_stop"))
    kind = F.col("_l.kind")
    status = F.when(F.col("_stop"), "cancelled").when(kind == failed, "failed").when(kind == done, "completed").otherwise("running")
    return x.select(key, status.alias("status"), F.when(status == "completed", 100).otherwise(F.greatest(F.lit(0), F.least(F.lit(100), F.col("_l.progress")))).alias("progress"), at)


def recovered(tasks: DataFrame) -> DataFrame:
    """Tasks as found after a crash: what was queued or running has failed and can be resumed."""
    hit = F.col("status").isin("queued", "running")
    return tasks.withColumns({"recoverable": F.when(hit, True).otherwise(F.col("recoverable")), "stage": F.when(hit, "Interrupted").otherwise(F.col("stage")), "status": F.when(hit, "failed").otherwise(F.col("status"))})


def newest(tasks: DataFrame, at: str, tie: str, most: int = 250) -> DataFrame:
    return tasks.orderBy(F.desc(at), F.desc(tie)).limit(most)


def best(rows: DataFrame, replaced: DataFrame, group: str, place: str, score: str, most: int = 3) -> DataFrame:
    """The rows of the highest scores in each group with their rank, without replaced(group, place); ties: by place."""
    left = rows.join(replaced, [group, place], "left_anti")
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc(score), place))
    return left.withColumn("rank", rank).where(F.col("rank") <= most)


def retained(entries: DataFrame, key: str, at: str, size: str, tie: str, now: Column, max_age: Column, max_bytes: int) -> DataFrame:
    """entries with kept: not older than max_age, and among the newest of their key that fit into max_bytes."""
    fresh = entries.withColumn("_fresh", F.col(at) >= now - max_age)
    by = Window.partitionBy(key, "_fresh").orderBy(F.desc(at), F.desc(tie)).rowsBetween(Window.unboundedPreceding, 0)
    return fresh.withColumn("kept", F.col("_fresh") & (F.sum(size).over(by) <= max_bytes)).drop("_fresh")


def found(projects: DataFrame, query: str, title: str, author: str) -> DataFrame:
    return projects.where(F.contains(F.lower(F.concat_ws(" ", title, author)), F.lit(query.strip().lower())))


def safe_name(c: Column, fallback: str = "clip") -> Column:
    """A download name: the whole title's letters, digits and hyphens, at most 80 characters of them, and .mp4."""
    raw = F.regexp_replace(F.btrim(F.coalesce(c, F.lit("")), F.lit(" \t\n\r\x0b\x0c")), r"(?i)\.mp4$", "")
    x = F.regexp_replace(F.regexp_replace(raw, r"[^A-Za-z0-9 _-]+", ""), r"[ _]+", "-")
    x = F.left(F.btrim(x, F.lit("-_")), F.lit(80))
    return F.concat(F.when(x == "", fallback).otherwise(x), F.lit(".mp4"))


def copyright_host(url: Column, hosts: tuple[str, ...]) -> Column:
    return F.lower(F.parse_url(url, F.lit("HOST"))).isin(*hosts)
