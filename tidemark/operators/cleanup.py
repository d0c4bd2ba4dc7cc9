"""What a clean-up of projects' files removes, by rules on paths, and what it leaves."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Patterns of paths inside a project's folder.
DISPOSABLE = {"audio": r"^audio/", "preview": r"^clips/preview_[^/]*\.mp4$", "captions": r"^clips/captions_[^/]*\.ass$", "reframe": r"^clips/reframe_[^/]*\.json$", "partial": r"(^|/)[^/]*\.part\.[^/]*$", "temporary": r"(^|/)[^/]*\.tmp$"}
SOURCE = r"^(normalized\.mp4|source\.[^/]*)$"
RENDER = r"^clips/(?!preview_)[^/]*\.mp4$"
TRANSCRIPT = "transcript.json"


def rule(path: Column) -> Column:
    """The first rule by which a file can go, or null: project and transcript documents, renders, covers and packages stay."""
    return F.coalesce(*[F.when(path.rlike(p), k) for k, p in DISPOSABLE.items()])


def _judged(files: DataFrame) -> DataFrame:
    return files.withColumns({"_rule": rule(F.col("path")), "_source": F.col("path").rlike(SOURCE)})


def cleaned(files: DataFrame, requests: DataFrame) -> DataFrame:
    """(job_id, refused, removed_files, removed_bytes, bytes_before, bytes_after, source_removed, source_available) of each request.

    files(job_id, path, bytes), requests(job_id, remove_source). The source goes only where that is asked for, and where
    nothing has been rendered yet the whole request is refused. One aggregation of counts and sums, and a join with the
    requests; files of other jobs don't count.
    """
    own = F.col("_rule").isNotNull()
    extra = F.col("_source") & ~own
    n = lambda cond: F.count_if(cond)
    size = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("bytes"))), F.lit(0).cast("long"))
    x = _judged(files).groupBy("job_id").agg(
        size(F.lit(True)).alias("bytes_before"), n(own).alias("_n"), size(own).alias("_b"), n(extra).alias("_sn"), size(extra).alias("_sb"),
        F.bool_or(F.col("path").rlike(RENDER) & ~own).alias("_rendered"), F.bool_or(extra & (F.col("bytes") > 0)).alias("_available"),
    )
    x = requests.join(x, "job_id", "left").fillna(0, ["bytes_before", "_n", "_b", "_sn", "_sb"]).fillna(False, ["_rendered", "_available"])
    x = x.withColumn("refused", F.col("remove_source") & ~F.col("_rendered"))
    takes = F.col("remove_source") & ~F.col("refused")
    both = lambda a, b: F.when(F.col("refused"), 0).otherwise(F.col(a) + F.when(takes, F.col(b)).otherwise(0))
    x = x.withColumns({"removed_files": both("_n", "_sn"), "removed_bytes": both("_b", "_sb")})
    return x.select("job_id", "refused", "removed_files", "removed_bytes", "bytes_before", (F.col("bytes_before") - F.col("removed_bytes")).alias("bytes_after"), (takes & (F.col("_sn") > 0)).alias("source_removed"), (F.col("_available") & ~takes).alias("source_available"))


def doomed(files: DataFrame, requests: DataFrame) -> DataFrame:
    """The files that the requests remove, each with its rule ('source' for sources)."""
    allowed = cleaned(files, requests).where("not refused").select("job_id").join(requests, "job_id")
    x = _judged(files).join(allowed, "job_id")
    why = F.coalesce("_rule", F.when(F.col("_source") & F.col("remove_source"), "source"))
    return x.withColumn("rule", why).where("rule is not null").drop("_rule", "_source", "remove_source")


def stale(files: DataFrame) -> DataFrame:
    """Leftovers of runs that were cut off: partial and temporary files anywhere, and the audio of jobs with a transcript."""
    leftover = reduce(lambda a, b: a | b, [F.col("path").rlike(DISPOSABLE[k]) for k in ("partial", "temporary")])
    done = files.where(F.col("path") == TRANSCRIPT).select("job_id", F.lit(True).alias("_done")).distinct()
    x = files.join(done, "job_id", "left")
    audio = F.coalesce("_done", F.lit(False)) & F.col("path").rlike(DISPOSABLE["audio"]) & ~F.col("job_id").startswith("_")
    return x.where(leftover | audio).withColumn("rule", F.when(leftover, "leftover").otherwise("audio")).drop("_done")


def available(files: DataFrame) -> DataFrame:
    """(job_id, available): the job still has a source that isn't empty."""
    return files.groupBy("job_id").agg(F.bool_or(F.col("path").rlike(SOURCE) & (F.col("bytes") > 0)).alias("available"))
