"""Structured Streaming over timed events: sessions by gap, running tracks, latest states."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, folder: str, files_per_batch: int = 1) -> DataFrame:
    """The events of a folder as a stream, with ts as a timestamp."""
    schema = spark.read.parquet(folder).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(user_id, start, end, n): a user's events without a pause of `gap`; works on streams and on tables."""
    x = events.withWatermark("ts", late) if events.isStreaming else events
    return x.groupBy("user_id", F.session_window("ts", gap)).agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, event_type, n) by tumbling windows."""
    x = events.withWatermark("ts", late) if events.isStreaming else events
    return x.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


def running_mean(events: DataFrame, step: float = 10.0, alpha: float = 0.5) -> DataFrame:
    """(user_id, last): a smoothed value for each user that goes on from batch to batch."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        (last,) = state.get if state.exists else (0.0,)
        for v in pd.concat(list(batches)).sort_values(["ts", "event_id"])["value"]:
            last += min(step, max(-step, v - last)) * alpha
        state.update((last,))
        yield pd.DataFrame({"user_id": [key[0]], "last": [last]})

    return events.groupBy("user_id").applyInPandasWithState(update, "user_id long, last double", "last double", "update", "NoTimeout")


def drained(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there now and returns what it wrote."""
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)
