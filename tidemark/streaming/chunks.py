"""Transcripts that arrive chunk by chunk: appended by batch, with offsets, and read as the best attempt at each chunk.

A batch writes to a folder of its own number and replaces what an earlier try at the same batch left there, so a batch
that is run again after a failure adds nothing. A chunk that is sent again in another batch is one more attempt; sent
twice in a batch, it counts once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

SEGMENT = "job_id long, chunk_ix int, attempt int, seg_no int, start_cs long, end_cs long, text string, pct double"


def arriving(spark: SparkSession, folder: str, files_per_batch: int = 1) -> DataFrame:
    """Segments of chunks, with times from each chunk's beginning; a chunk without speech is a row without a text."""
    return spark.readStream.schema(SEGMENT).option("maxFilesPerTrigger", files_per_batch).json(folder)


def placed(rows: DataFrame, chunk_cs: int) -> DataFrame:
    """rows with times from the job's beginning."""
    off = F.col("chunk_ix").cast("long") * chunk_cs
    return rows.withColumns({"start_cs": F.col("start_cs") + off, "end_cs": F.col("end_cs") + off})


def append(stream: DataFrame, table: str, checkpoint: str, chunk_cs: int, before_write: Callable[[int], None] = lambda batch: None) -> StreamingQuery:
    """Starts the stream into table/batch=<number>; goes on from the checkpoint if there is one."""

    def write(rows: DataFrame, batch: int) -> None:
        before_write(batch)
        placed(rows.dropDuplicates(["job_id", "chunk_ix", "attempt", "seg_no"]), chunk_cs).write.mode("overwrite").parquet(f"{table}/batch={batch}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def attempts(spark: SparkSession, table: str) -> DataFrame:
    """(job_id, chunk_ix, batch, attempt, n, quality) of every attempt at a chunk; quality: mean probability less a share for empty texts."""
    rows = spark.read.schema(f"{SEGMENT}, batch long").parquet(table)
    return rows.groupBy("job_id", "chunk_ix", "batch", "attempt").agg(F.count_if(F.trim("text") != "").alias("n"), F.coalesce(F.avg("pct"), F.lit(0.0)).alias("quality"))


def transcript(spark: SparkSession, table: str) -> DataFrame:
    """(job_id, seg_ix, start_cs, end_cs, text) of the best attempt at each chunk, in order.

    An attempt with speech beats one without, then the higher quality counts, then the first one. Chosen by one partial
    aggregation of small rows, and a join by chunk.
    """
    from pyspark.sql import Window

    rows = spark.read.schema(f"{SEGMENT}, batch long").parquet(table)
    order = F.struct((F.col("n") > 0).alias("a"), "quality", (-F.col("batch")).alias("b"), (-F.col("attempt")).alias("c"))
    best = attempts(spark, table).groupBy("job_id", "chunk_ix").agg(F.max_by(F.struct("batch", "attempt"), order).alias("x")).select("job_id", "chunk_ix", "x.*")
    kept = rows.join(best, ["job_id", "chunk_ix", "batch", "attempt"]).where("trim(text) <> ''")
    # numbers run on through a job's chunks: counts of the chunks before, then places in the chunk
    sizes = kept.groupBy("job_id", "chunk_ix").agg(F.count("*").alias("n"))
    before = sizes.select("job_id", "chunk_ix", (F.sum("n").over(Window.partitionBy("job_id").orderBy("chunk_ix")) - F.col("n")).alias("first"))
    place = F.row_number().over(Window.partitionBy("job_id", "chunk_ix").orderBy("start_cs", "seg_no"))
    return kept.join(before, ["job_id", "chunk_ix"]).select("job_id", (F.col("first") + place - 1).cast("int").alias("seg_ix"), "start_cs", "end_cs", "text")
