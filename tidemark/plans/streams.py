"""Queries that run a stream over files derived from the given tables and return what it wrote."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.plans import speakers
from tidemark.plans import sqltext as S
from tidemark.plans.transcript import query
from tidemark.sources import bridge
from tidemark.sources.shared import shared
from tidemark.streaming import chunks, tracker

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Length of a chunk, in hundredths of a second.
CHUNK = 6000


@query(speakers.SQL)
def stm4_tracker(spark, d):
    """The followed speakers of a stream of samples in no order, with state across batches (STM-4); the same rows as seq7_speakers."""
    folder = shared(spark, "samples")
    x = speakers.samples(spark, d).withColumn("at", F.timestamp_seconds(1_700_000_000 + F.col("t") * 7200)).drop("t")
    files = max(3, int(spark.conf.get("spark.sql.shuffle.partitions")))  # all cores write and read, in no order
    x.repartition(files).write.parquet(f"{folder}/in")
    # a sample far ahead moves the watermark past all others
    spark.range(1).selectExpr("-1L as clip_id", "false as cut", "false as speech", "cast(null as double) as motion", "cast(array() as " + dict(x.dtypes)["faces"] + ") as faces", "timestamp_seconds(1800000000) as at").coalesce(1).write.mode("append").parquet(f"{folder}/in")
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        out = tracker.followed(spark.readStream.schema(x.schema).option("maxFilesPerTrigger", files).parquet(f"{folder}/in"), late="60 days")
        out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/cp").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(PROVIDER, before)
    done = spark.read.schema(out.schema).parquet(f"{folder}/out").where("clip_id >= 0")
    return speakers.told(done.withColumn("t", (F.unix_seconds("at") - 1_700_000_000) / 7200))


@query(S.BRIDGE + "SELECT job_id, seg_ix, start_cs, end_cs, text FROM segments")
def stm1_chunks(spark, d):
    """Segments sent chunk by chunk, some twice and some after an empty or a worse try, as one transcript (STM-1)."""
    folder = shared(spark, "chunks")
    segs = bridge.segments(spark, d)
    c = F.floor(F.col("start_cs") / CHUNK).cast("int")
    x = segs.select("job_id", c.alias("chunk_ix"), F.when(c % 4 == 2, 1).otherwise(0).alias("attempt"), F.col("seg_ix").alias("seg_no"), (F.col("start_cs") - c * CHUNK).alias("start_cs"), (F.col("end_cs") - c * CHUNK).alias("end_cs"), "text", F.lit(0.8).alias("pct"))
    worse = x.where("chunk_ix % 4 = 1").withColumns({"attempt": F.lit(1), "text": F.lit("mumble"), "pct": F.lit(0.3)})
    silent = x.where("chunk_ix % 4 = 2").select("job_id", "chunk_ix").distinct().selectExpr("*", "0 as attempt", "0 as seg_no", "0L as start_cs", "0L as end_cs", "cast(null as string) as text", "cast(null as double) as pct")
    again = x.where("chunk_ix % 4 = 3")
    x.unionByName(worse).unionByName(silent).repartition(4, "job_id", "chunk_ix").write.json(f"{folder}/in")
    again.repartition(2, "job_id", "chunk_ix").write.mode("append").json(f"{folder}/in")
    chunks.append(chunks.arriving(spark, f"{folder}/in", 3), f"{folder}/table", f"{folder}/cp", CHUNK).awaitTermination()
    return chunks.transcript(spark, f"{folder}/table")
