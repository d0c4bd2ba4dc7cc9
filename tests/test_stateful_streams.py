"""Streams with state: the tracker against the fold, appended chunks, and restarts after a failing batch."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tests.test_styled_speakers import made
from tidemark.operators import speakers
from tidemark.streaming import chunks, tracker

SAMPLE = f"clip_id long, at timestamp, cut boolean, speech boolean, motion double, faces array<{speakers.FACE}>"


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset(name)


def test_tracker_equals_the_fold_whatever_the_order(rocks, tmp_path):
    spark, rng = rocks, random.Random(6)
    rows = [(k, *x) for k in range(4) for x in made(20 + k, 30)]
    rng.shuffle(rows)
    secs = lambda t: F.timestamp_millis((F.lit(1_700_000_000_000) + F.col(t) * 1000).cast("long"))
    df = spark.createDataFrame(rows, f"clip_id long, t double, cut boolean, speech boolean, motion double, faces array<{speakers.FACE}>").withColumn("at", secs("t")).drop("t")
    for k in range(4):  # each file holds samples of all times
        df.where(F.pmod(F.xxhash64("clip_id", "at"), F.lit(4)) == k).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    # one far later sample moves the watermark past all others
    spark.createDataFrame([(99,)], "clip_id long").selectExpr("clip_id", "timestamp_millis(1700090000000) as at", "false as cut", "false as speech", "cast(null as double) as motion", f"cast(array() as array<{speakers.FACE}>) as faces").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(SAMPLE).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    out = tracker.followed(stream, late="2 hours")
    q = out.writeStream.format("memory").queryName("followed").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    assert q.lastProgress["batchId"] >= 4
    key = lambda r: (r.clip_id, r.at, round(r.target, 9), round(r.camera, 9), r.follows, r.switched)
    got = sorted(key(r) for r in spark.table("followed").where("clip_id < 99").collect())
    want = sorted(key(r) for r in tracker.batch(df).collect())
    assert len(want) == 120 and got == want


def chunk_file(folder, name, rows):
    import json

    Path(folder).mkdir(exist_ok=True)
    fields = ("job_id", "chunk_ix", "attempt", "seg_no", "start_cs", "end_cs", "text", "pct")
    Path(folder, name).write_text("".join(json.dumps(dict(zip(fields, r, strict=True))) + "\n" for r in rows))


def drain(spark, d, **more):
    q = chunks.append(chunks.arriving(spark, f"{d}/in"), f"{d}/table", f"{d}/cp", 6000, **more)
    q.awaitTermination()


def found(spark, d):
    return [tuple(r) for r in chunks.transcript(spark, f"{d}/table").orderBy("job_id", "seg_ix").collect()]


A = [(1, 0, 0, 0, 0, 900, "one", 0.9), (1, 0, 0, 1, 900, 2000, "two", 0.8), (2, 0, 0, 0, 10, 20, "solo", 0.7)]
B = [(1, 1, 0, 0, 5, 400, "three", 0.5), (1, 1, 0, 1, 5, 410, "four", 0.5)]
WANT = [(1, 0, 0, 900, "one"), (1, 1, 900, 2000, "two"), (1, 2, 6005, 6400, "three"), (1, 3, 6005, 6410, "four"), (2, 0, 10, 20, "solo")]


def test_chunks_are_placed_and_replays_change_nothing(spark, tmp_path):
    chunk_file(f"{tmp_path}/in", "0.json", A)
    drain(spark, tmp_path)
    chunk_file(f"{tmp_path}/in", "1.json", B)
    drain(spark, tmp_path)
    assert found(spark, tmp_path) == WANT
    chunk_file(f"{tmp_path}/in", "2.json", A[:2])  # the same chunk once more
    drain(spark, tmp_path)
    assert found(spark, tmp_path) == WANT
    assert chunks.attempts(spark, f"{tmp_path}/table").count() == 4


def test_the_better_attempt_at_a_chunk_counts(spark, tmp_path):
    chunk_file(f"{tmp_path}/in", "0.json", [(1, 0, 0, 0, 0, 5, "mumble", 0.2), (1, 1, 0, 0, 0, 0, "", None), (1, 2, 0, 0, 0, 9, "good", 0.9)])
    drain(spark, tmp_path)
    chunk_file(f"{tmp_path}/in", "1.json", [(1, 0, 1, 0, 0, 5, "clear", 0.8), (1, 1, 1, 0, 1, 9, "heard", 0.1), (1, 2, 1, 0, 0, 0, None, None)])
    drain(spark, tmp_path)
    assert [r[4] for r in found(spark, tmp_path)] == ["clear", "heard", "good"]


def test_a_query_killed_between_batches_goes_on_and_finds_each_row_once(spark, tmp_path):
    import os

    for k in range(5):
        chunk_file(f"{tmp_path}/in", f"{k}.json", [(1, k, 0, j, j * 10, j * 10 + 9, f"c{k} s{j}", 0.5) for j in range(3)])
        os.utime(f"{tmp_path}/in/{k}.json", (1_700_000_000 + k, 1_700_000_000 + k))
    seen = []

    def dies_once(batch):
        seen.append(batch)
        if batch == 2 and seen.count(2) == 1:
            # what a task of the failing try may have left behind
            spark.range(3).selectExpr("1L as job_id", "9 as chunk_ix", "0 as attempt", "0 as seg_no", "0L as start_cs", "1L as end_cs", "'half' as text", "0.1D as pct").write.parquet(f"{tmp_path}/table/batch=2")
            raise RuntimeError("an executor is gone")

    with pytest.raises(Exception, match="executor is gone"):
        drain(spark, tmp_path, before_write=dies_once)
    drain(spark, tmp_path, before_write=dies_once)
    assert seen == [0, 1, 2, 2, 3, 4]
    assert [r[4] for r in found(spark, tmp_path)] == [f"c{k} s{j}" for k in range(5) for j in range(3)]
    drain(spark, tmp_path, before_write=dies_once)  # nothing is left to do
    assert len(seen) == 6
