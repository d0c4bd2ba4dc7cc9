"""What the operators share: tables, the shared scratch folder, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where it is unset (tests), a new local one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def cut(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a table into the shared folder and reads it back: short lineage that outlives executors."""
    path = f"{scratch(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches in parts of few rows, so that a task holds the Python values of few texts at a time."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


#: Rows in a batch that Spark sends to Python after small_batches.
BATCH_ROWS = 256


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """From now on, Spark hands the session's Python tasks few rows at once: texts and sets of shingles wait outside the heap
    and again in the Python worker. A smaller limit of the session stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, rows)


#: A joined table of up to this many rows is broadcast; beyond it, each of its keys goes to SALTS places.
BROADCAST_ROWS, SALTS = 200_000, 16


def checked_join(rows: DataFrame, small: DataFrame, keys: list[str], spread: str | None = None, most: int = BROADCAST_ROWS, salts: int = SALTS) -> DataFrame:
    """rows joined with small, a written table with one row a key. A small of at most `most` rows is broadcast; beyond
    that the rows of a key are spread over salts by the column `spread` (or all columns), so that no hot key meets one task."""
    if small.count() <= most:
        return rows.join(F.broadcast(small), keys)
    salt = F.pmod(F.xxhash64(*([spread] if spread else rows.columns)), F.lit(salts)).cast("int")
    return rows.withColumn("_salt", salt).join(small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))), [*keys, "_salt"]).drop("_salt")


def unsent(small: DataFrame, most: int | None) -> DataFrame:
    """small, a written table, for a join: one of over `most` rows is shuffled and never broadcast (None: as the planner likes).

    The planner goes by the bytes of the compressed files, so a table of ids with a row for each row of the corpus may pass
    for a small one; the driver would then hold it whole as a hash table.
    """
    return small if most is None or small.count() <= most else small.hint("merge")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def components(edges: DataFrame, rounds: int = 60, most: int | None = None) -> DataFrame:
    """(id, component): for every id of edges (a long, b long), the smallest id that it reaches.

    Alternates large-star and small-star steps until the set of edges stays the
    same, each step an aggregation and a join on ids; the edges of a step are a
    written table. Tables of over `most` rows are not broadcast (unsent). Ids without an edge are not returned. No edges: no rows.
    """
    e = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    before = None
    for _ in range(rounds):
        # large star: every neighbour that is larger than the node links to the node's smallest neighbour
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = cut(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")
        large = both.join(unsent(least, most), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = cut(large.where("a <> b").distinct(), "edges")
        # small star: a node's smaller neighbours, and the node, link to the smallest of them
        least = cut(e.groupBy("a").agg(F.min("b").alias("m")), "least")
        small = e.join(unsent(least, most), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        e = cut(small.where("a <> b").distinct(), "edges")
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components: no fixed point after {rounds} rounds")
    return e.select(F.col("a").alias("id"), F.col("b").alias("component")).union(e.select(F.col("b"), F.col("b")).distinct())
