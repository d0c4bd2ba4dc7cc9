"""Media files by content: fingerprints from size, head and tail, and a cache of transcripts by fingerprint."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources import documents

#: Fixed value: bytes of a file's head and tail that count.
SAMPLE = 1 << 20
#: Hex digits of a key that name its partition of the cache.
PREFIX = 2


def fingerprint(content: Column, sample: int = SAMPLE) -> Column:
    """SHA-256 of the size, the first and, if there is more, the last `sample` bytes."""
    n = F.octet_length(content)
    tail = F.when(n > sample, F.substring(content, F.greatest(F.lit(1), n - sample + 1), F.lit(sample))).otherwise(F.lit(b""))
    return F.sha2(F.concat(n.cast("string").cast("binary"), F.substring(content, F.lit(1), F.lit(sample)), tail), 256)


def cache_key(print_: Column, strategy: Column) -> Column:
    """The key of what a strategy makes of a file."""
    return F.sha2(F.concat_ws("|", print_, strategy).cast("binary"), 256)


def media(spark: SparkSession, folder: str, pattern: str = "*", sample: int = SAMPLE) -> DataFrame:
    """(path, bytes, modified, fingerprint) of the files of a folder and those below it.

    Spark lists the files without reading them; tasks then read a file's head and tail only, by ranges. A file that has
    gone or can't be read has a null fingerprint; empty files aren't listed.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder).select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for df in batches:
            found = []
            for path, size in zip(df["path"], df["bytes"], strict=True):
                try:
                    store, name = fs.FileSystem.from_uri(path)
                    with store.open_input_file(name) as f:
                        parts = [str(size).encode(), f.read_at(min(sample, size), 0), f.read_at(sample, size - sample) if size > sample else b""]
                    found.append(hashlib.sha256(b"".join(parts)).hexdigest())
                except OSError:
                    found.append(None)
            yield df.assign(fingerprint=found)

    return files.mapInPandas(read, "path string, bytes long, modified timestamp, fingerprint string")


def save(transcripts: DataFrame, cache: str) -> None:
    """Adds transcripts(cache_key, doc) to the cache; a key that comes again replaces its document for readers."""
    x = transcripts.select("cache_key", "doc", F.current_timestamp().alias("saved_at"), F.left("cache_key", F.lit(PREFIX)).alias("prefix"))
    x.repartition("prefix").write.mode("append").partitionBy("prefix").parquet(cache)


def lookup(spark: SparkSession, cache: str, keys: list[str]) -> DataFrame:
    """(cache_key, doc) of a few keys; only their partitions of the cache are read. Broken or empty documents are misses."""
    held = spark.read.schema("cache_key string, doc string, saved_at timestamp, prefix string").parquet(cache)
    x = held.where(F.col("prefix").isin(sorted({k[:PREFIX] for k in keys})) & F.col("cache_key").isin(keys))
    return usable(x.groupBy("cache_key").agg(F.max_by("doc", "saved_at").alias("doc")))


def matched(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """requests(cache_key, ...) with hit: the cache(cache_key, doc) has a usable document for the key."""
    good = usable(cache).select("cache_key", F.lit(True).alias("hit")).distinct()
    return requests.join(good, "cache_key", "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def usable(cache: DataFrame) -> DataFrame:
    """The rows whose document is an array of segments with one at least."""
    text = F.transform(F.from_json("doc", f"array<struct<{documents.SEGMENT}>>"), lambda s: s["text"])
    return cache.where(F.coalesce(F.exists(text, lambda t: t.isNotNull()), F.lit(False)))
