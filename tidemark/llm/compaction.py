"""Sharding by size-tiered compaction.

Arrivals are appended as small immutable shards (one file each). Compaction
orders the shards of each size tier by size and cuts the order into runs of
about the target size; every run of at least MIN_RUN shards, or of the target
size, is merged into target-sized files. Shards are never changed: a version is
a manifest, a table of the files that make it up, and becomes current when a
finished marker file that names the manifest (and the columns of the rows) is
renamed to the version's number. That rename refuses to replace a marker, so of
two writers of one number only one commits, and no reader sees half a version.

DataFrame functions only; the rows of a run move through one exchange by run. A
run is cut at the target and holds shards of under half of it, so its one file
has the target's size, or up to half as much again, whatever the session's
planner is set to. The order of the shards is a sort by range with sums carried
between ranges, so that no tier meets in one task. A manifest names files
relative to the root, so a store can lie at a path with any characters and can
be moved. The names of the files that are read reach the driver, as in every
read of files. Cases: nulls in any column, repeated rows and very long texts
pass through unchanged; an empty table makes a version without files that reads
as no rows of the same columns; columns of any name are kept, `_metadata` and
names with dots, blanks or backticks included.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import cut, partitions

#: Bytes of a file.
SMALL, TARGET = 1 << 20, 128 << 20
FAN = 4  # sizes of a tier differ by less than this factor
MIN_RUN = 4
SHARD_ROWS = 2000  # rows of an arriving shard at most
_MANIFEST = "file string, bytes long, tier int, added long"
_PARTS = r"/(shards/\d+-[0-9a-f]{32}/(?:_run_*=[0-9-]+/)?[^/]+)$"  # a shard's name below the root, of plain characters only


def shard_of(rows: DataFrame) -> Column:
    """The shard that each row was read from, relative to its store's root; no column of the rows hides it."""
    return F.regexp_extract(rows.metadataColumn("_metadata")["file_path"], _PARTS, 1)


def shard_bytes_of(rows: DataFrame) -> Column:
    """The size of the shard that each row was read from."""
    return rows.metadataColumn("_metadata")["file_size"]


class ShardStore:
    """A folder of shards and manifests in a file system that all executors share."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        conf = spark._jsc.hadoopConfiguration()
        self._fs = self._path(self.root).getFileSystem(conf)
        self._context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(self.root).toUri(), conf)

    def version(self) -> int:
        """The latest committed version; 0: none."""
        home = self._path(f"{self.root}/manifest")
        if not self._fs.exists(home):
            return 0
        return max((int(x.getPath().getName()[1:]) for x in self._fs.listStatus(home) if x.getPath().getName()[:1] == "v"), default=0)

    def _marker(self, version: int) -> dict:
        source = self._fs.open(self._path(f"{self.root}/manifest/v{version}"))
        try:
            return json.loads(source.readUTF())
        finally:
            source.close()

    def manifest(self, version: int | None = None) -> DataFrame:
        version = self.version() if version is None else version
        if not version:
            return self.spark.createDataFrame([], _MANIFEST)
        return self.spark.read.schema(_MANIFEST).parquet(f"{self.root}/{self._marker(version)['manifest']}")

    def schema(self, version: int | None = None) -> T.StructType:
        """The columns of a version's rows; none before the first."""
        version = self.version() if version is None else version
        return T.StructType.fromJson(self._marker(version)["schema"]) if version else T.StructType()

    def commit(self, manifest: DataFrame, version: int, schema: T.StructType) -> None:
        """Publishes a finished manifest under a number; a version that exists already is a conflict."""
        table, draft = f"manifests/{version}-{uuid.uuid4().hex}", self._path(f"{self.root}/manifest/_draft-{uuid.uuid4().hex}")
        manifest.coalesce(1).write.parquet(f"{self.root}/{table}")
        out = self._fs.create(draft, False)
        try:
            out.writeUTF(json.dumps({"manifest": table, "schema": schema.jsonValue()}))
        finally:
            out.close()
        careful = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)  # none: don't overwrite
        try:
            self._context.rename(draft, self._path(f"{self.root}/manifest/v{version}"), careful)
        except Py4JJavaError as e:
            self._fs.delete(draft, False)
            if "FileAlreadyExists" in str(e.java_exception.getClass().getName()):
                raise RuntimeError(f"version {version} was committed by another writer") from None
            raise

    def _files(self, folder: str, version: int, schema: T.StructType) -> DataFrame:
        """The files of a folder of shards, by Spark's own metadata of them."""
        found = self.spark.read.option("recursiveFileLookup", True).schema(schema).parquet(folder)
        rows = found.select(shard_of(found).alias("file"), shard_bytes_of(found).alias("bytes"))
        tier = F.greatest(F.lit(0), F.floor(F.log(F.col("bytes") / SMALL) / F.log(F.lit(float(FAN))))).cast("int")
        return rows.distinct().select("file", "bytes", tier.alias("tier"), F.lit(version).cast("long").alias("added"))

    def append(self, arrivals: DataFrame, shard_rows: int = SHARD_ROWS) -> int:
        """Adds arrivals as small shards, as they lie in their partitions; returns the new version."""
        now = self.version()
        new, schema = now + 1, _nullable(arrivals.schema)
        if now and [(f.name, f.dataType) for f in self.schema(now)] != [(f.name, f.dataType) for f in schema]:
            raise ValueError("arrivals have other columns than the store")
        folder = f"{self.root}/shards/{new}-{uuid.uuid4().hex}"
        arrivals.write.option("compression", "zstd").option("maxRecordsPerFile", shard_rows).parquet(folder)
        self.commit(self.manifest(now).unionByName(self._files(folder, new, schema)), new, schema)
        return new

    def runs(self, target: int = TARGET, min_run: int = MIN_RUN) -> DataFrame:
        """(file, run): the shards to merge. A shard of half the target or more is left alone."""
        small = self.manifest().where(F.col("bytes") < target / 2)
        order = cut(small.repartitionByRange(partitions(self.spark), "tier", "bytes", "file").select("file", "bytes", "tier", F.spark_partition_id().alias("range")), "order")
        before, reached = [], {}
        for r in order.groupBy("range", "tier").agg(F.sum("bytes").alias("bytes")).orderBy("tier", "range").collect():  # a row or two a range
            before.append((r.range, r.tier, reached.get(r.tier, 0)))
            reached[r.tier] = reached.get(r.tier, 0) + r.bytes
        offsets = F.broadcast(self.spark.createDataFrame(before, "range int, tier int, before long"))
        within = Window.partitionBy("range", "tier").orderBy("bytes", "file")
        placed = order.join(offsets, ["range", "tier"]).withColumn("part", F.floor((F.col("before") + F.sum("bytes").over(within) - F.col("bytes")) / target))
        sized = placed.groupBy("tier", "part").agg(F.count("*").alias("n"), F.sum("bytes").alias("all"))
        merge = sized.where((F.col("n") >= min_run) | (F.col("all") >= 0.75 * target) & (F.col("n") > 1)).select("tier", "part")
        return placed.join(merge, ["tier", "part"]).select("file", F.concat_ws("-", "tier", "part").alias("run"))

    def compact(self, target: int = TARGET, min_run: int = MIN_RUN) -> int:
        """Merges the runs of this version's shards and commits the result; returns the version then current."""
        now = self.version()
        runs = cut(self.runs(target, min_run), "runs")
        files = [f"{self.root}/{r.file}" for r in runs.select("file").collect()]
        if not files:
            return now
        new, schema = now + 1, self.schema(now)
        folder = f"{self.root}/shards/{new}-{uuid.uuid4().hex}"
        names = [f.name.lower() for f in schema]
        run = "_run" + "_" * next(k for k in range(len(names) + 1) if "_run" + "_" * k not in names)
        rows = self.spark.read.schema(schema).parquet(*files)
        columns = [F.col("`{}`".format(f.name.replace("`", "``"))) for f in schema]
        held = rows.select(F.struct(*columns).alias("_row"), shard_of(rows).alias("file")).join(runs, "file")
        tasks = 2 * runs.select("run").distinct().count()
        moved = held.select("_row", F.col("run").alias(run)).repartition(tasks, run)
        moved.select("_row.*", run).write.option("compression", "zstd").partitionBy(run).parquet(folder)
        kept = self.manifest(now).join(runs, "file", "left_anti")
        self.commit(kept.unionByName(self._files(folder, new, schema)), new, schema)
        return new

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version; shard_of and shard_bytes_of tell each row's shard."""
        schema = self.schema(version)
        files = [f"{self.root}/{r.file}" for r in self.manifest(version).select("file").collect()]
        return self.spark.read.schema(schema).parquet(*files) if files else self.spark.createDataFrame([], schema)


def _nullable(schema: T.StructType) -> T.StructType:
    """The schema as files hold it: every column may be null."""
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in schema])
