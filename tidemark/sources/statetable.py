"""A table of states by key, updated copy-on-write and published whole: an update is seen entirely or not at all."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Conflict(RuntimeError):
    """Someone else has published in between; nothing of this update is seen."""


class StateTable:
    """Rows by key in buckets, each an immutable folder of files; a version is a small document that names each bucket's.

    upsert() reads and writes the buckets that the new rows touch, and then renames the next version into place, which
    fails if another writer was faster. Readers keep to the version they began with.
    """

    def __init__(self, spark: SparkSession, root: str, key: str, buckets: int = 64) -> None:
        self.spark, self.root, self.key, self.buckets = spark, root.rstrip("/"), key, buckets
        jvm = spark.sparkContext._jvm
        self.path = lambda *parts: jvm.org.apache.hadoop.fs.Path("/".join((self.root, *parts)))
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self.path().getFileSystem(conf)
        self.context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.path().toUri(), conf)
        self.rename_options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)

    def version(self) -> int:
        """The latest version; 0: nothing is there."""
        folder = self.path("versions")
        if not self.fs.exists(folder):
            return 0
        names = [s.getPath().getName() for s in self.fs.listStatus(folder)]
        return max((int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit()), default=0)

    def manifest(self, version: int | None = None) -> dict:
        """{"schema": ..., "buckets": {bucket: folder}} of a version."""
        version = self.version() if version is None else version
        if not version:
            return {"schema": None, "buckets": {}}
        return json.loads("".join(r.value for r in self.spark.read.text(self._version(version)).collect()))

    def _version(self, version: int) -> str:
        return f"{self.root}/versions/v{version:09d}"

    def read(self, version: int | None = None, buckets: list[int] | None = None) -> DataFrame | None:
        """The rows of a version, or of some of its buckets; None: the table has no version."""
        m = self.manifest(version)
        if m["schema"] is None:
            return None
        folders = sorted({f for b, f in m["buckets"].items() if buckets is None or int(b) in buckets})
        if not folders:
            return self.spark.createDataFrame([], m["schema"])
        return self.spark.read.schema(m["schema"]).parquet(*[f"{self.root}/{f}" for f in folders])

    def bucket(self):
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def upsert(self, rows: DataFrame, now, expected: int | None = None) -> int:
        """Adds and replaces rows (one a key) and returns the new version. Null values leave the old ones.

        created_at is when a key first came, updated_at when it last came. expected: the version that the caller has
        read; if another is current, before or at the end, Conflict is raised.
        """
        names = [c for c in rows.columns if c not in (self.key, "created_at", "updated_at")]
        current = self.version()
        base = current if expected is None else expected
        if base != current:
            raise Conflict(f"version {base} isn't current")
        m = self.manifest(base)
        touched = sorted(r.b for r in rows.select(self.bucket().alias("b")).distinct().collect())  # numbers of buckets
        if not touched:
            return base
        new = rows.select(self.key, *[F.col(c).alias(f"_{c}") for c in names], F.lit(True).alias("_new"))
        old = self.read(base, touched) if m["schema"] else None
        if old is None:
            x = new.select(self.key, *[F.col(f"_{c}").alias(c) for c in names], F.lit(now).cast("timestamp").alias("created_at"), F.lit(now).cast("timestamp").alias("updated_at"))
        else:
            rest = [c for c in old.columns if c not in (self.key, *names, "created_at", "updated_at")]
            both = old.join(new, self.key, "full_outer")
            merged = [F.coalesce(f"_{c}", c).alias(c) if c in old.columns else F.col(f"_{c}").alias(c) for c in names]
            stamp = F.lit(now).cast("timestamp")
            x = both.select(self.key, *merged, *rest, F.coalesce("created_at", stamp).alias("created_at"), F.when(F.col("_new"), stamp).otherwise(F.col("updated_at")).alias("updated_at"))
        folder = f"data/{uuid.uuid4().hex}"
        x.withColumn("_bucket", self.bucket()).repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.root}/{folder}")
        m = {"schema": x._jdf.schema().toDDL(), "buckets": m["buckets"] | {str(b): f"{folder}/_bucket={b}" for b in touched}}
        self._publish(m, base + 1)
        return base + 1

    def _publish(self, manifest: dict, version: int) -> None:
        """Writes the version beside its place and renames it there, which only one writer can."""
        made = f"versions/.{uuid.uuid4().hex}"
        out = self.fs.create(self.path(made), False)
        out.write(json.dumps(manifest).encode())
        out.close()
        try:
            self.context.rename(self.path(made), self.path(f"versions/v{version:09d}"), self.rename_options)
        except Exception as e:
            self.fs.delete(self.path(made), False)
            if "FileAlreadyExists" in str(e):
                raise Conflict(f"version {version} is there already") from e
            raise
