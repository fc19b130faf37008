"""Tables whose rows can be replaced: hash buckets, and a manifest of versions.

A table lies in ``data/<version>/bucket=<k>``.  A manifest is a small file that
says, for each bucket, which version's folder counts.  A write

1. stages the new rows, so that what made them runs once,
2. rewrites the buckets that they touch, old rows without those replaced, into a
   new version's folder, and
3. commits by creating the next manifest, which fails if someone else has: the
   second step is then repeated on theirs.

Readers take the greatest manifest, so they see a write whole or not at all, and
one that ends before its commit leaves only files that nothing refers to, for
``vacuum``.  Buckets that aren't touched are neither read nor written.  A bucket
is as many files as its size asks for, and no task holds one whole.

Defined cases: a table without a manifest is empty; rows whose ``by`` is null have
a bucket too and replace one another; an empty write commits nothing.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import scratch

#: Buckets of a new table, and times that a commit is tried again.
BUCKETS, TRIES = 64, 8


class Conflict(Exception):
    """Someone else has committed the version that a write was for."""


class BucketTable:
    """Rows of a fixed schema, in buckets by one column."""

    def __init__(self, spark: SparkSession, path: str, schema: str | T.StructType, by: str, buckets: int = BUCKETS) -> None:
        self.spark, self.path, self.by = spark, path.rstrip("/"), by
        self.schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        if by not in self.schema.names:
            raise ValueError(f"no column {by!r} to deal rows by")
        if "_bucket" in self.schema.names:
            raise ValueError("the name _bucket is taken")
        #: An existing table keeps the number it was made with.
        self.buckets = (self.manifest() or {"buckets": buckets})["buckets"]

    # ---- manifests ---------------------------------------------------------------------------------------------------

    def versions(self) -> list[int]:
        """The committed versions, the newest last."""
        fs, p = scratch.file_system(self.spark, f"{self.path}/manifests")
        if not fs.exists(p):
            return []
        return sorted(int(x.getPath().getName()[:-5]) for x in fs.listStatus(p) if x.getPath().getName().endswith(".json"))

    def manifest(self, version: int | None = None) -> dict | None:
        """What a version, or the newest, consists of; null before the first."""
        if version is None:
            if not (there := self.versions()):
                return None
            version = there[-1]
        fs, p = scratch.file_system(self.spark, f"{self.path}/manifests/{version:012d}.json")
        stream = fs.open(p)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _commit(self, manifest: dict) -> None:
        """Creates the manifest under its number if no one has; it appears whole, by renaming."""
        jvm = self.spark.sparkContext._jvm
        fs, target = scratch.file_system(self.spark, f"{self.path}/manifests/{manifest['version']:012d}.json")
        _, draft = scratch.file_system(self.spark, f"{self.path}/manifests/{uuid.uuid4().hex}.draft")
        out = fs.create(draft, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri() if draft.toUri().getScheme() else fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(draft, target, none)
        except Exception as e:
            fs.delete(draft, False)
            if fs.exists(target):
                raise Conflict(f"version {manifest['version']} is there") from e
            raise

    # ---- reading -----------------------------------------------------------------------------------------------------

    def _bucket(self, column: str) -> Column:
        return F.pmod(F.xxhash64(F.col(column).cast("string")), F.lit(self.buckets)).cast("int")

    def _rows(self, manifest: dict | None, only: list[int] | None = None) -> DataFrame:
        places = (manifest or {}).get("folders", {})
        paths = [f"{self.path}/data/{folder}/_bucket={k}" for k, folder in places.items() if only is None or int(k) in only]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of the newest version, or of an earlier one that hasn't been cleared away."""
        return self._rows(self.manifest(version))

    def of(self, value) -> DataFrame:
        """The rows of one value of ``by``: only its bucket is read."""
        k = self.spark.range(1).select(F.lit(value).cast(self.schema[self.by].dataType).alias("_v")).select(self._bucket("_v")).first()[0]
        return self._rows(self.manifest(), [k]).where(F.col(self.by).eqNullSafe(F.lit(value)))

    # ---- writing -----------------------------------------------------------------------------------------------------

    def replace(self, rows: DataFrame, ids: DataFrame | None = None) -> int | None:
        """Puts these rows in place of all that have one of their values of ``by``, or one in ``ids``; the new version, or null if there was nothing to do."""
        return self._write(rows, ids, lambda old, new, gone: old.join(gone, old[self.by].eqNullSafe(gone["_gone"]), "left_anti").unionByName(new))

    def delete(self, ids: DataFrame) -> int | None:
        """Drops the rows of these values of ``by``."""
        return self.replace(self.spark.createDataFrame([], self.schema), ids)

    def upsert(self, rows: DataFrame, key: list[str] | None = None, order: str | None = None) -> int | None:
        """Updates rows of the same key, inserts the others.

        Of several rows of a key the one with the greatest ``order`` stays,
        whether it was there or is new; without an order any new row counts more
        than the stored one, and of several new ones the greatest.
        """
        key = key or [self.by]
        if self.by not in key:
            raise ValueError(f"a key has to contain {self.by!r}, by which rows are dealt")
        rest = [c for c in self.schema.names if c not in key]

        def merged(old: DataFrame, new: DataFrame, _: DataFrame) -> DataFrame:
            both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
            rank = F.struct(*([F.col(order)] if order else []), "_new", *(F.col(c) for c in rest if not isinstance(self.schema[c].dataType, T.MapType)))
            best = both.groupBy(*key).agg(F.max_by(F.struct(*rest), rank).alias("_r"))
            return best.select(*(F.col(c) if c in key else F.col(f"_r.{c}").alias(c) for c in self.schema.names))

        return self._write(rows, None, merged)

    def _write(self, rows: DataFrame, ids: DataFrame | None, merge) -> int | None:
        staged = f"{self.path}/staged/{uuid.uuid4().hex}"
        new = scratch.keep(rows.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema)), f"{staged}/rows")
        gone = new.select(F.col(self.by).alias("_gone"))
        if ids is not None:
            gone = gone.unionByName(ids.select(F.col(ids.columns[0]).cast(self.schema[self.by].dataType).alias("_gone")))
        gone = scratch.keep(gone.distinct(), f"{staged}/gone")
        try:
            # At most as many numbers as there are buckets.
            touched = sorted(r[0] for r in gone.select(self._bucket("_gone")).distinct().collect())
            if not touched:
                return None
            for _ in range(TRIES):
                try:
                    return self._merge(touched, new, gone, merge)
                except Conflict:
                    continue
            raise Conflict(f"{TRIES} others were first")
        finally:
            self._delete(staged)

    def _merge(self, touched: list[int], new: DataFrame, gone: DataFrame, merge) -> int:
        before = self.manifest() or {"version": 0, "buckets": self.buckets, "by": self.by, "folders": {}}
        version = before["version"] + 1
        folder = f"{version:012d}-{uuid.uuid4().hex[:8]}"
        out = merge(self._rows(before, touched), new, gone).select(*self.schema.names).withColumn("_bucket", self._bucket(self.by))
        # Dealt by bucket; adaptive execution splits what is large and joins what is small.
        out.hint("rebalance", "_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/data/{folder}")
        fs, p = scratch.file_system(self.spark, f"{self.path}/data/{folder}")
        filled = {int(x.getPath().getName().split("=")[1]) for x in fs.listStatus(p) if "=" in x.getPath().getName()}
        folders = {k: f for k, f in before["folders"].items() if int(k) not in touched} | {str(k): folder for k in sorted(filled)}
        self._commit({"version": version, "buckets": self.buckets, "by": self.by, "at": time.time(), "touched": touched, "folders": folders})
        return version

    # ---- upkeep ------------------------------------------------------------------------------------------------------

    def _delete(self, path: str) -> None:
        fs, p = scratch.file_system(self.spark, path)
        fs.delete(p, True)

    def vacuum(self, keep: int = 1, older_than: float = 0.0) -> list[str]:
        """Deletes all but the newest ``keep`` versions and what no version refers to, if it is older than so many seconds; what went.

        With writers at work, ``older_than`` has to be longer than a write takes.
        """
        kept = self.versions()[-max(1, keep) :]
        used = {f for v in kept for f in self.manifest(v)["folders"].values()}
        out = []
        for part, stays in (("data", used), ("staged", set()), ("manifests", {f"{v:012d}.json" for v in kept})):
            fs, p = scratch.file_system(self.spark, f"{self.path}/{part}")
            for x in fs.listStatus(p) if fs.exists(p) else ():
                name = x.getPath().getName()
                if name not in stays and x.getModificationTime() / 1000 <= time.time() - older_than:
                    fs.delete(x.getPath(), True)
                    out.append(f"{part}/{name}")
        return sorted(out)
