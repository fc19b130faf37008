"""Stores of vectors and results on any file system that Spark writes."""

from __future__ import annotations

import logging
import re

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions import guards, text, vectors
from ..operators import jobs
from .buckets import BUCKETS, BucketTable

log = logging.getLogger(__name__)

#: Store kinds by the names that they go by; each has a folder of its own.
KINDS = {"chroma": "chroma", "faiss": "faiss", "milvus": "milvus", "pgvector": "pgvector", "postgres": "pgvector", "postgresql": "pgvector", "qdrant": "qdrant"}
DEFAULT = "chroma"


def kind(name: str) -> str:
    """The store kind of a name; an unknown one is the default, with a warning."""
    found = KINDS.get(name.lower())
    if found is None:
        log.warning("no store kind %r; %r is used", name, DEFAULT)
    return found or DEFAULT


def _checked(collection: str) -> str:
    if not re.fullmatch(guards.COLLECTION_NAME.strip("^$"), collection):
        raise ValueError(f"no collection name: {collection!r}")
    return collection


class VectorStore:
    """A Parquet table partitioned by collection: (collection, chunk_id, page_content, metadata, vector, norm)."""

    def __init__(self, spark: SparkSession, root: str, store: str = DEFAULT) -> None:
        self.spark, self.path = spark, f"{root.rstrip('/')}/{kind(store)}"

    def append(self, rows: DataFrame, collection: str, once: bool = False, written: Observation | None = None) -> None:
        """Appends rows (chunk_id, page_content, metadata, vector); with ``once`` those whose id is there already stay out.

        ``written`` observes ``n``, the number of rows.
        """
        rows = rows.select("chunk_id", "page_content", "metadata", F.col("vector").cast("array<double>").alias("vector"))
        rows = rows.withColumns({"norm": vectors.norm(F.col("vector")), "collection": F.lit(_checked(collection))})
        if once and (there := self._read(collection)) is not None:
            rows = rows.join(there.select("chunk_id").distinct(), "chunk_id", "left_anti")
        if written is not None:
            rows = rows.observe(written, F.count("*").alias("n"))
        rows.write.mode("append").partitionBy("collection").parquet(self.path)

    def _read(self, collection: str) -> DataFrame | None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/collection={_checked(collection)}")
        if not path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            return None
        return self.spark.read.parquet(self.path).where(F.col("collection") == collection)

    def read(self, collection: str) -> DataFrame:
        """The collection's rows; none for one that isn't there.  The filter prunes partitions."""
        found = self._read(collection)
        return found if found is not None else self.spark.createDataFrame([], "chunk_id string, page_content string, metadata string, vector array<double>, norm double, collection string")


class VersionedVectorStore(VectorStore):
    """A vector store whose documents can be replaced: (doc_id, chunk_id, page_content, metadata, vector, norm), a table of buckets for each collection."""

    ROWS = "doc_id string, chunk_id string, page_content string, metadata string, vector array<double>, norm double"

    def __init__(self, spark: SparkSession, root: str, store: str = DEFAULT, buckets: int = BUCKETS) -> None:
        super().__init__(spark, root, store)
        self.path, self.buckets = f"{self.path}-versioned", buckets

    def table(self, collection: str) -> BucketTable:
        return BucketTable(self.spark, f"{self.path}/{_checked(collection)}", self.ROWS, "doc_id", self.buckets)

    def append(self, rows: DataFrame, collection: str, once: bool = False, written: Observation | None = None) -> None:
        """Puts rows (doc_id, chunk_id, page_content, metadata, vector) in place of all that their documents had; ``once`` makes no difference."""
        self.replace(rows, collection, written=written)

    def replace(self, rows: DataFrame, collection: str, ids: DataFrame | None = None, written: Observation | None = None) -> int | None:
        """As ``append``; documents in ``ids`` that have no rows any more go as well.  The new version."""
        rows = rows.select("doc_id", "chunk_id", "page_content", "metadata", F.col("vector").cast("array<double>").alias("vector")).withColumn("norm", vectors.norm(F.col("vector")))
        if written is not None:
            rows = rows.observe(written, F.count("*").alias("n"))
        return self.table(collection).replace(rows, ids)

    def delete(self, ids: DataFrame, collection: str) -> int | None:
        return self.table(collection).delete(ids)

    def read(self, collection: str, version: int | None = None) -> DataFrame:
        """The collection's rows, in the newest version or an earlier one."""
        return self.table(collection).read(version).withColumn("collection", F.lit(collection))


class JobStore:
    """Jobs by id: a record updates what is there or is inserted, and what has expired is swept out."""

    ROWS = "id string, kind string, file_name string, status string, strategy string, created_at double, started_at double, finished_at double, error string, result_ref string, retry_count int, seq long"

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS) -> None:
        self.table = BucketTable(spark, path, self.ROWS, "id", buckets)

    def put(self, records: DataFrame) -> int | None:
        """Records of any of the columns, the last of each job by ``seq``; columns that aren't given are null."""
        there = set(records.columns)
        rows = records.select(*(F.col(f.name) if f.name in there else F.lit(None).cast(f.dataType).alias(f.name) for f in self.table.schema))
        return self.table.upsert(rows, order="seq")

    def get(self, job: str) -> dict | None:
        """One job, from its bucket alone."""
        row = self.table.of(job).first()
        return row and row.asDict()

    def jobs(self) -> DataFrame:
        return self.table.read()

    def sweep(self, now: float, ttl: float) -> int | None:
        """Drops finished jobs past their time to live, from the buckets where there are any; the new version."""
        return self.table.delete(self.jobs().where(jobs.expired(now, ttl)).select("id"))


def inspect(store: DataFrame) -> DataFrame:
    """A preview of each record: 80 characters, dimension, first three components."""
    return store.select("chunk_id", text.preview(F.col("page_content")).alias("preview"), F.size("vector").alias("dimension"), F.slice("vector", 1, 3).alias("head"))


class ObjectStore:
    """Rows (key, value) under a folder; a write appears whole or not at all, and the last value of a key counts."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.path = spark, root.rstrip("/")

    def _exists(self) -> bool:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def _log(self) -> DataFrame:
        schema = "key string, value string, at timestamp, deleted boolean"
        return self.spark.read.schema(schema).parquet(self.path) if self._exists() else self.spark.createDataFrame([], schema)

    def put(self, rows: DataFrame) -> None:
        """Writes rows (key, value); keys are made safe, and one that climbs out fails the write."""
        key = guards.safe_key(F.col("key"))
        checked = F.when(key.isNull(), F.raise_error(F.concat(F.lit("no object key: "), F.col("key")))).otherwise(key)
        rows.select(checked.alias("key"), "value", F.current_timestamp().alias("at"), F.lit(False).alias("deleted")).write.mode("append").parquet(self.path)

    def delete(self, keys: DataFrame) -> None:
        keys.select(guards.safe_key(F.col("key")).alias("key"), F.lit(None).cast("string").alias("value"), F.current_timestamp().alias("at"), F.lit(True).alias("deleted")).write.mode("append").parquet(self.path)

    def get(self) -> DataFrame:
        """(key, value) of all that is there; of a key that one write has several times the greatest value counts."""
        last = self._log().groupBy("key").agg(F.max(F.struct("at", "deleted", "value")).alias("r"))
        return last.where("not r.deleted").select("key", "r.value")

    def get_one(self, key: str) -> str | None:
        """The value of one key, or null; the filter reaches the scan."""
        row = self._log().where(F.col("key") == key).agg(F.max(F.struct("at", "deleted", "value")).alias("r")).select("r.*").first()
        return None if row.deleted is None or row.deleted else row.value

    def exists(self, key: str) -> bool:
        row = self._log().where(F.col("key") == key).agg(F.max(F.struct("at", "deleted", "value")).alias("r")).select("r.*").first()
        return row.deleted is False
