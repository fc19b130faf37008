"""Shared pieces of the training-data operators: tables, scratch tables, components."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_made: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares, from ``spark.checkpoint.dir``; where that is unset, a local session gets one of its own and a cluster an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="folioloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
_BATCH_DEFAULT, _BATCH_BYTES = "67108864b", "4m"


def small_batches(spark: SparkSession) -> None:
    """Texts go to Python in batches of 4 MB, unless the session says otherwise than Spark's default of 64 MB.

    A batch exists several times over, in the JVM and in its Python worker, and
    the operators cut it into slices anyway.
    """
    if spark.conf.get(_BATCH, _BATCH_DEFAULT) == _BATCH_DEFAULT:
        spark.conf.set(_BATCH, _BATCH_BYTES)


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may be gone; the cluster then clears its checkpoint folder itself
        pass


@atexit.register
def _clear() -> None:
    for spark, path in _made:
        _delete(spark, path)


class Scratch:
    """Tables written to the shared folder, so that no later job repeats or loses what made them.

    ``keep`` writes and rereads a DataFrame; ``drop`` deletes what was written
    except for the tables that a result still reads, which go when Python ends.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.at = spark, f"{shared_dir(spark)}/folioloom/{uuid.uuid4().hex}"
        self.n = 0
        small_batches(spark)
        _made.append((spark, self.at))

    def keep(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.at}/{self.n}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._folioloom_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            if path := getattr(df, "_folioloom_path", None):
                _delete(self.spark, path)


def most_frequent(counted: DataFrame, most: int, column: str = "n") -> tuple[DataFrame, int]:
    """(rows, least): the rows of the highest counts, whole counts at a time and at most ``most`` rows; the least count among them.

    The least count comes from a histogram of counts, so no task sorts or holds the rows.
    """
    total, least = 0, (1 << 63) - 1
    for row in counted.groupBy(column).agg(F.count("*").alias("_rows")).orderBy(F.desc(column)).toLocalIterator():
        total += row["_rows"]
        if total > most:
            break
        least = row[column]
    return counted.where(F.col(column) >= least), least


def hash_sample(rows: DataFrame, most: int, column: str) -> DataFrame:
    """All rows, or of more than ``most`` a share by a hash of the column that keeps about 95 % of ``most``."""
    n = rows.count()
    if n <= most:
        return rows
    return rows.where(F.pmod(F.xxhash64(column), F.lit(1 << 30)) < int((1 << 30) * 0.95 * most / n))


def _contract(batches):
    """Local union-find: each batch run's edges become stars around the smallest node of each piece."""
    import numpy as np
    import pyarrow as pa

    up: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (y := up.get(top, top)) != top:
            top = y
        while x != top:
            up[x], x = top, up.get(x, x)
        return top

    def stars():
        nodes = list(up)
        pairs = np.array([(x, r) for x in nodes if (r := root(x)) != x], dtype=np.int64).reshape(-1, 2)
        up.clear()
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x, y = root(a), root(b)
            if x != y:
                up[max(x, y)] = min(x, y)
                up.setdefault(min(x, y), min(x, y))
        if len(up) > 200_000:
            yield stars()
    yield stars()


def components(edges: DataFrame, scratch: Scratch, rounds: int = 60) -> DataFrame:
    """(node, root) of every node that has an edge to another; root is the smallest node reachable.

    ``edges`` has two long columns.  Edges are contracted within partitions, then
    alternating large-star and small-star rounds run as joins on grouped minima,
    so that a node with very many edges is never gathered in one task.  Each
    round is written to the shared folder.  Loops and nulls are ignored.
    """
    a, b = edges.columns
    e = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").mapInArrow(_contract, "a long, b long")
    e = scratch.keep(e.distinct())
    before = None
    for _ in range(rounds):
        # Large star: larger neighbours of a node are tied to its smallest neighbour.
        both = e.union(e.select("b", "a")).toDF("a", "b")
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
        big = both.where("b > a").join(low, F.col("a") == F.col("k")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # Small star: a node's smaller neighbours, and itself, are tied to the smallest of them.
        low = big.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "k")
        tied = big.join(low, F.col("a") == F.col("k"))
        small = tied.where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("k", "m")).toDF("a", "b").distinct()
        new = scratch.keep(small)
        scratch.drop(e)
        e = new
        now = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b") % 1_000_000_007).alias("s")).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return e.toDF("node", "root")
