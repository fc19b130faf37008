"""Tables that a plan writes and reads again, in the folder that the cluster shares."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where that is unset a local session gets one of its own, and a cluster an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="folioloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_dir(spark: SparkSession) -> str:
    """A new folder's name under the shared one; what is written there goes when Python ends."""
    path = f"{shared_dir(spark)}/folioloom/{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def keep(df: DataFrame, path: str | None = None) -> DataFrame:
    """The rows, written and read again: later jobs neither repeat what made them nor lose it with an executor."""
    path = path or new_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def file_system(spark: SparkSession, path: str):
    """(file system, path) of the JVM for a path."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


@atexit.register
def _clear() -> None:
    for spark, path in _made:
        try:
            fs, p = file_system(spark, path)
            fs.delete(p, True)
        except Exception:  # the session may be gone; the cluster then clears its folder itself
            pass
