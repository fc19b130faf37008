"""Streams: row-wise cleaning in flight, whole documents in micro-batches, and expiry by event time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import clean
from ..plans import facade
from ..sinks.store import VectorStore
from ..sources import readers


def elements(spark: SparkSession, folder: str, schema: str = "doc_id string, text string") -> DataFrame:
    """A stream of elements from Parquet documents that land in a folder."""
    return readers.text_elements(spark.readStream.schema(schema).parquet(folder))


def cleaned(stream: DataFrame, least: int = 2) -> DataFrame:
    """The row-wise steps, which need no state; steps over whole documents run in ``ingest``."""
    return clean.clean(stream, [clean.drop_control, clean.tidy_space, clean.mask_personal, lambda df: clean.drop_short(df, least)])


def ingest(stream: DataFrame, store: VectorStore, collection: str, checkpoint: str, strategy: str = "auto", available_now: bool = True) -> StreamingQuery:
    """Ingests each micro-batch of whole documents once: a batch that runs again adds nothing."""

    def batch(df: DataFrame, _: int) -> None:
        if not df.isEmpty():
            facade.ingest(df, store, collection, strategy, once=True)

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def job_counts(log: DataFrame, window: str = "1 minute", late: str = "5 minutes") -> DataFrame:
    """Jobs by status and time window of a stream (id, status, at timestamp), each job once; later records than ``late`` are dropped."""
    once = log.withWatermark("at", late).select("id", "status", F.window("at", window).alias("window")).dropDuplicates(["id", "status", "window"])
    return once.groupBy("window", "status").agg(F.count("*").alias("n_jobs"))
