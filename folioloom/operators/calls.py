"""Calls of services outside: embeddings, captions, recognised text.

A ``Service`` says how a client is made and asked.  ``answered`` asks for each
distinct payload once: payloads are known by their digest, a task makes one client
and sends batches, and what fails is tried again after a while, first whole, then
one by one, so that one bad payload doesn't take others with it.  What can't be
answered is a row with ``error``.  Answers are written before they are used, so a
lost executor repeats at most the calls of its own tasks, and none is made twice
for a plan that is read twice.

With a ``memo``, a table of answers by digest, only payloads that aren't there are
sent, and answers are put there; errors are not, so they are tried again next time.

Defined cases: a null payload has a null answer and no error, and isn't sent; a
null answer is an error, as is another number of answers than payloads.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .. import scratch
from ..sinks.buckets import BucketTable

#: Payloads in a call, tries of each, and seconds before the second.
BATCH, TRIES, WAIT = 20, 3, 0.5


@dataclass(frozen=True)
class Service:
    """``make`` gives a client, in the task; ``ask`` gives the answers of a client to a list of payloads, in order."""

    make: Callable[[], Any]
    ask: Callable[[Any, list], Sequence]
    answer: str
    name: str = "service"
    batch: int = BATCH
    tries: int = TRIES
    wait: float = WAIT
    #: Tasks that call at the same time; as many as Spark runs, if null.
    lanes: int | None = None
    sleep: Callable[[float], None] = field(default=time.sleep)


def digest(payload: Column) -> Column:
    return F.sha2(payload.cast("binary"), 256)


def memo(spark: SparkSession, path: str, service: Service) -> BucketTable:
    """The table of a service's answers at a path."""
    return BucketTable(spark, path, f"digest string, answer {service.answer}", "digest")


def _asked(service: Service, client: Any, payloads: list) -> list[tuple[Any, str | None]]:
    """(answer, error) of each payload."""
    said = ""
    for k in range(service.tries):
        if k:
            service.sleep(service.wait * 2 ** (k - 1))
        try:
            got = list(service.ask(client, payloads))
            if len(got) != len(payloads):
                raise ValueError(f"{len(got)} answers to {len(payloads)} payloads")
            return [(x, None if x is not None else "no answer") for x in got]
        except Exception as e:
            said = f"{type(e).__name__}: {e}"
    if len(payloads) == 1:
        return [(None, said)]
    return [x for p in payloads for x in _asked(service, client, [p])]


def _calls(service: Service, kind: pa.DataType) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        client = None
        for batch in batches:
            for at in range(0, batch.num_rows, service.batch):
                some = batch.slice(at, service.batch)
                payloads = some.column(1).to_pylist()
                try:
                    client = client if client is not None else service.make()
                    found = _asked(service, client, payloads)
                except Exception as e:  # no client at all
                    found = [(None, f"{type(e).__name__}: {e}")] * len(payloads)
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array([a for a, _ in found], kind), pa.array([e for _, e in found], pa.string())], names=["digest", "answer", "error"])

    return run


def answered(payloads: DataFrame, service: Service, known: BucketTable | None = None) -> DataFrame:
    """(digest, answer, error) of the distinct payloads in the one column; what is in ``known`` isn't asked for."""
    spark, column = payloads.sparkSession, payloads.columns[0]
    kind = T._parse_datatype_string(service.answer)
    rows = payloads.where(F.col(column).isNotNull()).select(digest(F.col(column)).alias("digest"), F.col(column).alias("payload"))
    rows = rows.dropDuplicates(["digest"])  # within tasks first, so a payload of a third of all rows is no more than one row a task
    told = None
    if known is not None:
        told = scratch.keep(rows.select("digest").join(known.read(), "digest").select("digest", "answer", F.lit(None).cast("string").alias("error")))
        rows = rows.join(told.select("digest"), "digest", "left_anti")
    lanes = service.lanes or spark.sparkContext.defaultParallelism
    asked = rows.repartition(lanes, "digest").mapInArrow(_calls(service, to_arrow_type(kind)), T.StructType([T.StructField("digest", T.StringType()), T.StructField("answer", kind), T.StructField("error", T.StringType())]))
    asked = scratch.keep(asked)
    if known is None:
        return asked
    known.replace(asked.where("error is null").select("digest", "answer"))
    return told.unionByName(asked)


def joined(rows: DataFrame, column: str, answers: DataFrame, as_: str) -> DataFrame:
    """The rows with their payload's answer as ``as_``, and its ``<as_>_error``; a payload that many rows have is split by adaptive execution."""
    found = answers.select(F.col("digest").alias("_digest"), F.col("answer").alias(as_), F.col("error").alias(f"{as_}_error"))
    return rows.drop(as_, f"{as_}_error").withColumn("_digest", digest(F.col(column))).join(found, "_digest", "left").drop("_digest")
