"""Whole plans over any number of documents: load, chunk, ingest, search."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .. import scratch
from ..operators import chunk as chunking
from ..operators import clean as cleaning
from ..operators import search as searching
from ..operators.calls import Service, answered
from ..sinks.buckets import BucketTable
from ..sinks.store import VectorStore, VersionedVectorStore
from ..sources import readers


def parse(spark: SparkSession, path: str, clean: bool = True) -> DataFrame:
    """Elements of all documents under a path."""
    return readers.load_batch(spark, path, clean)[0]


def parse_and_chunk(spark: SparkSession, path: str, strategy: str = "auto", clean: bool = True) -> DataFrame:
    return chunking.chunk(parse(spark, path, clean), strategy)[0]


def ingest(
    elements: DataFrame,
    store: VectorStore,
    collection: str,
    strategy: str = "auto",
    engine: str | Service = "text_hash",
    clean: bool = True,
    once: bool = False,
    known: BucketTable | None = None,
    failures: str | None = None,
) -> tuple[int, int]:
    """Cleans, chunks, embeds and writes; (documents with chunks, chunks written), observed while writing.  No chunks at all is an error.

    A store of versions takes the chunks in place of what their documents had,
    and drops those of documents that have none any more.  With a service as
    engine, ``known`` remembers its answers; chunks that it can't embed are added
    to the table at ``failures``, and without one they are an error before
    anything is written.
    """
    whole = elements
    elements = cleaning.clean(elements) if clean else elements
    chunks, parents = chunking.chunk(elements, strategy)
    meta = F.to_json(F.struct("doc_id", "chunk_type", "header_path", "parent_id", "element_ids", "elements_count", "primary_element_type", "location"))
    chunks, engine = chunks.withColumn("metadata", meta), searching.engine(engine)
    if isinstance(engine, Service):
        # Chunks are read for their texts, their vectors and their failures.
        rows, bad = searching.embed_remote(scratch.keep(chunks), engine, known)
        bad = scratch.keep(bad.select(F.lit(collection).alias("collection"), "doc_id", "chunk_id", "error"))
        if failures is not None:
            bad.write.mode("append").parquet(failures)
        elif (one := bad.first()) is not None:
            raise RuntimeError(f"{engine.name} has not embedded {bad.count()} chunks, among them {one.chunk_id}: {one.error}")
    else:
        rows = searching.embed(chunks, engine)
    seen, written = Observation(), Observation()
    rows = rows.observe(seen, F.count_if(F.col("chunk_idx") == 0).alias("docs"), F.count("*").alias("n"))
    if isinstance(store, VersionedVectorStore):
        store.replace(rows, collection, whole.select("doc_id").distinct(), written)
    else:
        store.append(rows, collection, once, written)
    if not seen.get["n"] and store.read(collection).isEmpty():
        raise ValueError("the documents have no chunks")
    return seen.get["docs"], written.get["n"]


def search(store: VectorStore, collection: str, query: str, k: int = searching.K, engine: str | Service = "text_hash", known: BucketTable | None = None) -> DataFrame:
    """(chunk_id, page_content, metadata, score) of the k best chunks."""
    searching.check_request(query, k)
    engine = searching.engine(engine)
    if isinstance(engine, Service):
        wanted, error = answered(store.spark.createDataFrame([(query,)], "text string"), engine, known).select("answer", "error").first()
        if error:
            raise RuntimeError(f"{engine.name} has not embedded the query: {error}")
    else:
        wanted = store.spark.range(1).select(engine(F.lit(query)).alias("v")).first().v
    found = searching.top_k(store.read(collection), wanted, k)
    return found.select("chunk_id", "page_content", "metadata", "score")
