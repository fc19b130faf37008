"""An evaluation of chunking strategies, as a run that can be resumed.

A run belongs to its settings, its corpus and its labelled queries: their digests
name its folder.  Strategies that have a manifest there are not run again.  The
others go through one plan: all their chunks are written together, what differs in
them and in the queries is embedded and searched once, and only then does each get
its manifest with what was counted.  So a run that ends early leaves nothing that counts, one with more
strategies adds to what is there, and one with other settings is another run.

Defined cases: flaws of the labelled set are an error before anything runs; a
strategy without chunks finds nothing; spans that have a ``doc_id`` are met only by
chunks of that document.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import scratch
from ..operators import chunk as chunking
from ..operators import evaluate, search
from ..operators.calls import Service, answered, digest
from ..sinks.buckets import BucketTable

STRATEGIES = ("sliding_window", "header_aware")


@dataclass(frozen=True)
class Settings:
    """``k_ratio`` over 0 takes k in proportion to a strategy's chunks, ``k_min`` at least, instead of ``top_k``."""

    strategies: tuple[str, ...] = STRATEGIES
    top_k: int = 5
    k_ratio: float = 0.0
    k_min: int = 3
    engine: str = "text_hash"


def golden(spark: SparkSession, labelled: dict) -> tuple[DataFrame, DataFrame]:
    """(queries, spans) of a labelled set as its file has it: ``queries`` with id, type, query, expected_advantage and answer_spans."""
    queries = [(q.get("id"), q.get("type", "unknown"), q.get("query"), q.get("expected_advantage")) for q in labelled.get("queries", [])]
    spans = [(q.get("id"), k, s.get("start_line"), s.get("end_line")) for q in labelled.get("queries", []) for k, s in enumerate(q.get("answer_spans") or [])]
    return spark.createDataFrame(queries, "qid string, type string, query string, expected_advantage string"), spark.createDataFrame(spans, "qid string, span_idx int, start_line int, end_line int")


def _digest(df: DataFrame) -> str:
    """A digest of a table's rows in any order: their number, and the sum of their hashes."""
    row = df.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64(*(F.to_json(F.struct(c)) for c in sorted(df.columns))).cast("decimal(38,0)")), F.lit(0)).alias("s")).first()
    return f"{row.n}-{int(row.s) & (1 << 64) - 1:016x}"


class Run:
    """Evaluates strategies over ``elements`` for ``queries`` (qid, type, query, expected_advantage) and ``spans`` (qid, span_idx, start_line, end_line)."""

    def __init__(self, root: str, elements: DataFrame, queries: DataFrame, spans: DataFrame, settings: Settings = Settings(), engine: str | Service | None = None, known: BucketTable | None = None) -> None:
        self.spark, self.elements, self.queries, self.spans, self.settings = elements.sparkSession, elements, queries, spans, settings
        self.engine, self.known = search.engine(engine if engine is not None else settings.engine), known
        flaws = evaluate.invalid_golden(queries, spans).limit(20).collect()
        if flaws:
            raise ValueError("flaws of the labelled set: " + "; ".join(f"{r.qid}: {r.problem}" for r in flaws))
        shared = {k: v for k, v in asdict(settings).items() if k != "strategies"}
        self.of = {"settings": shared, "corpus": _digest(elements.select("doc_id", "element_idx", "type", "content", "location")), "queries": _digest(queries), "spans": _digest(spans)}
        self.path = f"{root.rstrip('/')}/{hashlib.sha256(json.dumps(self.of, sort_keys=True).encode()).hexdigest()[:16]}"

    # ---- manifests ---------------------------------------------------------------------------------------------------

    def manifests(self) -> dict[str, dict]:
        """What each finished strategy has recorded, of those in the settings."""
        out = {}
        for strategy in self.settings.strategies:
            fs, p = scratch.file_system(self.spark, f"{self.path}/{strategy}.json")
            if fs.exists(p):
                stream = fs.open(p)
                try:
                    out[strategy] = json.loads(bytes(stream.readAllBytes()).decode())
                finally:
                    stream.close()
        return out

    def _record(self, manifest: dict) -> None:
        fs, p = scratch.file_system(self.spark, f"{self.path}/{manifest['strategy']}.json")
        _, draft = scratch.file_system(self.spark, f"{self.path}/{uuid.uuid4().hex}.draft")
        out = fs.create(draft, False)
        out.write(bytearray(json.dumps(manifest, ensure_ascii=False).encode()))
        out.close()
        if not fs.rename(draft, p):
            fs.delete(draft, False)

    # ---- the run -----------------------------------------------------------------------------------------------------

    def _embedded(self, rows: DataFrame, column: str) -> DataFrame:
        """(key, vector) of the rows' keys, a row for each."""
        rows = rows.select("key", column).dropDuplicates(["key"])
        if not isinstance(self.engine, Service):
            return rows.select("key", self.engine(F.col(column)).alias("vector"))
        found, failed = search.embed_remote(rows, self.engine, self.known, column)
        if (bad := failed.first()) is not None:
            raise RuntimeError(f"{self.engine.name} has not embedded all of {column}: {bad.error}")
        return found.select("key", "vector")

    def run(self) -> list[str]:
        """Runs what isn't there yet; the strategies that have been run now."""
        missing = [s for s in self.settings.strategies if s not in self.manifests()]
        if not missing:
            return []
        at, began = f"{self.path}/{uuid.uuid4().hex}", time.time()
        chunks = None
        for s in missing:
            some = chunking.chunk(self.elements, s)[0].select(F.lit(s).alias("strategy"), "doc_id", "chunk_id", "page_content", F.col("location.start_line").alias("start_line"), F.col("location.end_line").alias("end_line"))
            chunks = some if chunks is None else chunks.unionByName(some)
        key = lambda column: search.key(F.col(column), self.engine).alias("key")
        chunks = scratch.keep(chunks.select("strategy", "doc_id", "chunk_id", "page_content", "start_line", "end_line", key("page_content")), f"{at}/chunks")
        vectors = scratch.keep(self._embedded(chunks, "page_content"), f"{at}/vectors")
        counts = {r.strategy: r.n for r in chunks.groupBy("strategy").agg(F.count("*").alias("n")).collect()}
        queries = scratch.keep(self.queries.select("qid", "query", key("query")), f"{at}/queries")
        asked = search.asked(self._embedded(queries, "query").select(F.col("key").alias("query_id"), F.col("vector").alias("query_vector")))
        found, k = None, {}
        for s in missing:
            n = counts.get(s, 0)
            k[s] = max(self.settings.k_min, round(self.settings.k_ratio * n)) if self.settings.k_ratio > 0 else self.settings.top_k
            best = search.top_k_keyed(chunks.where(F.col("strategy") == s).drop("page_content"), vectors, asked, k[s])
            found = best if found is None else found.unionByName(best)
        found = found.join(queries.select("qid", F.col("key").alias("query_id")), "query_id").select("strategy", "qid", "rank", "doc_id", "chunk_id", "start_line", "end_line", "score")
        found = scratch.keep(found, f"{at}/retrievals")
        returned = {r.strategy: r.n for r in found.groupBy("strategy").agg(F.count("*").alias("n")).collect()}
        for s in missing:
            self._record(self.of | {"strategy": s, "at": at, "k": k[s], "n_chunks": counts.get(s, 0), "n_retrieved": returned.get(s, 0), "seconds": round(time.time() - began, 3)})
        return missing

    # ---- results -----------------------------------------------------------------------------------------------------

    def _tables(self, name: str) -> DataFrame:
        out = None
        for s, m in self.manifests().items():
            some = self.spark.read.parquet(f"{m['at']}/{name}").where(F.col("strategy") == s)
            out = some if out is None else out.unionByName(some)
        if out is None:
            raise ValueError("nothing has been run yet")
        return out

    def retrievals(self) -> DataFrame:
        return self._tables("retrievals")

    def scores(self) -> DataFrame:
        """Per strategy and query, those that found nothing among them."""
        return evaluate.score(self.retrievals(), self.spans)

    def results(self) -> dict[str, DataFrame]:
        """The tables of a report: metrics, by type, agreement with expectations, coverage, and warnings."""
        scores = self.scores()
        chunks = self._tables("chunks").drop("page_content", "key")
        counts = chunks.groupBy("strategy").agg(F.count("*").alias("n_chunks"))
        return {
            "metrics": evaluate.metrics(scores, "strategy").join(counts, "strategy", "left"),
            "by_type": evaluate.report(scores, self.queries),
            "agreement": evaluate.agreement(scores, self.queries, list(self.settings.strategies)),
            "coverage": evaluate.coverage(chunks, self.spans),
            "profile": chunks.groupBy("strategy").agg(F.count("*").alias("n_chunks"), F.min("start_line").alias("first_line"), F.max("end_line").alias("last_line")),
            "warnings": evaluate.warnings(scores, counts, fixed_k=self.settings.k_ratio <= 0),
        }


def gate(spark: SparkSession, engine: str | Service, probes: list[tuple[str, str, str]], least: float = 0.05) -> DataFrame:
    """One row, as ``evaluate.vector_gate``: whether the engine tells like (first, second) from unlike (first, third) texts, one by one and in a batch."""
    found = search.engine(engine)
    texts = spark.createDataFrame([(t,) for p in probes for t in p], "t string").distinct()
    paths = []
    for path in ("query", "batch"):
        if isinstance(found, Service):
            answers = answered(texts, found if path == "batch" else Service(**{f: getattr(found, f) for f in found.__dataclass_fields__} | {"batch": 1}))
            vectors = texts.withColumn("digest", digest(F.col("t"))).join(answers, "digest").select("t", F.col("answer").alias("v"))
        else:
            vectors = texts.select("t", found(F.col("t")).alias("v"))
        paths.append(vectors.select(F.lit(path).alias("path"), "t", "v"))
    vectors = scratch.keep(paths[0].unionByName(paths[1]))
    of = lambda name: vectors.select("path", F.col("t").alias(name), F.col("v").alias(f"v_{name}"))
    rows = spark.createDataFrame(probes, "a string, b string, c string").join(of("a"), "a").join(of("b"), ["path", "b"]).join(of("c"), ["path", "c"])
    from ..functions.vectors import separation

    return evaluate.vector_gate(rows.select("path", F.size("v_a").alias("dimension"), separation(F.col("v_a"), F.col("v_b"), F.col("v_c")).alias("separation")), least)
