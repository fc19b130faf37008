"""Registered queries over what lies outside tables: folders, archives, stores with versions, streams of jobs, services and addresses.

What they read is written, within the query, from the given tables to the folder
that the cluster shares; services and the web are stand-ins that answer by rule.
"""

from __future__ import annotations

import io
import tarfile
import zipfile

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import scratch
from ..operators import calls, enrich, search, vindex
from ..sinks.buckets import BucketTable
from ..sinks.store import JobStore
from ..sources import folders, readers, web
from ..streaming import lifecycle
from . import evaluation
from .queries import JOBS, OUTLINE, embedding_store, job_log, outline, query, sliding_sql, table


#: Bytes of text in an archive, about.
ARCHIVE = 128 << 20


def _written(rows: DataFrame, write) -> None:
    """Runs ``write`` over each task's rows; it gets (task number, batches)."""

    def run(batches):
        from pyspark import TaskContext

        yield pa.RecordBatch.from_pydict({"n": pa.array([write(TaskContext.get().partitionId(), batches)], pa.int64())})

    rows.mapInArrow(run, "n long").agg(F.sum("n")).collect()


# ---- folders and archives -------------------------------------------------------------------------------------------


@query("SELECT doc_id, strlen(coalesce(text, ''))::BIGINT AS n_bytes, md5(coalesce(text, '')) AS digest FROM documents")
def folder_files(spark, sf_dir):
    """Documents as files of a tree of folders, some with names that Spark's own listing passes by."""
    root = scratch.new_dir(spark)

    def write(_, batches):
        there, base = folders.system(root)
        made, n = set(), 0
        for batch in batches:
            for doc, text, lang in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                folder = f"{base}/{lang}/{'_' if doc % 2 else '.'}{doc // 100}"
                if folder not in made:
                    there.create_dir(folder, recursive=True)
                    made.add(folder)
                with there.open_output_stream(f"{folder}/{doc}.TXT") as f:
                    f.write((text or "").encode())
                n += 1
        return n

    _written(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), write)
    found = readers.files(spark, root).where("error is null")
    return found.select(F.regexp_extract("name", r"^(\d+)", 1).cast("long").alias("doc_id"), F.length("content").cast("long").alias("n_bytes"), F.md5("content").alias("digest"))


@query("SELECT 'zip' AS kind, doc_id AS id, strlen(coalesce(text, ''))::BIGINT AS n_bytes, md5(coalesce(text, '')) AS digest FROM documents UNION ALL SELECT 'tar', page_id, strlen(coalesce(html, ''))::BIGINT, md5(coalesce(html, '')) FROM pages")
def archive_members(spark, sf_dir):
    """Documents in zip files and pages in tar files, large ones of each, two at least, whose members several tasks read."""
    root = scratch.new_dir(spark)

    def dealt(name, key, text):
        """Rows by archive: as many archives as the texts need, so that the task which writes one reads no more as the table grows."""
        rows = table(spark, sf_dir, name).select(key, text)
        n = rows.agg(F.sum(F.octet_length(text)).alias("n")).first().n or 0
        return rows.repartition(max(2, -(-n // ARCHIVE)), key)

    def pack(kind):
        def write(task, batches):
            there, base = folders.system(root)
            there.create_dir(base, recursive=True)
            n = 0
            with there.open_output_stream(f"{base}/{task}.{kind}") as f, zipfile.ZipFile(f, "w", zipfile.ZIP_DEFLATED) if kind == "zip" else tarfile.open(fileobj=f, mode="w|") as out:
                for batch in batches:
                    for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                        data = (text or "").encode()
                        if kind == "zip":
                            out.writestr(f"{i % 10}/{i}.txt", data)
                        else:
                            info = tarfile.TarInfo(f"{i % 10}/{i}.html")
                            info.size = len(data)
                            out.addfile(info, io.BytesIO(data))
                        n += 1
            return n

        return write

    _written(dealt("documents", "doc_id", "text"), pack("zip"))
    _written(dealt("pages", "page_id", "html"), pack("tar"))
    found = readers.archive_files(spark, root).where("error is null")
    kind = F.regexp_extract("path", r"^[^/]*\.(zip|tar)/", 1)
    return found.select(kind.alias("kind"), F.regexp_extract("name", r"^(\d+)", 1).cast("long").alias("id"), F.length("content").cast("long").alias("n_bytes"), F.md5("content").alias("digest"))


# ---- stores with versions -------------------------------------------------------------------------------------------


@query("SELECT conv_id, turn, CASE conv_id % 3 WHEN 0 THEN 'again: ' ELSE '' END || text AS content FROM conversations WHERE conv_id % 3 = 2 OR (conv_id % 3 = 0 AND role <> 'assistant')")
def store_replaced(spark, sf_dir):
    """Conversations are stored, a third is stored again with fewer turns, and a third is deleted."""
    t = table(spark, sf_dir, "conversations")
    rows = t.select("conv_id", "turn", F.col("text").alias("content"))
    store = BucketTable(spark, scratch.new_dir(spark), "conv_id long, turn long, content string", "conv_id", 16)
    store.replace(rows)
    again = t.where("conv_id % 3 = 0")
    store.replace(again.where("role <> 'assistant'").select("conv_id", "turn", F.concat(F.lit("again: "), "text").alias("content")), again.select("conv_id"))
    store.delete(t.where("conv_id % 3 = 1").select("conv_id"))
    return store.read()


@query(f"WITH {JOBS} SELECT id, status, seq, finished_at, created_at FROM latest WHERE NOT (status IN ('succeeded', 'failed') AND finished_at < 30.0)")
def jobs_stored(spark, sf_dir):
    """Records of jobs upserted in an order that isn't theirs, and swept."""
    log = job_log(spark, sf_dir)
    store = JobStore(spark, scratch.new_dir(spark), 16)
    for status in (("succeeded", "failed"), ("queued",), ("running",)):
        store.put(log.where(F.col("status").isin(*status)))
    store.sweep(40.0, 10.0)
    return store.jobs().select("id", "status", "seq", "finished_at", "created_at")


@query("""
WITH q AS (SELECT vec_id query_id, embedding::DOUBLE[] v FROM embeddings WHERE vec_id % 50 = 0), s AS (SELECT query_id, vec_id AS chunk_id, list_cosine_similarity(embedding::DOUBLE[], v) score FROM embeddings, q)
SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INT AS "rank", round(score, 9) AS score FROM s QUALIFY "rank" <= 4
""")
def search_indexed(spark, sf_dir):
    """Every fiftieth vector against all, through an index of tiles and bounds."""
    store = embedding_store(spark, sf_dir)
    index = vindex.build(store, scratch.new_dir(spark), tile=64)
    queries = store.where("chunk_id % 50 = 0").select(F.col("chunk_id").alias("query_id"), F.col("vector").alias("query_vector"))
    return vindex.search(index, spark, queries, 4)[0].select("query_id", "chunk_id", "rank", F.round("score", 9).alias("score"))


# ---- streams --------------------------------------------------------------------------------------------------------


@query("""
WITH j AS (SELECT 'job-' || user_id AS id, CASE event_type WHEN 'click' THEN 'running' WHEN 'purchase' THEN 'succeeded' WHEN 'error' THEN 'failed' ELSE 'queued' END AS status, event_id AS seq, epoch_us(ts) AS us FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
b AS (SELECT *, lag(status) OVER w AS p, lag(us) OVER w AS pu, lead(us) OVER w AS nu FROM j WINDOW w AS (PARTITION BY id ORDER BY us, seq)),
c AS (SELECT *, CASE WHEN p IN ('succeeded', 'failed') AND pu + 86400000000 < us THEN NULL ELSE p END AS before FROM b)
SELECT 'illegal' AS report, id, seq, before, status, us FROM c WHERE NOT coalesce((before IS NULL AND status = 'queued') OR (before = 'queued' AND status IN ('running', 'failed')) OR (before = 'running' AND status IN ('succeeded', 'failed')), false)
UNION ALL SELECT 'expired', id, NULL, NULL, status, us FROM c WHERE status IN ('succeeded', 'failed') AND us + 86400000000 < coalesce(nu, (SELECT max(us) FROM j) - 3600000000)
""")
def jobs_followed(spark, sf_dir):
    """A log of jobs as a stream: illegal records, and jobs whose time to live of a day has passed."""
    status = F.element_at(F.create_map(*(F.lit(x) for p in (("view", "queued"), ("click", "running"), ("purchase", "succeeded"), ("error", "failed"), ("signup", "queued")) for x in p)), F.col("event_type"))
    at = scratch.new_dir(spark)
    log = table(spark, sf_dir, "events").select(F.concat(F.lit("job-"), "user_id").alias("id"), status.alias("status"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("at"))
    log.write.parquet(f"{at}/log")
    stream = spark.readStream.schema(log.schema).parquet(f"{at}/log")
    lifecycle.follow(stream, f"{at}/reports", f"{at}/checkpoint", ttl=86400.0).awaitTermination()
    illegal, expired = lifecycle.parted(spark, f"{at}/reports")
    none = F.lit(None)
    out = illegal.select(F.lit("illegal").alias("report"), "id", "seq", "before", "status", F.unix_micros("at").alias("us"))
    return out.unionByName(expired.select(F.lit("expired").alias("report"), "id", none.cast("long").alias("seq"), none.cast("string").alias("before"), "status", F.unix_micros("finished_at").alias("us")))


# ---- services and addresses -----------------------------------------------------------------------------------------


def _measured(_, texts: list[str]) -> list[list[float]]:
    if any(not t.strip() for t in texts):
        raise ValueError("nothing to embed")
    return [[float(len(t)), float(t.count("e"))] for t in texts]


@query("SELECT doc_id, CASE WHEN blank THEN NULL ELSE length(text) END::DOUBLE AS n_chars, CASE WHEN blank THEN NULL ELSE length(text) - length(replace(text, 'e', '')) END::DOUBLE AS n_e, blank AS failed FROM (SELECT *, text IS NULL OR NOT regexp_matches(text, '[^\\x00-\\x20]') AS blank FROM documents)")
def embedding_calls(spark, sf_dir):
    """Documents through a service in batches of 20; blank texts fail, and their batches are told apart."""
    service = calls.Service(make=dict, ask=_measured, answer="array<double>", tries=2, wait=0.0)
    done, failed = search.embed_remote(table(spark, sf_dir, "documents").select("doc_id", "text"), service, column="text")
    out = done.select("doc_id", F.col("vector")[0].alias("n_chars"), F.col("vector")[1].alias("n_e"), F.lit(False).alias("failed"))
    none = F.lit(None).cast("double")
    return out.unionByName(failed.select("doc_id", none.alias("n_chars"), none.alias("n_e"), F.lit(True).alias("failed")))


def _captions(_, pictures: list[bytes]) -> list[str]:
    return [f"a picture of {len(x)} bytes" for x in pictures]


def _never(_, pictures: list[bytes]) -> list[str]:
    raise RuntimeError("a picture was sent again")


@query("SELECT page_id, 'a picture of ' || strlen(html) || ' bytes' AS content, true AS caption_generated FROM pages WHERE html IS NOT NULL AND html <> '' UNION ALL SELECT page_id, 'old', false FROM pages WHERE html IS NULL UNION ALL SELECT page_id, 'a picture of 0 bytes', true FROM pages WHERE html = ''")
def captions_by_content(spark, sf_dir):
    """Pages as pictures, described twice: the second time every answer comes from the memo."""
    pages = table(spark, sf_dir, "pages")
    path = F.concat(F.lit("p"), "page_id")
    images = pages.select("page_id", F.lit("image").alias("type"), F.lit("old").alias("content"), path.alias("file_name"), F.lit(None).cast("string").alias("metadata"))
    contents = pages.select(path.alias("path"), F.encode("html", "UTF-8").alias("content"))
    service = calls.Service(make=dict, ask=_captions, answer="string")
    memo = calls.memo(spark, scratch.new_dir(spark), service)
    scratch.keep(enrich.caption_images(images, contents, service, memo))
    again = calls.Service(make=dict, ask=_never, answer="string", tries=1)
    return enrich.caption_images(images, contents, again, memo).select("page_id", "content", "caption_generated")


def _tools():
    def resolve(host: str) -> list[str]:
        return ["10.1.2.3"] if host == "inside.example.org" else ["93.184.216.34"]

    def fetch(url: str, address: str) -> web.Response:
        way = url.rsplit("/", 1)[1]
        there = {"moved": f"{way}/landed", "mapped": "http://[::ffff:10.0.0.1]/x", "decimal": "http://2130706433/x", "named": "https://inside.example.org/x", "circle": url}.get(way.rstrip("0123456789"))
        return web.Response(302, location=there) if there else web.Response(200, url.encode())

    return resolve, fetch


@query("""
SELECT page_id, CASE page_id % 6 WHEN 0 THEN strlen(u) WHEN 1 THEN strlen(u) + 7 END::BIGINT AS n_bytes,
  CASE page_id % 6 WHEN 2 THEN 'ValueError: refused: ::ffff:10.0.0.1 is not public' WHEN 3 THEN 'ValueError: refused: 127.0.0.1 is not public' WHEN 4 THEN 'ValueError: refused: 10.1.2.3 is not public' WHEN 5 THEN 'ValueError: more than 3 redirects' END AS error
FROM (SELECT page_id, regexp_extract(url, '^https?://[^/]*') || '/a/' || ['plain', 'moved', 'mapped', 'decimal', 'named', 'circle'][page_id % 6 + 1] || page_id AS u FROM pages)
""")
def url_scan(spark, sf_dir):
    """Addresses of the pages' hosts in rounds of redirects; some lead to places that aren't public."""
    way = F.element_at(F.array(*map(F.lit, ("plain", "moved", "mapped", "decimal", "named", "circle"))), (F.col("page_id") % 6 + 1).cast("int"))
    urls = table(spark, sf_dir, "pages").select("page_id", F.concat(F.regexp_extract("url", "^https?://[^/]*", 0), F.lit("/a/"), way, "page_id").alias("url"))
    found = web.fetch(urls.select("url"), _tools, hops=3)
    return urls.join(found, "url").select("page_id", F.length("content").cast("long").alias("n_bytes"), "error")


# ---- evaluation -----------------------------------------------------------------------------------------------------


@query(f"""
WITH RECURSIVE {OUTLINE}, items AS MATERIALIZED (SELECT doc_id AS k, row_number() OVER (PARTITION BY doc_id ORDER BY element_idx) - 1 AS i, length(content)::BIGINT AS n, content FROM outline), {sliding_sql("items", 512, 64, "w")},
n AS (SELECT 'sliding_window' AS strategy, count(*) AS n_chunks FROM wspans UNION ALL SELECT 'header_aware', count(*) FROM (SELECT DISTINCT doc_id, sum((type = 'heading')::INT) OVER (PARTITION BY doc_id ORDER BY element_idx) AS s FROM outline))
SELECT strategy, n_chunks, (SELECT count(DISTINCT conv_id) FROM conversations) AS n_queries, (SELECT count(DISTINCT conv_id) FROM conversations) * least(4, n_chunks) AS n_retrieved FROM n
""")
def evaluation_run(spark, sf_dir):
    """Conversations by two strategies; a conversation's first turn asks for its own lines."""
    elements = outline(spark, sf_dir)
    first = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.min_by("text", "turn").alias("query"), F.count("*").alias("n"))
    qid = F.concat(F.lit("Q"), "conv_id")
    queries = first.select(qid.alias("qid"), F.lit("own").alias("type"), "query", F.lit("header_aware").alias("expected_advantage"))
    spans = first.select(qid.alias("qid"), F.lit(0).alias("span_idx"), F.col("conv_id").alias("doc_id"), F.lit(1).alias("start_line"), F.col("n").cast("int").alias("end_line"))
    run = evaluation.Run(scratch.new_dir(spark), elements, queries, spans, evaluation.Settings(("sliding_window", "header_aware"), top_k=4))
    run.run()
    counts = run.results()["metrics"].select("strategy", "n_chunks", "n_queries")
    return counts.join(run.retrievals().groupBy("strategy").agg(F.count("*").alias("n_retrieved")), "strategy")
