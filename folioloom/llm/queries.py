"""Registered queries of the training-data operators, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, bytebpe, decontaminate, divergence, embeddup, htmltext, ngramjoin, pitmanyor, quality, sharding, toxicity, warc, whitening
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES["op1_decontamination"] = op1_decontamination
ORACLE_SQL["op1_decontamination"] = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w FROM benchmark),
lengths AS (SELECT DISTINCT least(10, len(w)) n FROM b WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, n, list_aggregate(w[i:i + n - 1], 'string_agg', ' ') t FROM (SELECT item_id, w, least(10, len(w)) n, unnest(generate_series(1, len(w) - least(10, len(w)) + 1)) i FROM b WHERE len(w) > 0)),
places AS (SELECT doc_id, n, i, list_aggregate(w[i:i + n - 1], 'string_agg', ' ') t FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) i FROM d, lengths WHERE len(w) >= n)),
found AS (SELECT doc_id, item_id, p.n, i FROM places p JOIN windows USING (n, t)),
hits AS (SELECT doc_id, count(DISTINCT j) n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) j FROM found) GROUP BY 1),
items AS (SELECT doc_id, count(*) n_items, string_agg(item, ',' ORDER BY item) listed FROM (SELECT DISTINCT doc_id, item_id::VARCHAR item FROM found) GROUP BY 1)
SELECT d.doc_id, len(d.w)::BIGINT n_words, coalesce(n_hit, 0)::BIGINT n_hit, coalesce(n_items, 0)::BIGINT n_items, sha256(coalesce(listed, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def benchmark_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.longest_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES["benchmark_matches"] = benchmark_matches
# Windows that follow each other in text and item alike are one match.
ORACLE_SQL["benchmark_matches"] = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w FROM benchmark),
lengths AS (SELECT DISTINCT least(10, len(w)) n FROM b WHERE len(w) > 0),
windows AS (SELECT item_id, n, j, list_aggregate(w[j:j + n - 1], 'string_agg', ' ') t FROM (SELECT item_id, w, least(10, len(w)) n, unnest(generate_series(1, len(w) - least(10, len(w)) + 1)) j FROM b WHERE len(w) > 0)),
places AS (SELECT doc_id, n, i, list_aggregate(w[i:i + n - 1], 'string_agg', ' ') t FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) i FROM d, lengths WHERE len(w) >= n)),
found AS (SELECT doc_id, item_id, n, i, j, i - row_number() OVER (PARTITION BY doc_id, item_id, i - j ORDER BY i) AS island FROM places JOIN windows USING (n, t))
SELECT doc_id, item_id::VARCHAR item_id, min(i) - 1 AS doc_word, min(j) - 1 AS item_word, max(i) - min(i) + max(n) AS n_words FROM found GROUP BY doc_id, item_id, i - j, island
"""


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramjoin.jaccard_components(table(spark, sf_dir, "documents"), n=3, percent=90)


QUERIES["op2_ngram_join"] = op2_ngram_join
ORACLE_SQL["op2_ngram_join"] = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, list_aggregate(w[i:i + 2], 'string_agg', ' ') t FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 2, 1))) i FROM w WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) n FROM s GROUP BY 1),
pairs AS (SELECT x.doc_id a, y.doc_id b, count(*) both_have FROM s x JOIN s y ON x.t = y.t AND x.doc_id < y.doc_id GROUP BY 1, 2),
links AS MATERIALIZED (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * both_have >= 90 * (x.n + y.n - both_have)),
edges AS MATERIALIZED (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT doc_id node, doc_id r FROM w UNION SELECT e.b, reach.r FROM reach JOIN edges e ON e.a = reach.node)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT n_shingles, c.c component_id FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT node, min(r) c FROM reach GROUP BY 1) c ON c.node = w.doc_id
"""


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES["op4_quality"] = op4_quality


def _remainder(n: int):
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % n, F.lit(-1))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), usable=_remainder(4) != 2)
    return toxicity.scores(docs, model).select("doc_id", (_remainder(4) == 2).alias("held_out"), "score", "predicted")


QUERIES["op10_toxicity"] = op10_toxicity


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.round_trip(table(spark, sf_dir, "pages"), least_bytes=0)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "valid")


QUERIES["op3_warc"] = op3_warc
ORACLE_SQL["op3_warc"] = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) n, sha1(coalesce(html, '')) h FROM pages),
t AS (SELECT h, n, max(page_id) top FROM p GROUP BY 1, 2)
SELECT page_id, p.n::BIGINT payload_bytes,
  list_aggregate([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(p.h, 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INT, 1) FOR i IN range(32)], 'string_agg', '') payload_digest,
  CASE WHEN page_id < top THEN 'revisit' ELSE 'response' END record_type, CASE WHEN page_id < top THEN top END refers_to, true AS "valid"
FROM p JOIN t USING (h, n)
"""


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"), shards=40, law="bytes")


QUERIES["op6_sharding"] = op6_sharding


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.main_text(table(spark, sf_dir, "pages"))


QUERIES["op7_html"] = op7_html


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


QUERIES["op9_bpe"] = op9_bpe


def op5_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pitmanyor.score(table(spark, sf_dir, "documents"), held_out=_remainder(5) == 1)
    return found.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


QUERIES["op5_pitman_yor"] = op5_pitman_yor


def op8_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddup.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.95)


QUERIES["op8_embeddings"] = op8_embeddings
ORACLE_SQL["op8_embeddings"] = """
WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id, embedding::DOUBLE[] e FROM embeddings),
sound AS MATERIALIZED (SELECT vec_id, e, sqrt(list_inner_product(e, e)) n FROM v WHERE e IS NOT NULL AND len([x FOR x IN e IF x IS NULL OR isnan(x) OR isinf(x)]) = 0 AND len([x FOR x IN e IF x <> 0]) > 0),
links AS MATERIALIZED (SELECT x.vec_id a, y.vec_id b FROM sound x JOIN sound y ON x.vec_id <> y.vec_id AND len(x.e) = len(y.e) WHERE list_inner_product(x.e, y.e) / (x.n * y.n) >= 0.95),
reach AS (SELECT vec_id node, vec_id r FROM v UNION SELECT l.b, reach.r FROM reach JOIN links l ON l.a = reach.node)
SELECT v.vec_id, coalesce(k.n, 0)::BIGINT n_links, c.c component_id, c.c = v.vec_id kept
FROM v LEFT JOIN (SELECT a, count(*) n FROM links GROUP BY 1) k ON k.a = v.vec_id JOIN (SELECT node, min(r) c FROM reach GROUP BY 1) c ON c.node = v.vec_id
"""


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bytebpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


QUERIES["op11_byte_bpe"] = op11_byte_bpe


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"), least_docs=3, ranks=200)


QUERIES["op12_source_divergence"] = op12_source_divergence
ORACLE_SQL["op12_source_divergence"] = r"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, coalesce(lang, '') lang, coalesce(source, '') source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') w FROM documents),
o AS MATERIALIZED (SELECT lang, source, r, term, count(*) n FROM (SELECT lang, source, r, unnest(w) term FROM d) GROUP BY ALL),
t AS MATERIALIZED (SELECT lang, term, sum(n)::HUGEINT n FROM o GROUP BY ALL HAVING count(*) >= 3),
g AS MATERIALIZED (SELECT DISTINCT lang, source FROM d),
c AS MATERIALIZED (SELECT g.lang, g.source, t.term, t.n lang_n, coalesce(k.n, 0)::HUGEINT n FROM g JOIN t USING (lang) LEFT JOIN (SELECT lang, source, term, sum(n) n FROM o GROUP BY ALL) k ON k.lang = g.lang AND k.source = g.source AND k.term = t.term),
s AS (SELECT lang, source, sum(n)::HUGEINT total, sum(lang_n)::HUGEINT lang_total, count(*)::HUGEINT terms FROM c GROUP BY ALL),
p AS MATERIALIZED (SELECT lang, source, term, n, 1 + 1000000000 * (n + 1) // (total + terms) p, 1 + 1000000000 * (lang_n + 1) // (lang_total + terms) q FROM c JOIN s USING (lang, source)),
v AS (SELECT x.lang, x.source, y.source item, sum((x.p - y.p) * (x.p - y.p) // y.p) v FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL),
pairs AS (SELECT x.lang, x.source, 'pair' part, y.source item, coalesce(v, 0)::BIGINT AS value FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source LEFT JOIN v ON v.lang = x.lang AND v.source = x.source AND v.item = y.source),
terms AS (SELECT lang, source, 'term' part, term item, ((p - q) * (p - q) // q)::BIGINT AS value FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INT AS rank FROM pairs
UNION ALL SELECT * FROM (SELECT lang, source, part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INT AS rank FROM terms) WHERE rank <= 200
"""


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"), components=4)


QUERIES["op13_whitening"] = op13_whitening
