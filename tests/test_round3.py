"""What the third review found."""

import pytest


def _sql(name, **tables):
    import duckdb

    import __spark_entry__

    con = duckdb.connect()
    for k, path in tables.items():
        con.sql(f"create view {k} as select * from read_parquet('{path}')")
    return sorted(con.sql(__spark_entry__.oracle_sql()[name]).fetchall())


def _made(tmp_path, name, **columns):
    import pyarrow as pa
    import pyarrow.parquet as pq

    path = tmp_path / f"{name}.parquet"
    pq.write_table(pa.table(columns), path)
    return str(path)


def _found(spark, name, tmp_path):
    import __spark_entry__

    return sorted(tuple(r) for r in __spark_entry__.queries()[name](spark, str(tmp_path)).collect())


def test_odd_headers_differ_beyond_page_26(spark, tmp_path):
    lines = ["\n".join(f"line {k}" for k in range(n)) for n in (5, 480)]
    path = _made(tmp_path, "documents", doc_id=[5, 10], text=lines)
    assert _found(spark, "drop_margins", tmp_path) == _sql("drop_margins", documents=path)


def test_row_wise_steps_run_once_before_rows_are_read_again(spark):
    from folioloom.operators import clean
    from folioloom.plans.queries import rows_of
    from pyspark.sql import functions as F

    t = spark.range(3).select(F.col("id").alias("d"), F.lit(0).alias("i"), F.concat(F.lit("ｗords of "), "id").alias("c"))
    found = clean.clean(rows_of(t, F.col("d"), F.col("i"), F.lit("text"), F.col("c")))
    assert "ArrowEvalPython" not in found._jdf.queryExecution().toString()
    assert sorted(r.content for r in found.collect()) == ["words of 0", "words of 1", "words of 2"]


def test_a_fingerprint_does_not_walk_all_known_pairs():
    from folioloom.operators import dedup

    class Known(dict):
        def keys(self):
            raise AssertionError("all known pairs were walked")

    known = dedup._Pairs()
    known.place = Known()
    assert known.fingerprint("some text") == known.fingerprint("some text") != known.fingerprint("other words")


def test_headings_with_references_cut_short(spark, tmp_path):
    html = [f"<html><body><h1>{x}</h1><p>text</p></body></html>" for x in ("a &amp;&amp;&amp", "b &lt &lt; &copy &x;", "c &amp;lt; &#x27;")]
    path = _made(tmp_path, "pages", page_id=[1, 2, 3], url=["", "", ""], html=html)
    assert _found(spark, "html_headings", tmp_path) == _sql("html_headings", pages=path)


def test_all_trusted_rows_teach_the_quality_model(spark):
    from folioloom.llm import quality

    from pyspark.sql import functions as F

    n = 50_050  # more than were once taken
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.lit("en").alias("lang"), F.lit("ab").alias("text"))
    labels = docs.select("doc_id", F.lit(1).alias("quality"))
    assert quality._trusted(docs, labels).count() == n
    assert quality.train(docs, labels) is not None


def test_equal_texts_are_searched_once(spark, tmp_path, monkeypatch):
    """only what differs reaches the driver, however many conversations ask; results are those of a search of all."""
    from folioloom.operators import search
    from folioloom.plans import evaluation
    from folioloom.sources import readers
    from pyspark.sql import functions as F

    texts = [f"{k % 4} words\nother words\n{k % 3} more" for k in range(60)]
    elements = readers.text_elements(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    queries = spark.createDataFrame([(f"Q{k}", "own", f"query {k % 5}", None) for k in range(40)], "qid string, type string, query string, expected_advantage string")
    spans = queries.select("qid", F.lit(0).alias("span_idx"), F.lit(1).alias("start_line"), F.lit(3).alias("end_line"))
    sent, plain = [], search._query_blocks
    monkeypatch.setattr(search, "_query_blocks", lambda q: (sent.append(len(ids)) or (ids, block) for ids, block in plain(q)))
    run = evaluation.Run(str(tmp_path / "runs"), elements, queries, spans, evaluation.Settings(top_k=7))
    run.run()
    assert sum(sent) == 5
    engine = search.engine("text_hash")
    asked = queries.select(F.col("qid").alias("query_id"), engine(F.col("query")).alias("query_vector"))
    from folioloom.operators import chunk

    for s in ("sliding_window", "header_aware"):
        want = search.top_k_each(search.embed(chunk.chunk(elements, s)[0], engine), asked, 7)
        rows = lambda df, q: sorted((r[q], r["rank"], r.doc_id, r.chunk_id, round(r.score, 9)) for r in df.collect())
        assert rows(run.retrievals().where(F.col("strategy") == s), "qid") == rows(want, "query_id")


def test_fingerprints_of_rows_are_not_grouped(spark, monkeypatch):
    """a row's fingerprint needs its own text alone, and the pairs that a task knows are bounded within a batch too."""
    from folioloom.operators import dedup
    from pyspark.sql import functions as F

    t = spark.range(300).select(F.col("id").alias("doc_id"), F.lit(0).alias("element_idx"), F.concat(F.lit("Text "), F.md5(F.col("id").cast("string"))).alias("content"))
    found = dedup.fingerprint_rows(t)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Aggregate" not in plan
    want = {r.doc_id: r.f for r in t.select("doc_id", dedup.fingerprint(F.col("content")).alias("f")).collect()}
    assert {r.doc_id: r.fingerprint for r in found.collect()} == want
    known = dedup._Pairs()
    first = known.fingerprint("some text")
    monkeypatch.setattr(dedup, "PAIRS", 20)
    for k in range(100):
        known.fingerprint(f"text number {k}")
        assert len(known.place) <= 20 + len(f"text number {k}")
    assert known.fingerprint("some text") == first


def test_archives_grow_in_number_with_what_they_hold(spark, tmp_path, monkeypatch):
    """F8: a task that writes an archive reads about ``ARCHIVE`` bytes, whatever the table."""
    from folioloom.plans import outside

    n = 240
    docs = _made(tmp_path, "documents", doc_id=list(range(n)), text=[None, *("wörd " * 40 for _ in range(n - 1))])
    pages = _made(tmp_path, "pages", page_id=list(range(n)), html=["<p>x</p>" * 30] * n)
    monkeypatch.setattr(outside, "ARCHIVE", 4000)
    parts, plain = [], outside._written
    monkeypatch.setattr(outside, "_written", lambda rows, write: (parts.append(rows.rdd.getNumPartitions()), plain(rows, write)))
    assert _found(spark, "archive_members", tmp_path) == _sql("archive_members", documents=docs, pages=pages)
    assert parts == [-(-(n - 1) * 240 // 4000), -(-n * 240 // 4000)]


def test_text_hash_vectors_are_made_without_python(spark):
    """no batch of vectors is held in Python; values are those of ``hashed``."""
    import numpy as np

    from folioloom.functions import vectors
    from pyspark.sql import functions as F

    t = spark.createDataFrame([("a",), ("",), ("文本",), (None,)], "t string").select("t", vectors.seed(F.col("t")).alias("s"), vectors.text_hash_vector(F.col("t")).alias("v"))
    assert "ArrowEvalPython" not in t._jdf.queryExecution().toString()
    for r in t.collect():
        assert r.v is None if r.t is None else r.v == vectors.hashed(np.array([r.s]))[0].tolist()


def test_windows_pass_by_in_one_stream(spark):
    """no call for a document or a window, and nothing joined back; both levels as the plain form cuts them, across batches."""
    import random

    import numpy as np
    import pyarrow as pa

    from folioloom.operators import chunk
    from folioloom.plans.queries import rows_of
    from pyspark.sql import functions as F

    rng = random.Random(3)
    for _ in range(200):
        docs = [[rng.choice([0, 5, 20, 60, 64, 100, 300, 511, 512, 700]) for _ in range(rng.randrange(1, 25))] for _ in range(4)]
        rows, step = [(d, i, n, i == 0, i == 0) for d, x in enumerate(docs) for i, n in enumerate(x)], rng.randrange(1, 14)
        batches = (pa.RecordBatch.from_pylist([dict(zip(("d", "i", "_n", "_first", "_head"), r, strict=True)) for r in rows[k : k + step]]) for k in range(0, len(rows), step))
        got = [(r["d"], r["i"], r["p"], r["c"], r["_all"]) for x in chunk._folded(chunk._folded(batches, 1024, 64, "p"), 256, 32, "c") for r in x.to_pylist()]
        want = []
        for d, x in enumerate(docs):
            n = -1
            for p, (a, b) in enumerate(chunk.spans(np.array(x), 1024, 64)):
                for c, (e, f) in enumerate(chunk.spans(np.array(x[a : b + 1]), 256, 32)):
                    n += 1
                    want += [(d, a + i, p, c, n) for i in range(e, f + 1)]
        assert got == want
    t = rows_of(spark.range(40), F.floor(F.col("id") / 10), F.col("id") % 10, F.lit("text"), F.repeat(F.lit("word "), 30))
    for found in (chunk.sliding_window(t), *chunk.parent_child(t)):
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan and "FlatMapGroups" not in plan
        assert found.count() > 4


def test_cleaned_lines_are_read_by_three_strategies_but_made_once(spark, tmp_path, monkeypatch):
    """what search reads is written, and a seed's score is worked out once in a task."""
    import numpy as np

    from folioloom.functions import vectors
    from folioloom.operators import search
    from folioloom.plans import queries
    from pyspark.sql import functions as F

    _made(tmp_path, "documents", doc_id=[1, 2], text=["one line\nanother line", "words " * 300])
    kept, plain = [], queries.scratch.keep
    monkeypatch.setattr(queries.scratch, "keep", lambda df: (kept.append(1), plain(df))[1])
    found = queries.search_documents(spark, str(tmp_path))
    assert kept and "normalize" not in found._jdf.queryExecution().toString() and "ArrowEvalPython" not in found._jdf.queryExecution().toString()
    assert {r.doc_id for r in found.collect()} == {1, 2}
    t = spark.range(50).select(F.lpad(F.col("id").cast("string"), 2, "0").alias("chunk_id"), F.concat(F.lit("t"), F.col("id") % 7).alias("page_content")).coalesce(1)
    wanted = vectors.hashed(np.array([5]))[0]
    want = search.top_k(t.withColumn("vector", vectors.text_hash_vector(F.col("page_content"))), wanted.tolist(), 9).collect()
    got = search.top_k_texts(t, wanted.tolist(), 9).collect()
    assert [(r.chunk_id, round(r.score, 9)) for r in got] == [(r.chunk_id, round(r.score, 9)) for r in want]


def test_no_text_is_shuffled_to_meet_its_label(spark, monkeypatch):
    """op4: trusted ids go to the texts, however large Spark takes the labels to be; beyond the bound they are joined, with the same rows."""
    from folioloom.llm import quality
    from pyspark.sql import functions as F

    docs = spark.range(100).select(F.col("id").alias("doc_id"), F.lit("ab").alias("text"))
    labels = spark.range(0, 200, 3).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = []
        for most, sent in ((1 << 22, True), (10, False)):
            monkeypatch.setattr(quality, "IDS", most)
            t = quality._trusted(docs, labels)
            assert ("BroadcastHashJoin" in t._jdf.queryExecution().executedPlan().toString()) == sent
            found.append(sorted(r.doc_id for r in t.collect()))
        assert found[0] == found[1] == list(range(0, 100, 3))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
