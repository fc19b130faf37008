import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioloom.operators import chunk, clean, dedup, enrich, evaluate, export, jobs, search
from folioloom.plans.queries import rows_of
from folioloom.schema import location


def elements(spark, rows, schema="doc_id string, i int, type string, content string, level int", **loc):
    df = spark.createDataFrame(rows, schema)
    place = location(**{k: F.expr(v) for k, v in loc.items()}) if loc else None
    return rows_of(df, F.col("doc_id"), F.col("i"), F.col("type"), F.col("content"), F.col("level"), place)


def test_default_clean(spark):
    rows = [("d", 0, "text", "电话13912349999\x00", None), ("d", 1, "text", "..", None), ("d", 2, "text", "  有效   内容 ", None)]
    got = clean.clean(elements(spark, rows)).orderBy("element_idx").collect()
    assert [r.content for r in got] == ["电话139****9999", "有效 内容"]


def test_length_filter(spark):
    rows = [("d", k, t, c, None) for k, (t, c) in enumerate([("text", "a"), ("text", "..."), ("text", "正常有效文本"), ("code", "x"), ("hr", "---"), ("text", None)])]
    assert [r.element_idx for r in clean.drop_short(elements(spark, rows)).orderBy("element_idx").collect()] == [2, 3, 4]


def test_margins(spark):
    rows = []
    for page in (1, 2, 3):
        rows += [("d", 10 * page, "text", "Annual Report", page, 0.08), ("d", 10 * page + 1, "text", f"chapter {'abc'[page - 1]}", page, 0.1), ("d", 10 * page + 2, "text", f"第 {page} 页", page, 0.93)]
    rows += [("d", 99, "text", "Annual  report", None, 0.05), ("e", 0, "text", "Annual Report", 1, 0.05), ("e", 1, "text", "annual report", 1, 0.06)]
    df = elements(spark, [(a, b, c, d, None, e, f) for a, b, c, d, e, f in rows], "doc_id string, i int, type string, content string, level int, page int, y double", page_number="page", bbox="array(0.1D, y, 0.9D, y + 0.01)")
    got = {(r.doc_id, r.element_idx) for r in dedup.drop_margins(df, share=0.3).collect()}
    assert got == {("d", 11), ("d", 21), ("d", 31), ("e", 0), ("e", 1)}


def plain_fingerprint(norm):
    pairs = [norm] if len(norm) <= 3 else [norm[i : i + 2] for i in range(len(norm) - 1)]
    hashes = [int(hashlib.md5(p.encode()).hexdigest()[:16], 16) for p in pairs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_agree(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice("abc中文字 ") for _ in range(rng.randrange(1, 30))) for _ in range(60)]
    df = spark.createDataFrame([("d", k, t) for k, t in enumerate(texts)], "doc_id string, element_idx int, content string")
    want = {k: f"{plain_fingerprint(''.join(t.split())):016x}" for k, t in enumerate(texts) if t.strip()}
    assert {r.element_idx: r.fingerprint for r in dedup.fingerprint_rows(df).collect()} == want
    assert {r.element_idx: r.f for r in df.select("element_idx", dedup.fingerprint(F.col("content")).alias("f")).collect() if r.element_idx in want} == want
    assert {k: f"{int(dedup._Pairs().fingerprint(''.join(t.split()))):016x}" for k, t in enumerate(texts) if t.strip()} == want


def test_near_duplicates_are_greedy(spark):
    rng = random.Random(4)
    base = ["".join(rng.choice("abcdefgh ") for _ in range(60)) for _ in range(6)]
    texts = []
    for _ in range(80):
        t = list(rng.choice(base))
        for _ in range(rng.randrange(6)):
            t[rng.randrange(len(t))] = rng.choice("xyz")
        texts.append("".join(t))
    texts += ["ab", "A B", "abc"]
    df = elements(spark, [("d", k, "text", t, None) for k, t in enumerate(texts)])
    for most in (3, 10, 20):
        kept, hashes, seen = [], [], set()
        for k, t in enumerate(texts):
            norm = "".join(t.lower().split())
            if not norm or norm in seen:
                continue
            if len(norm) >= 6:
                h = plain_fingerprint(norm)
                if any((h ^ x).bit_count() <= most for x in hashes):
                    continue
                hashes.append(h)
            seen.add(norm)
            kept.append(k)
        assert sorted(r.element_idx for r in dedup.drop_near_duplicates(df, most).collect()) == kept


def test_long_documents_are_settled_in_rounds(spark, monkeypatch):
    """Heads and parts of a few prints keep what one pass over the whole document keeps."""
    rng = random.Random(4)
    base = ["".join(rng.choice("abcdefghij ") for _ in range(40)) for _ in range(25)]

    def near(x):
        cut = rng.randrange(len(x) - 1)
        return x[:cut] + rng.choice("abcdefghij") + x[cut + 1 :] if rng.random() < 0.8 else x

    rows = [(d, k * rng.choice((1, 3)) + 1000 * k, rng.choice([near(rng.choice(base)), near(rng.choice(base)), "abc", "", "  ", "".join(rng.choice("abcdefghij") for _ in range(30))])) for d, n in (("a", 400), ("b", 60), ("c", 3)) for k in range(n)]
    df = spark.createDataFrame(rows, "doc_id string, element_idx int, content string")
    want = set()
    for d in ("a", "b", "c"):
        kept, seen = [], set()
        for _, i, text_ in sorted(r for r in rows if r[0] == d):
            norm = "".join(text_.split()).lower()
            if not norm or norm in seen:
                continue
            if len(norm) >= 6:
                f = int(dedup._Pairs().fingerprint(norm))
                if any((f ^ g).bit_count() <= 10 for g in kept):
                    continue
                kept.append(f)
            seen.add(norm)
            want.add((d, i))
    assert {(r.doc_id, r.element_idx) for r in dedup.drop_near_duplicates(df).collect()} == want
    monkeypatch.setattr(dedup, "BUCKET", 20_000)
    monkeypatch.setattr(dedup, "HEAD", 50)
    monkeypatch.setattr(dedup, "PART", 70_000)
    assert {(r.doc_id, r.element_idx) for r in dedup.drop_near_duplicates(df).collect()} == want
    assert len(want) < len(rows)


def test_heading_stack(spark):
    rng = random.Random(6)
    rows = [("d%d" % (k // 40), k % 40, *(("heading", f" h{k} ", rng.randrange(1, 5)) if rng.random() < 0.5 else ("text", f"t{k}", None))) for k in range(400)]
    got = {(r.doc_id, r.element_idx): r.header_path for r in enrich.with_heading_path(elements(spark, rows)).collect()}
    stack = {}
    for doc, i, kind, content, level in rows:
        if i == 0:
            stack = {}
        if kind == "heading":
            stack = {k: v for k, v in stack.items() if k < level} | {level: content.strip()}
        assert got[doc, i] == (" > ".join(stack[k] for k in sorted(stack)) or "正文全局")


def test_context_and_tables(spark):
    rows = [("d", 0, "heading", "第三章", 1), ("d", 1, "text", "表 3-1: 2026年度部门研发预算分配表", None), ("d", 2, "table", "| 部门 | 2026预算(万) | 负责人 |\n|---|---|---|\n| 研发 | 1200 | 张 |\n| 市场 | 800 | 李 |", None)]
    got = enrich.enrich_tables(elements(spark, rows)).where("type = 'table'").first()
    assert got.table_caption == "表 3-1: 2026年度部门研发预算分配表"
    assert len(got.kv_pairs) == 2 and got.kv_pairs[0]["2026预算(万)"] == "1200"
    assert got.content.startswith("【表格: 表 3-1: 2026年度部门研发预算分配表】\n| 部门")
    body = enrich.enrich_context(elements(spark, rows)).where("element_idx = 1").first()
    assert body.content.startswith("【文档: doc-d | 上下文: 第三章】\n表 3-1")


def plain_spans(n, size, overlap):
    out, batch, held = [], [], 0
    for i, x in enumerate(n):
        if x >= size:
            out += [batch] if batch else []
            out.append([i])
            batch, held = [], 0
        elif held + x <= size:
            batch, held = [*batch, i], held + x
        else:
            out += [batch] if batch else []
            kept, total = [], 0
            for j in reversed(batch):
                if total + n[j] > overlap:
                    break
                kept, total = [j, *kept], total + n[j]
            batch, held = [*kept, i], total + x
    return [(b[0], b[-1]) for b in [*out, *([batch] if batch else [])]]


def test_sliding_spans():
    assert chunk.spans(np.array([300, 300, 40, 600, 10, 500]), 512, 0) == [(0, 0), (1, 2), (3, 3), (4, 5)]
    rng = random.Random(9)
    for _ in range(500):
        n = [rng.choice([0, 5, 20, 60, 64, 100, 300, 511, 512, 700]) for _ in range(rng.randrange(1, 30))]
        assert chunk.spans(np.array(n), 512, 64) == plain_spans(n, 512, 64)


SECTIONS = [("d", 0, "heading", "第一章 系统架构总览", 1), ("d", 1, "text", "引言", None), ("d", 2, "heading", "1.1 模块拆分", 2), ("d", 3, "text", "细节", None), ("d", 4, "code", "x = 1", None), ("d", 5, "table", "| a |", None)]


def test_header_aware(spark):
    got = chunk.header_aware(elements(spark, SECTIONS)).orderBy("chunk_idx").collect()
    assert [r.header_path for r in got] == ["第一章 系统架构总览", "第一章 系统架构总览 > 1.1 模块拆分"]
    assert got[1].page_content == "1.1 模块拆分\n\n细节\n\nx = 1\n\n| a |" and got[1].elements_count == 4 and got[1].location.end_line == 6
    lead = chunk.header_aware(elements(spark, [("d", 0, "text", "before", None), *[(d, i + 1, t, c, v) for d, i, t, c, v in SECTIONS]])).orderBy("chunk_idx").collect()
    assert [r.chunk_idx for r in lead] == [0, 1, 2] and lead[0].header_path == "root"


def test_parent_child_and_auto(spark):
    rows = [("d", k, "text", f"{k} " + "word " * 20, None) for k in range(40)]
    children, parents = chunk.parent_child(elements(spark, rows), 300, 80, 16)
    ids = {r.parent_id: r.parent_text for r in parents.collect()}
    got = children.orderBy("chunk_idx").collect()
    assert got and all(r.page_content in ids[r.parent_id] for r in got) and [r.chunk_idx for r in got] == list(range(len(got)))
    assert chunk.route(elements(spark, SECTIONS)).first().strategy == "header_aware"
    assert chunk.route(elements(spark, rows)).first().strategy == "parent_child"
    assert chunk.route(elements(spark, rows[:3])).first().strategy == "sliding_window"
    assert chunk.chunk(elements(spark, rows[:3]), "no such strategy")[0].first().chunk_type == "sliding_window"


def test_chunk_stats(spark):
    df = spark.createDataFrame([("a😀", "h"), ("abcd", None), ("", "")], "page_content string, header_path string")
    assert chunk.stats(df).first().asDict() == {"total": 3, "avg_length": 2, "max_length": 4, "header_path_ratio": 33}
    assert chunk.stats(df.where("false")).first().asDict() == {"total": 0, "avg_length": 0, "max_length": 0, "header_path_ratio": 0}


def test_search(spark):
    store = spark.createDataFrame([(k, [float(k), 1.0]) for k in range(20)] + [(99, [0.0, 0.0]), (98, None)], "chunk_id int, vector array<double>")
    query = [1.0, 0.0]
    fast = [(r.chunk_id, round(r.score, 9)) for r in search.top_k(store, query, 5).collect()]
    slow = [(r.chunk_id, round(r.score, 9)) for r in search.top_k(store.where("vector is not null"), F.array(F.lit(1.0), F.lit(0.0)), 5).collect()]
    assert fast == slow == [(k, round(k / (k * k + 1) ** 0.5, 9)) for k in (19, 18, 17, 16, 15)]
    with pytest.raises(ValueError):
        search.engine("no such engine")
    for bad in (("", 4), ("q", 0), ("q", 101)):
        with pytest.raises(ValueError):
            search.check_request(*bad)


def test_evaluation(spark):
    spans = spark.createDataFrame([("q", 0, 1, 5), ("q", 1, 20, 30), ("p", 0, 7, 7)], "qid string, span_idx int, start_line int, end_line int")
    results = spark.createDataFrame([("s", "q", 1, 8, 9), ("s", "q", 2, 5, None), ("s", "q", 3, None, 4), ("s", "p", 1, 1, 2)], "strategy string, qid string, rank int, start_line int, end_line int")
    got = {r.qid: r for r in evaluate.score(results, spans).collect()}
    q, p = got["q"], got["p"]
    assert (q.hit, q.first_hit_rank, q.reciprocal_rank, round(q.noise, 6), q.spans_total, q.spans_covered) == (True, 2, 0.5, 0.666667, 2, 1)
    assert (p.hit, p.first_hit_rank, p.reciprocal_rank, p.noise) == (False, None, 0.0, 1.0)
    m = evaluate.metrics(evaluate.score(results, spans), "strategy").first()
    assert (m.hit_at_k, round(m.recall, 6), m.mrr) == (0.5, 0.333333, 0.25)


def test_coverage_by_sweep(spark):
    rng = random.Random(6)
    long = 1_000_000
    edge = lambda: rng.choice([rng.randrange(400), rng.choice([0, 127, 128, 129, 255, 256]), rng.randrange(long)])
    chunks = [(rng.choice("de"), rng.choice("xyz"), edge(), rng.choice([None, edge(), edge()])) for _ in range(60)] + [("d", "x", None, 5), ("d", "w", 900_000, 10)]
    spans = [(rng.choice("def"), f"q{k % 25}", k // 25, *((lambda a: (a, a + rng.choice([0, 1, 128, 999_000])))(edge()) if k % 9 else (edge(), 0))) for k in range(100)]
    c = spark.createDataFrame(chunks, "doc_id string, strategy string, start_line int, end_line int")
    s = spark.createDataFrame(spans, "doc_id string, qid string, span_idx int, start_line int, end_line int")
    for by_document in (True, False):
        want = {}
        for qid in {x[1] for x in spans}:
            mine = [x for x in spans if x[1] == qid]
            for strategy in "wxyz":
                found = {i for d, _, i, a, z in mine if a <= z for cd, cs, b, e in chunks if cs == strategy and (cd == d or not by_document) and b is not None and b <= (e if e is not None else b) and b <= z and a <= (e if e is not None else b)}
                want[qid, strategy] = (len({x[2] for x in mine}), len(found))
        got = evaluate.coverage(c, s) if by_document else evaluate.coverage(c.drop("doc_id"), s.drop("doc_id"))
        assert {(r.qid, r.strategy): (r.total, r.covered) for r in got.collect()} == want
    plan = evaluate.coverage(c, s)._jdf.queryExecution().toString()
    assert "sequence(" not in plan


def test_jobs(spark):
    log = spark.createDataFrame([("a", "queued", 1.0, None), ("a", "running", 2.0, None), ("a", "succeeded", 3.0, 3.0), ("b", "queued", 1.0, None), ("b", "succeeded", 2.0, 2.0), ("c", "running", 1.0, None)], "id string, status string, at double, finished_at double")
    assert {(r.id, r.status) for r in jobs.violations(log).collect()} == {("b", "succeeded"), ("c", "running")}
    last = jobs.latest(log)
    assert {(r.id, r.status) for r in last.collect()} == {("a", "succeeded"), ("b", "succeeded"), ("c", "running")}
    assert {r.id for r in jobs.swept(last, 3.06, 0.05).collect()} == {"c"}


def test_export_round_trip(spark):
    df = elements(spark, SECTIONS)
    back = export.from_documents(export.to_documents(df))
    assert sorted(map(str, back.select("element_idx", "content", "level", "location.start_line").collect())) == sorted(map(str, df.select("element_idx", "content", "level", "location.start_line").collect()))
    row = export.flat_rows(df.withColumn("metadata", F.lit('{"start_line": "own", "x": 1}'))).where("element_idx = 0").first()
    assert row.metadata["start_line"] == "own" and row.metadata["x"] == "1" and row.metadata["level"] == "1" and row.metadata["element_type"] == "heading"


def test_images(spark):
    rows = [("d", 0, "image", "alt", None), ("d", 1, "text", "t", None)]
    df = elements(spark, rows).withColumn("metadata", F.when(F.col("type") == "image", F.lit('{"src": "a/b.png"}')))
    got = enrich.describe_images(df, enrich.stand_in_description).orderBy("element_idx").collect()
    assert got[0].content == "[stand-in description] b.png" and got[0].caption_generated and got[1].content == "t" and got[1].caption_generated is None
