"""Services, addresses on the web, and stores whose documents are replaced."""

import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from folioloom.functions import guards
from folioloom.operators import calls, enrich, search
from folioloom.plans import facade
from folioloom.sinks.store import JobStore, VersionedVectorStore
from folioloom.sources import readers, web

# Tasks don't have this folder on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def noted(path, what):
    """Notes a call in a file; tasks append to it one line at a time."""
    with open(path, "a", encoding="utf-8") as f:
        f.write(what + "\n")


def embedder(log, bad=(), width=3, flaky=0):
    """A service that notes each client and each call; texts in ``bad`` fail always, the first ``flaky`` calls of a client once."""

    def make():
        noted(log, "client")
        return {"calls": 0}

    def ask(client, texts):
        client["calls"] += 1
        noted(log, "call " + "|".join(texts))
        assert len(texts) <= 4
        if client["calls"] <= flaky or any(t in bad for t in texts):
            raise RuntimeError("no")
        return [[float(len(t))] * width for t in texts]

    return calls.Service(make=make, ask=ask, answer="array<double>", batch=4, tries=2, wait=0.0, lanes=2, name="embedder")


def lines(log):
    try:
        with open(log, encoding="utf-8") as f:
            return f.read().split("\n")[:-1]
    except FileNotFoundError:
        return []


def test_distinct_texts_are_sent_once_in_batches(spark, tmp_path):
    log = str(tmp_path / "log")
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(["same"] * 50 + [f"t{k}" for k in range(20)] + [None, "", "poison"])], "k int, page_content string")
    done, failed = search.embed_remote(rows, embedder(log, bad=("poison",)))
    assert {(r.k, r.vector[0]) for r in done.collect()} == {(r.k, float(len(r.page_content))) for r in rows.collect() if r.page_content not in (None, "poison")}
    assert {(r.page_content, r.error) for r in failed.collect()} == {(None, None), ("poison", "RuntimeError: no")}
    said = lines(log)
    assert said.count("client") <= 2
    sent = [t for x in said if x.startswith("call ") for t in x[5:].split("|")]
    assert {t for t in sent if sent.count(t) == 1} >= {t for t in ["same", *(f"t{k}" for k in range(20))] if not any("poison" in x and t in x[5:].split("|") for x in said)}
    assert all(len(x[5:].split("|")) <= 4 for x in said if x.startswith("call "))


def test_retries_memo_and_lengths(spark, tmp_path):
    log = str(tmp_path / "log")
    rows = spark.createDataFrame([("a",), ("bb",), ("ccc",)], "page_content string")
    service = embedder(log, flaky=1)
    memo = calls.memo(spark, str(tmp_path / "memo"), service)
    assert search.embed_remote(rows, service, memo)[1].count() == 0
    n = len(lines(log))
    more = rows.unionByName(spark.createDataFrame([("dddd",)], "page_content string"))
    assert search.embed_remote(more, embedder(log), memo)[0].count() == 4
    assert lines(log)[n:] == ["client", "call dddd"]
    n = len(lines(log))
    assert search.embed_remote(more, embedder(log), memo)[0].count() == 4 and len(lines(log)) == n
    with pytest.raises(ValueError, match="components"):
        search.embed_remote(spark.createDataFrame([("new",), ("a",)], "page_content string"), embedder(log, width=5), memo)
    # What failed isn't remembered.
    bad = spark.createDataFrame([("x",)], "page_content string")
    assert search.embed_remote(bad, embedder(log, bad=("x",)), memo)[1].count() == 1
    assert search.embed_remote(bad, embedder(log), memo)[0].count() == 1


def test_answers_that_are_no_answers(spark):
    rows = spark.createDataFrame([("a",), ("b",)], "t string")
    few = calls.Service(make=dict, ask=lambda c, x: x[1:], answer="string", wait=0.0)
    assert {r.error for r in calls.answered(rows, few).collect()} == {"ValueError: 0 answers to 1 payloads"}
    none = calls.Service(make=dict, ask=lambda c, x: [None] * len(x), answer="string", wait=0.0)
    assert {r.error for r in calls.answered(rows, none).collect()} == {"no answer"}
    broken = calls.Service(make=lambda: 1 / 0, ask=lambda c, x: x, answer="string", wait=0.0)
    assert {r.error for r in calls.answered(rows, broken).collect()} == {"ZeroDivisionError: division by zero"}
    assert calls.answered(rows.limit(0), few).collect() == []


def test_ingest_replaces_documents(spark, tmp_path):
    store = VersionedVectorStore(spark, str(tmp_path / "kb"), buckets=4)
    docs = lambda *rows: readers.text_elements(spark.createDataFrame(list(rows), "doc_id string, text string"))
    assert facade.ingest(docs(("d1", "alpha beta"), ("d2", "gamma delta")), store, "kb") == (2, 2)
    facade.ingest(docs(("d1", "alpha beta"), ("d2", "gamma delta")), store, "kb")
    assert store.read("kb").count() == 2
    facade.ingest(docs(("d1", "entirely new")), store, "kb")
    assert sorted(r.page_content for r in store.read("kb").collect()) == ["entirely new", "gamma delta"]
    assert sorted(r.page_content for r in store.read("kb", 1).collect()) == ["alpha beta", "gamma delta"]
    # A document of which nothing is left after cleaning.
    facade.ingest(docs(("d1", "!")), store, "kb")
    assert [r.page_content for r in store.read("kb").collect()] == ["gamma delta"]
    assert facade.search(store, "kb", "gamma delta", 1).first().page_content == "gamma delta"
    log = str(tmp_path / "log")
    service = embedder(log, bad=("will fail",))
    with pytest.raises(RuntimeError, match="has not embedded 1 chunks"):
        facade.ingest(docs(("d3", "will fail"), ("d4", "goes well")), VersionedVectorStore(spark, str(tmp_path / "r")), "kb", engine=service)
    other = VersionedVectorStore(spark, str(tmp_path / "r"), buckets=2)
    assert other.read("kb").count() == 0
    facade.ingest(docs(("d3", "will fail"), ("d4", "goes well")), other, "kb", engine=service, failures=str(tmp_path / "failures"))
    assert [r.page_content for r in other.read("kb").collect()] == ["goes well"]
    assert [(r.doc_id, r.error) for r in spark.read.parquet(str(tmp_path / "failures")).collect()] == [("d3", "RuntimeError: no")]
    assert round(facade.search(other, "kb", "goes well", 1, engine=service).first().score, 6) == 1.0
    with pytest.raises(RuntimeError, match="the query"):
        facade.search(other, "kb", "will fail", 1, engine=service)


def test_job_store(spark, tmp_path):
    store = JobStore(spark, str(tmp_path / "jobs"), 4)
    put = lambda *rows: store.put(spark.createDataFrame(list(rows), "id string, status string, finished_at double, seq long"))
    put(("a", "queued", None, 1), ("b", "queued", None, 1))
    put(("a", "succeeded", 10.0, 3), ("a", "running", None, 2))
    put(("b", "failed", 95.0, 2))
    assert store.get("a")["status"] == "succeeded" and store.get("b")["finished_at"] == 95.0 and store.get("c") is None
    assert store.sweep(100.0, 50.0) is not None and [r.id for r in store.jobs().collect()] == ["b"]
    assert store.sweep(100.0, 50.0) is None


def test_pictures_are_described_once(spark, tmp_path):
    log = str(tmp_path / "log")

    def ask(_, pictures):
        for x in pictures:
            noted(log, bytes(x).decode())
        return [f"shows {bytes(x).decode()}" for x in pictures]

    service = calls.Service(make=dict, ask=ask, answer="string", wait=0.0)
    images = spark.createDataFrame([(1, "image", "old", "a.png", None), (2, "image", "old", "b.png", '{"src": "copy.png"}'), (3, "image", "old", "gone.png", None), (4, "text", "old", "a.png", None)], "k int, type string, content string, file_name string, metadata string")
    contents = spark.createDataFrame([("a.png", b"cat"), ("copy.png", b"cat"), ("unused.png", b"dog")], "path string, content binary")
    memo = calls.memo(spark, str(tmp_path / "memo"), service)
    for _ in range(2):
        got = {r.k: (r.content, r.caption_generated, r.caption_error) for r in enrich.caption_images(images, contents, service, memo).collect()}
        assert got == {1: ("shows cat", True, None), 2: ("shows cat", True, None), 3: ("old", False, "no file gone.png"), 4: ("old", None, None)}
    assert lines(log) == ["cat"]


def test_text_in_pictures(spark, tmp_path):
    def ask(_, pictures):
        if any(x == b"blank" for x in pictures):
            raise ValueError("nothing there")
        return [{"width": 100, "height": 200, "lines": [{"text": "one", "confidence": 0.9, "corners": [[10.0, 20.0], [60.0, 20.0], [60.0, 40.0], [-5.0, 40.0]]}, {"text": "two", "confidence": 0.5, "corners": [[0.0, 100.0], [100.0, 220.0]]}]} for _ in pictures]

    service = calls.Service(make=dict, ask=ask, answer=enrich.LINES, wait=0.0)
    pages = spark.createDataFrame([("d", 1, b"page"), ("d", 2, b"page"), ("d", 3, b"blank"), ("d", 4, None)], "doc_id string, page_number int, content binary")
    found, failed = enrich.recognise(pages, service, calls.memo(spark, str(tmp_path / "memo"), service))
    got = sorted((r.page_number, r.line, r.content, r.bbox) for r in found.collect())
    assert got == [(p, k, t, b) for p in (1, 2) for k, t, b in ((0, "one", [0.0, 0.1, 0.6, 0.2]), (1, "two", [0.0, 0.5, 1.0, 1.0]))]
    assert {r.page_number: r.error for r in failed.collect()} == {3: "ValueError: nothing there", 4: "no picture"}


def test_addresses():
    for bad in ("10.0.0.1", "127.0.0.1", "169.254.169.254", "100.64.0.1", "0.0.0.0", "224.0.0.1", "255.255.255.255", "::1", "::", "fe80::1%eth0", "fd00::1", "::ffff:10.0.0.1", "::ffff:7f00:1", "2002:7f00:1::", "64:ff9b::7f00:1", "ff02::1"):
        assert not web.is_public(bad), bad
    assert web.is_public("93.184.216.34") and web.is_public("2606:2800:220:1:248:1893:25c8:1946") and web.is_public("64:ff9b::5db8:d822")
    assert [web.literal(h) for h in ("2130706433", "127.1", "0x7f.1", "0177.0.0.1", "example.org", "1e.org", "93.184.216.34")] == ["127.0.0.1"] * 4 + [None, None, "93.184.216.34"]


def test_written_addresses(spark):
    hosts = ["10.0.0.1", "[::ffff:10.0.0.1]", "[::ffff:a00:1]", "[0:0:0:0:0:ffff:a00:1]", "2130706433", "127.1", "0x7f000001", "0177.0.0.1", "[2002:7f00:1::]", "[::1]", "localhost"]
    good = ["93.184.216.34", "example.org", "127.example.org", "0x.example.org", "[2606:2800:220:1::1946]", "1.2.3.4.example"]
    df = spark.createDataFrame([(f"http://{h}/x",) for h in hosts + good], "u string")
    assert [r[0] for r in df.select(guards.is_public_url(F.col("u"))).collect()] == [False] * len(hosts) + [True] * len(good)


PAGES = {
    "http://a.org/1": web.Response(200, b"one"),
    "http://a.org/2": web.Response(301, location="/1"),
    "http://b.org/3": web.Response(307, location="http://a.org/2"),
    "http://b.org/in": web.Response(302, location="http://[::ffff:10.0.0.1]/secret"),
    "http://b.org/dec": web.Response(302, location="http://167772161/secret"),
    "http://b.org/name": web.Response(302, location="https://intern.org/secret"),
    "http://c.org/round": web.Response(302, location="http://c.org/back"),
    "http://c.org/back": web.Response(302, location="http://c.org/round"),
    "http://c.org/lost": web.Response(404),
    "http://c.org/odd": web.Response(302),
    "http://c.org/doc.txt": web.Response(200, b"first line\nsecond line"),
}


def test_rounds_of_redirects(spark, tmp_path):
    log = str(tmp_path / "log")

    def make():
        def resolve(host):
            if host == "unknown.org":
                raise OSError("no such host")
            return {"intern.org": ["93.184.216.34", "192.168.0.9"], "nowhere.org": []}.get(host, ["93.184.216.34"])

        def fetch(url, address):
            assert web.is_public(address)
            noted(log, url)
            return PAGES[url]

        return resolve, fetch

    urls = [*PAGES, "http://a.org/1", "http://unknown.org/", "http://nowhere.org/", "ftp://a.org/1", "file:///etc/passwd", "http://127.1/", "http://user@10.0.0.1/", "http://intern.org/", None]
    got = web.fetch(spark.createDataFrame([(u,) for u in urls], "url string"), make, hops=4).collect()
    assert sorted(r.url or "" for r in got) == sorted(u or "" for u in urls)
    by = {r.url: r for r in got}
    for u in ("http://a.org/1", "http://a.org/2", "http://b.org/3"):
        assert bytes(by[u].content) == b"one" and by[u].final == "http://a.org/1" and by[u].error is None
    for u in ("http://b.org/in", "http://b.org/dec", "http://b.org/name", "http://127.1/", "http://user@10.0.0.1/", "http://intern.org/"):
        assert "refused" in by[u].error and by[u].content is None
    assert "more than 4 redirects" in by["http://c.org/round"].error and "status 404" in by["http://c.org/lost"].error and "without a place" in by["http://c.org/odd"].error
    assert "only http" in by["ftp://a.org/1"].error and "only http" in by["file:///etc/passwd"].error and by[None].error and "no such host" in by["http://unknown.org/"].error and "no address" in by["http://nowhere.org/"].error
    said = lines(log)
    assert len(said) == len(set(said)) and not any("secret" in x for x in said)
    found, failed = readers.load_batch(spark, "http://c.org/doc.txt", web_tools=make)
    assert [r.content for r in found.orderBy("element_idx").collect()] == ["first line", "second line"] and failed.count() == 0
    assert web.fetch(spark.createDataFrame([], "url string"), make).collect() == []
    named = web.files(spark.createDataFrame([("http://a.org/x%20y.TXT?q=1", b""), ("http://a.org/", b""), ("http://a.org/pic", b"")], "url string, content binary").withColumn("error", F.lit(None).cast("string"))).collect()
    assert [(r.name, r.kind) for r in named] == [("x y.TXT", "txt"), ("downloaded_file", "image"), ("pic", "image")]
