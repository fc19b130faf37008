"""Every operator against a plain brute-force form, over nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import base64
import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioloom.llm import bpe, decontaminate, embeddup, htmltext, ngramjoin, pitmanyor, quality, sharding, textscan, toxicity, warc
from folioloom.llm.common import Scratch, components

DOCS = "doc_id long, text string, lang string, source string, n_chars long, n long, key string, contaminated boolean, words int"
rng = random.Random(11)
WORDS = ["alpha", "Beta", "gamma", "DELTA", "épsilon", "zeta", "eta", "Ünit", "1st", "x", "y,z", "o'k", "中文", "the", "of"]


def sentence(n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def frame(spark, texts, ids=None, lang="en"):
    """Documents with columns whose names the operators use within."""
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, lang, None, None, 5, "k", None, 1) for i, t in zip(ids, texts, strict=True)], DOCS)


def odd_texts():
    base = sentence(60)
    return [None, "", "   ", "one", "one two", base, base, base.upper(), base + " tail", " ".join(base.split()[:-1]), sentence(3), sentence(12), sentence(1500), "\x00� ", "!!! ... ???", base.replace(" ", "\n\t")]


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def word_list(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))


def token_list(text):
    return re.findall(r"[^\x20\x09-\x0D]+", lowered(text))


@pytest.fixture()
def odd(spark):
    texts = odd_texts()
    return frame(spark, texts + [texts[5]], [*range(len(texts) - 1), None, 5]), texts


def test_scan_is_the_pattern():
    import pyarrow as pa

    texts = odd_texts() + ["".join(rng.choice("aZé 9-\n中\t") for _ in range(rng.randrange(40))) for _ in range(200)]
    for table, plain in ((textscan.ALNUM, word_list), (textscan.NONSPACE, token_list)):
        w = textscan.scan(pa.array(texts, pa.string()), table)
        for k, t in enumerate(texts):
            assert [w.text(i) for i in range(w.first[k], w.first[k + 1])] == plain(t)
        assert (w.hashes == textscan.hash_words([w.text(i) for i in range(len(w.hashes))])).all()


# ---- 1 --------------------------------------------------------------------------------------------------------------


def plain_contamination(texts, items, window=10):
    out = []
    for t in texts:
        words, hit, found = word_list(t), set(), set()
        for item_id, item in items:
            w = word_list(item)
            n = min(window, len(w))
            for j in range(len(w) - n + 1 if n else 0):
                for i in range(len(words) - n + 1):
                    if words[i : i + n] == w[j : j + n]:
                        hit.update(range(i, i + n))
                        found.add("null" if item_id is None else str(item_id))
        listed = ",".join(sorted(found))
        out.append((len(words), len(hit), len(found), hashlib.sha256(listed.encode()).hexdigest(), bool(hit)))
    return out


@pytest.mark.parametrize("window", [1, 3, 10])
def test_contamination(spark, window):
    texts = odd_texts()
    items = [(7, " ".join(word_list(texts[5])[3:20])), (11, "One!"), (2, "zeta Eta"), (3, None), (4, ""), (None, " ".join(word_list(texts[12])[100:140])), (7, sentence(30)), (9, texts[12])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contamination(frame(spark, texts), bench, window).orderBy("doc_id").collect()
    assert [tuple(r)[1:] for r in got] == plain_contamination(texts, items, window)
    kept = decontaminate.decontaminate(frame(spark, texts), bench, window)
    assert kept.schema == frame(spark, texts).schema
    assert sorted(r.doc_id for r in kept.collect()) == [k for k, r in enumerate(got) if not r.contaminated]


def test_contamination_in_blocks_and_empty(spark, odd):
    docs, texts = odd
    items = [(k, sentence(20)) for k in range(40)] + [(50, texts[5])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    one = sorted(map(str, decontaminate.contamination(docs, bench).collect()))
    assert len(list(decontaminate.blocks(bench, 10, 500))) > 3 and docs.count() == len(one)
    assert sorted(map(str, decontaminate.contamination(docs, bench, block_bytes=500).collect())) == one
    want = sorted(map(str, decontaminate.longest_matches(docs, bench).collect()))
    assert want and sorted(map(str, decontaminate.longest_matches(docs, bench, block_bytes=500).collect())) == want
    assert sorted(map(str, decontaminate.decontaminate(docs, bench, block_bytes=500).collect())) == sorted(map(str, decontaminate.decontaminate(docs, bench).collect()))
    empty = bench.where("false")
    assert all(not r.contaminated and r.n_items == 0 for r in decontaminate.contamination(docs, empty).collect())
    assert decontaminate.contamination(docs.where("false"), bench).count() == 0
    assert decontaminate.decontaminate(docs, empty).count() == docs.count()


def test_contamination_of_repeated_rows_in_blocks(spark):
    """Rows without an id and of one text, more than one block: each row once, with the spans of one."""
    text = sentence(40)
    items = [(k, sentence(20)) for k in range(30)] + [(77, text), (78, " ".join(word_list(text)[5:30]))]
    docs = spark.range(600).select(F.lit(None).cast("long").alias("doc_id"), F.lit(text).alias("text"))
    got = decontaminate.contamination(docs, spark.createDataFrame(items, "item_id long, text string"), block_bytes=500).collect()
    assert len(got) == 600 and {tuple(r)[1:] for r in got} == {*plain_contamination([text], items)}


@pytest.mark.parametrize("odd_word", [None, "gap"])
def test_long_matches_take_linear_time(odd_word):
    import time

    import pyarrow as pa

    words = [f"w{k * k % 9973}x{k % 89}" for k in range(64_000)]
    block = decontaminate.Block(["a"], [" ".join(words)])
    there = words[:]
    if odd_word:
        there[32_000] = odd_word
    shard = textscan.scan(pa.array(["before " + " ".join(there) + " after"] * 2, pa.string()), textscan.ALNUM)
    start = time.process_time()
    _, place, _, inside, length = decontaminate.matches(shard, block)
    assert time.process_time() - start < 8  # a square would take minutes
    longest = sorted(zip(place.tolist(), inside.tolist(), length.tolist(), strict=True), key=lambda x: -x[2])
    want = [(1, 0, 64_000)] * 2 if not odd_word else [(1, 0, 32_000)] * 2 + [(32_002, 32_001, 31_999)] * 2
    assert longest[: len(want)] == want


def test_matches_of_one_word_over_and_over():
    import pyarrow as pa

    block = decontaminate.Block(["a"], ["ha " * 500])
    shard = textscan.scan(pa.array(["ha " * 3000, "ha " * 9], pa.string()), textscan.ALNUM)
    doc, place, _, inside, length = decontaminate.matches(shard, block)
    assert not doc.any() and len(place) == 2991 + 490 and length.max() == 500
    assert (length == np.minimum(500 - inside, 3000 - place)).all() and (np.minimum(place, inside) == 0).all()


def plain_matches(texts, items, window):
    out = []
    for d, t in enumerate(texts):
        words = word_list(t)
        for item_id, item in items:
            w = word_list(item)
            for i in range(len(words)):
                for j in range(len(w)):
                    n = 0
                    while i + n < len(words) and j + n < len(w) and words[i + n] == w[j + n]:
                        n += 1
                    if n >= min(window, len(w)) and not (i and j and words[i - 1] == w[j - 1]):
                        out.append((d, str(item_id), i, j, n))
    return sorted(out)


@pytest.mark.parametrize("window", [2, 4, 10])
def test_longest_matches_like_plain(spark, window):
    made = random.Random(7)
    text = lambda n: " ".join(made.choice("abc") for _ in range(n))
    texts = [text(made.randrange(60)) for _ in range(12)] + [text(30) + " q " + text(20), None, ""]
    items = [(k, text(made.randrange(25))) for k in range(5)] + [(9, texts[3]), (9, "a"), (10, None)]
    got = decontaminate.longest_matches(frame(spark, texts), spark.createDataFrame(items, "item_id long, text string"), window).collect()
    assert sorted(tuple(r) for r in got) == plain_matches(texts, items, window)


def twins(n):
    """Two different words of 2**n letters that polynomial hashes modulo 2**64 take for equal."""
    out, other = "a", "b"
    for _ in range(n):
        out, other = out + other, other + out
    return out, other


@pytest.mark.parametrize("n", [10, 13])
def test_words_that_polynomials_confuse(spark, n):
    a, b = twins(n)
    assert len(set(textscan.hash_words([a, b, a + b, b + a]))) == 4
    docs = frame(spark, [f"one {a} two", f"one {b} two", f"one {a} two", f"{a} {b} three"])
    bench = spark.createDataFrame([(1, f"one {a} two")], "item_id long, text string")
    assert {r.doc_id for r in decontaminate.contamination(docs, bench).where("contaminated").collect()} == {0, 2}
    assert {r.doc_id: r.component_id for r in ngramjoin.jaccard_components(docs, 3, 90).collect()} == {0: 0, 1: 1, 2: 0, 3: 3}
    known = {r.doc_id: r.n_known for r in pitmanyor.score(docs, F.col("doc_id") != 0).collect()}
    assert known == {0: 4, 1: 3, 2: 4, 3: 2}


def test_longest_matches(spark):
    item = " ".join(f"w{k}" for k in range(30))
    text = "a b " + " ".join(f"w{k}" for k in range(5, 25)) + " c " + " ".join(f"w{k}" for k in range(12)) + " w12x"
    got = decontaminate.longest_matches(frame(spark, [text, None, ""]), spark.createDataFrame([(3, item)], "item_id long, text string")).collect()
    assert sorted(tuple(r) for r in got) == [(0, "3", 2, 5, 20), (0, "3", 23, 0, 12)]


# ---- 2 --------------------------------------------------------------------------------------------------------------


def plain_components(texts, ids, n, percent):
    sets = []
    for t in texts:
        w = token_list(t)
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    up = list(range(len(texts)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(range(len(texts)), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            up[root(b)] = root(a)
    least = {}
    for k in range(len(texts)):
        if ids[k] is not None:
            least[root(k)] = min(least.get(root(k), ids[k]), ids[k])
    return sorted(((str(ids[k]), len(sets[k]), str(least.get(root(k)))) for k in range(len(texts))))


def near_texts():
    out = odd_texts()
    for _ in range(12):
        words = [f"{rng.choice(WORDS)}{rng.randrange(400)}" for _ in range(rng.choice([8, 40, 120]))]
        out.append(" ".join(words))
        for _ in range(rng.randrange(6)):
            other = words[:]
            for _ in range(rng.randrange(1, 5)):
                other[rng.randrange(len(other))] = rng.choice(WORDS)
            out.append(" ".join(other))
    return out


@pytest.mark.parametrize(("n", "percent", "frequent", "split"), [(3, 90, 1 << 20, 20000), (5, 80, 1 << 20, 20000), (2, 50, 4, 2), (2, 50, 1 << 20, 20000), (3, 90, 0, 20000)])
def test_jaccard(spark, monkeypatch, n, percent, frequent, split):
    monkeypatch.setattr(ngramjoin, "FREQUENT", frequent)
    monkeypatch.setattr(ngramjoin, "LEAST_DF", 2)
    monkeypatch.setattr(ngramjoin, "SPLIT_DF", split)
    rng.seed(5)  # texts in which pivots alone miss links
    texts = near_texts()
    ids = [1000 - 3 * k for k in range(len(texts))]
    ids[6] = None
    got = ngramjoin.jaccard_components(frame(spark, texts, ids).repartition(5), n, percent).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == plain_components(texts, ids, n, percent)


def test_jaccard_of_hot_tokens_only(spark):
    # Workers import the module anew, so SPLIT_DF stays as it is: six passages of 20,100 documents stand alone too, in two variants.
    passages = [" ".join(f"p{k}w{j}" for j in range(12)) for k in range(6)]
    alone = spark.createDataFrame([(2 * k + e, p + " more" * e) for k, p in enumerate(passages) for e in range(2)], "doc_id long, text string")
    own = [F.concat(F.lit(f"d{j}_"), "id") for j in range(12)]
    others = spark.range(100, ngramjoin.SPLIT_DF + 200, 1, 4).select(F.col("id").alias("doc_id"), F.concat_ws(" ", *own, F.lit(" ".join(passages))).alias("text"))
    got = ngramjoin.jaccard_components(alone.union(others), 3, 90)
    assert {r.doc_id: r.component_id for r in got.where("doc_id < 100").collect()} == {k: k - k % 2 for k in range(12)}
    assert got.where("doc_id >= 100 and component_id <> doc_id").count() == 0


def test_jaccard_links_through_rows_without_id(spark):
    words = [f"w{k}" for k in range(100)]
    texts = [" ".join(words[:k] + [f"v{j}" for j in range(k, 100)]) for k in (100, 97, 94, 91)] + ["some other text", "yet another one"]
    ids = [5, None, 3, None, None, 8]  # neighbours link, others don't
    got = ngramjoin.jaccard_components(frame(spark, texts, ids), 3, 90).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == plain_components(texts, ids, 3, 90)
    assert sorted(str(r.component_id) for r in got) == ["3", "3", "3", "3", "8", "None"]


def test_jaccard_of_textual_ids_and_clashing_columns(spark):
    docs = frame(spark, ["a b c d e f", "A b c d e f", "other words in here", None]).withColumn("doc_id", F.concat(F.lit("d"), "doc_id"))
    assert {r.doc_id: r.component_id for r in ngramjoin.jaccard_components(docs, 3, 90).collect()} == {"d0": "d0", "d1": "d0", "d2": "d2", "d3": "d3"}
    docs = docs.withColumns({c: F.lit(1) for c in ("gone", "_gone", "component_id", "n_shingles", "_k1", "s")})
    assert sorted(r.doc_id for r in ngramjoin.keep_one(docs).collect()) == ["d0", "d2", "d3"]


def test_jaccard_in_blocks_of_a_group(spark, monkeypatch):
    monkeypatch.setattr(ngramjoin, "GROUP", 3)
    rng.seed(5)
    texts = near_texts()
    got = ngramjoin.jaccard_components(frame(spark, texts), 2, 50).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == plain_components(texts, range(len(texts)), 2, 50)


def test_jaccard_chains_and_keeps(spark):
    words = [f"w{k}" for k in range(200)]
    texts = [" ".join(words[:k] + [f"v{j}" for j in range(k, 200)]) for k in range(200, 150, -2)]  # neighbours link, ends don't
    got = {r.component_id for r in ngramjoin.jaccard_components(frame(spark, texts), 3, 90).collect()}
    assert got == {0}
    kept = ngramjoin.keep_one(frame(spark, [*texts, "else", None, None]), 3, 90)
    assert sorted(r.doc_id for r in kept.collect()) == [0, 25, 26, 27] and kept.schema == frame(spark, []).schema
    assert ngramjoin.jaccard_components(frame(spark, []), 3, 90).count() == 0


def test_components(spark):
    edges = [(k, k + 1) for k in range(0, 300) if k % 50 != 49] + [(5, 5), (None, 3)] + [(1000, 2000 + k) for k in range(500)]
    df = spark.createDataFrame(edges, "a long, b long").repartition(7)
    got = {r.node: r.root for r in components(df, Scratch(spark)).collect()}
    assert all(got.get(k, k) == k // 50 * 50 for k in range(300)) and all(got[2000 + k] == 1000 for k in range(500))


# ---- 3 --------------------------------------------------------------------------------------------------------------


def test_warc(spark):
    pages = [(1, "http://a/", "<p>é</p>"), (5, None, "<p>é</p>"), (3, "u\r\nX: y", "<p>é</p>"), (2, "b", ""), (9, "b", None), (None, "c", "<p>é</p>"), (None, "c", "<p>é</p>"), (None, "c", None), (4, "d", "x" * 300_000), (6, "e", "only"), (5, None, "<p>é</p>")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("payload", F.lit(1))
    got = warc.round_trip(df).collect()
    top = {}
    for i, _, h in pages:
        top[h or ""] = max(top.get(h or "", -1), -1 if i is None else i)
    want = []
    for i, u, h in pages:
        raw = (h or "").encode()
        revisit = i is None or i < top[h or ""]
        want.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if revisit else "response", top[h or ""] if revisit else None))
    assert sorted(map(str, want)) == sorted(str((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in got)
    assert all(r.valid and (r.payload is None) == (r.record_type == "revisit") for r in got)
    assert {r.record_type for r in warc.round_trip(df, least_bytes=1 << 40).collect()} == {"response"}
    assert warc.round_trip(df.where("false")).count() == 0


def test_warc_damage(tmp_path, spark):
    good = warc.record(1, "http://a/", b"abc", None, False)
    assert [r[0] for r in warc.read(good + warc.record(2, None, b"", 1, True))] == [1, 2]
    for bad in (good[:-5], b"junk", good[:20] + b"\xff" + good[21:]):
        assert [r[7] for r in warc.read(good + bad)] == [True, False]
    import zlib as z

    text = z.decompressobj(31).decompress(good)
    forged = z.compressobj(6, z.DEFLATED, 31)
    (row,) = warc.read(forged.compress(text.replace(b"abc", b"abd")) + forged.flush())
    assert row[7] is False
    (tmp_path / "x.warc.gz").write_bytes(good)
    assert warc.read_files(spark, str(tmp_path)).first().page_id == 1


def foreign(kind, block, *fields, length=None):
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    head = ["WARC/1.0", f"WARC-Type: {kind}", *fields, f"Content-Length: {len(block) if length is None else length}"]
    return pack.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + pack.flush()


def test_warc_of_others(spark, tmp_path, monkeypatch):
    uuid = "WARC-Record-ID: <urn:uuid:0f-%d>"
    http = "Content-Type: application/http;msgtype=response"
    body = b"<p>hello</p>"
    reply = b"HTTP/1.1 200 OK\r\nContent-Length: 12\r\n\r\n" + body
    hex_, b32 = hashlib.sha1(body).hexdigest(), base64.b32encode(hashlib.sha1(body).digest()).decode()
    data = foreign("warcinfo", b"software: other\r\n", uuid % 1, "Content-Type: application/warc-fields")
    data += foreign("request", b"GET / HTTP/1.1\r\nHost: a\r\n\r\n", uuid % 2, "Content-Type: application/http;msgtype=request", "WARC-Target-URI: http://a/")
    data += foreign("response", reply, uuid % 3, http, "WARC-Target-URI: http://a/", f"WARC-Payload-Digest: sha1:{b32}")
    data += foreign("response", reply, uuid % 4, http, f"WARC-Payload-Digest: sha1:{hex_}", "WARC-Block-Digest: md5:00")
    data += foreign("response", reply, uuid % 5, http, f"WARC-Payload-Digest: sha1:{'A' * 32}")
    data += foreign("revisit", b"", uuid % 6, http, "WARC-Refers-To: <urn:uuid:0f-3>")
    data += foreign("metadata", b"via: x", uuid % 7) + foreign("response", b"", http)
    (tmp_path / "x.warc.gz").write_bytes(data)
    got = warc.read_files(spark, str(tmp_path)).collect()
    assert [r.record_type for r in got] == ["warcinfo", "request", "response", "response", "response", "revisit", "metadata", "response"]
    assert [r.valid for r in got] == [True, True, True, True, False, True, True, False]
    assert [r.record_id for r in got] == [f"<urn:uuid:0f-{k}>" for k in range(1, 8)] + [None] and {r.page_id for r in got} == {None}
    assert got[2].payload == body and got[2].payload_digest == b32 and got[2].url == "http://a/" and got[3].payload_digest == hex_
    assert got[5].refers_to_record == "<urn:uuid:0f-3>" and got[5].payload is None and got[6].payload == b"via: x"
    for length in (-1, 10**12, "x"):
        assert [r[7] for r in warc.read(foreign("response", reply, uuid % 1, length=length) + data)] == [False]
    monkeypatch.setattr(warc, "RECORD_BYTES", 10)
    assert [(r[2], r[7]) for r in warc.read(foreign("response", reply, uuid % 1) + foreign("metadata", b"x", uuid % 2))] == [("response", False), ("metadata", True)]
    assert [r[7] for r in warc.read(foreign("metadata", b"x", "X: " + "y" * 3_000_000))] == [False]


# ---- 4 --------------------------------------------------------------------------------------------------------------


def test_kneser_ney_sums_to_one(spark):
    texts = [sentence(30) for _ in range(60)] + [None, ""]
    docs = frame(spark, texts)
    labels = spark.createDataFrame([(k, 1, 0) for k in range(62)] + [(None, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int")
    model = quality.train(docs, labels)
    p = 2.0 ** -model.bits.astype(np.float64).reshape(-1, quality.CLASSES)
    # Class 0 stands for a text's beginning and is never predicted.
    assert np.allclose(p.sum(axis=1), 1, atol=0.02)
    import pyarrow as pa

    counts = collections.Counter(c for t in texts for c in t or "")
    assert set(counts) and model.table[ord(" ")] >= 8
    n, bits = model.score(pa.array(["the of the", "#@!~^&*(", None, ""], pa.string()))
    assert n.tolist() == [10, 8, 0, 0] and bits[0] / 10 < bits[1] / 8 and bits[2] == bits[3] == 0


def plain_kneser_ney(texts, table, order):
    """Interpolated modified Kneser-Ney by its definition, with dictionaries: the probability of a class after others."""
    seen = collections.Counter()
    for t in texts:
        codes = [0] * (order - 1) + [int(table[min(ord(c), 65536)]) for c in t]
        seen.update(tuple(codes[i : i + order]) for i in range(len(codes) - order + 1))
    counts = {order: seen}
    for k in range(order - 1, 0, -1):
        counts[k] = collections.Counter(g[1:] for g in counts[k + 1])
    levels = {}
    for k, c in counts.items():
        n = [max(sum(x == i for x in c.values()), 1) for i in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1])
        d = [min(max(x, 0.1), i + 0.9) for i, x in enumerate((1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2]))]
        total, held = collections.Counter(), collections.Counter()
        for g, x in c.items():
            total[g[:-1]] += x
            held[g[:-1]] += d[min(x, 3) - 1]
        levels[k] = c, d, total, held

    def p(g):
        if not g:
            return 1 / (quality.CLASSES - 1)
        c, d, total, held = levels[len(g)]
        if not total[g[:-1]]:
            return p(g[1:])
        x = c[g]
        return ((x - d[min(x, 3) - 1]) if x else 0) / total[g[:-1]] + held[g[:-1]] / total[g[:-1]] * p(g[1:])

    return p


def test_kneser_ney_like_plain(spark):
    import pyarrow as pa

    texts = [sentence(25) for _ in range(50)]
    labels = spark.createDataFrame([(k, 1, 0) for k in range(50)], "doc_id long, quality int, toxic int")
    model = quality.train(frame(spark, texts), labels)
    p = plain_kneser_ney(texts, model.table, quality.ORDER)
    for t in [*texts[:10], "the of the gamma", "unheard: qqq zz!", "中文 中文"]:
        codes = [0] * (quality.ORDER - 1) + [int(model.table[min(ord(c), 65536)]) for c in t]
        want = -sum(math.log2(p(tuple(codes[i : i + quality.ORDER]))) for i in range(len(t)))
        n, bits = model.score(pa.array([t]))
        assert n[0] == len(t) and abs(bits[0] - want) < 0.01 * len(t)


def test_quality_rejects_junk_and_keeps_clean(spark):
    texts = [sentence(40) for _ in range(200)] + ["".join(rng.choice("#@*&^%$") for _ in range(200)) for _ in range(8)] + [None, "", "the", sentence(3000)]
    docs = frame(spark, texts)
    labels = spark.createDataFrame([(k, 1, 0) for k in range(0, 200, 2)] + [(201, 0, 0)], "doc_id long, quality int, toxic int")
    kept = quality.accept(docs, labels)
    assert kept.schema == docs.schema
    ids = {r.doc_id for r in kept.collect()}
    assert not ids & set(range(200, 208)) and len(ids & set(range(200))) >= 198 and {208, 209, 211} <= ids
    judged = {r.doc_id: r.accepted for r in quality.judge(docs, labels).collect()}
    assert {k for k, v in judged.items() if v} == ids
    assert quality.accept(docs, labels.where("false")).count() == docs.count() and quality.judge(docs, labels.where("false")).where("accepted").count() == docs.count()
    assert quality.accept(docs.where("false"), labels).count() == 0
    other = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r.doc_id for r in quality.accept(other, labels).collect()} == ids


def test_quality_limits_with_copies_and_much_junk(spark):
    made = random.Random(3)
    clean = lambda n=40: " ".join(made.choice(WORDS) for _ in range(n))
    junk = lambda: "".join(made.choice("#@*&^%$") for _ in range(200))
    near = clean(200).split()
    rows = [("exact", clean(), True) for _ in range(60)] + [("exact", "the of " * 20, True)] * 140
    rows += [("near", clean(), True) for _ in range(60)]
    for _ in range(140):
        near[made.randrange(200)] = made.choice(WORDS)
        rows.append(("near", " ".join(near), True))
    rows += [("junk", clean(), True) for _ in range(120)] + [("junk", junk(), False) for _ in range(80)]
    rows += [(f"single{k}", clean(), True) for k in range(20)]
    docs = spark.createDataFrame([(k, t, lang) for k, (lang, t, _) in enumerate(rows)], "doc_id long, text string, lang string").repartition(3)
    labels = spark.createDataFrame([(k, 1, 0) for k, r in enumerate(rows) if r[2] and k % 2 == 0], "doc_id long, quality int, toxic int")
    wrong = [(rows[r.doc_id][0], r.doc_id) for r in quality.judge(docs, labels).collect() if r.accepted != rows[r.doc_id][2]]
    assert wrong == []
    assert {r.doc_id for r in quality.accept(docs, labels).collect()} == {k for k, r in enumerate(rows) if r[2]}


# ---- 5 --------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("frequent", [1 << 19, 6])
def test_pitman_yor(spark, monkeypatch, frequent):
    monkeypatch.setattr(pitmanyor, "FREQUENT", frequent)
    texts = odd_texts() + [sentence(30) + " unseen%d" % k for k in range(30)]
    ids = list(range(len(texts)))
    docs = frame(spark, [*texts, texts[5], texts[5]], [*ids, 5, 5])
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1
    got = pitmanyor.score(docs, held).collect()
    rows = [*zip(ids, texts, strict=True), (5, texts[5]), (5, texts[5])]
    is_held = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    c = collections.Counter()
    for i, t in rows:
        if not is_held(i):
            c.update([*token_list(t), None])
    n, v = sum(c.values()), len(c)
    want = []
    for i, t in rows:
        tokens = [*token_list(t), None]
        want.append((i, is_held(i), len(tokens), sum(c[x] > 0 for x in tokens), n, round(sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in tokens), 6)))
    assert sorted((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == sorted(want)
    assert all(r.score < 0 for r in got) and len({r.score for r in got if r.doc_id == 5}) == 1


def model_tables(spark, docs):
    """(model, g of words, g of pairs, c of words) by hash."""
    model = pitmanyor.train(docs, F.lit(False), Scratch(spark))
    words, pairs = model.words.collect(), model.pairs.collect()
    return model, {r.h: r.g for r in words}, {r.h: r.g for r in pairs}, {r.h: r.c for r in words}


def pair_key(u, w):
    return int(pitmanyor.pair_hash(np.array([u], np.int64).view(np.uint64), np.array([w], np.int64).view(np.uint64)).view(np.int64)[0])


@pytest.mark.parametrize("frequent", [1 << 19, 6])
def test_pitman_yor_is_a_distribution(spark, monkeypatch, frequent):
    monkeypatch.setattr(pitmanyor, "FREQUENT", frequent)
    docs = frame(spark, [sentence(200) + f" rare{k}" for k in range(20)] + [None])
    model, words, pairs, counts = model_tables(spark, docs)
    assert model.v == len(words) and model.n == sum(counts.values())
    # A context's share handed to the root is in its own word's g, so g - log p is the same in every sum below.
    seen = {(u, w) for u in words for w in words if pair_key(u, w) in pairs}
    assert len(seen) == len(pairs)
    p = {w: 10**g for w, g in root_logs(spark, docs).items()}
    assert np.isclose(sum(p.values()) + 10**model.unknown, 1)
    for u in words:
        handed = 10 ** words[u] / p[u]
        total = sum(p[w] * handed * 10 ** pairs.get(pair_key(u, w), 0.0) for w in words) + handed * 10**model.unknown
        assert np.isclose(total, 1), total


def root_logs(spark, docs):
    """log10 of the root's probabilities, as the last sweep of training leaves them."""
    found = {}
    plain = pitmanyor._root

    def noted(counts, seated):
        root, unknown = plain(counts, seated)
        found["p"] = {r.w: math.log10(r.p) for r in root.collect()}
        return root, unknown

    pitmanyor._root = noted
    try:
        pitmanyor.train(docs, F.lit(False), Scratch(spark))
    finally:
        pitmanyor._root = plain
    return found["p"]


def plain_pitman_yor(texts, sweeps=150, burn_in=50, seed=5):
    """Averaged predictive probabilities p(u, w) by seating customers one at a time, root and contexts in turn."""
    draw = random.Random(seed)
    customers = [(u, w) for t in texts for u, w in zip([None, *token_list(t)], [*token_list(t), None], strict=True)]
    n = collections.Counter(customers)
    d1 = pitmanyor.discount(sum(c == 1 for c in n.values()), sum(c == 2 for c in n.values()))
    vocabulary = sorted({w for _, w in customers}, key=str)
    base = (1 - pitmanyor.UNKNOWN) / len(vocabulary)
    tables = {k: [] for k in n}  # sizes of the tables of each (context, word)
    above = {w: [] for w in vocabulary}  # the same in the root
    of_context, n_context = collections.Counter(), collections.Counter()
    size = lambda: (sum(len(x) for x in above.values()), sum(sum(x) for x in above.values()))
    d0 = 0.5

    def root(w):
        t, c = size()
        return (sum(above[w]) - d0 * len(above[w]) + (1 + d0 * t) * base) / (1 + c)

    def sit(boxes, d, fresh):
        at = draw.random() * (sum(boxes) - d * len(boxes) + fresh)
        for k, x in enumerate(boxes):
            at -= x - d
            if at < 0:
                boxes[k] += 1
                return False
        boxes.append(1)
        return True

    def leave(boxes):
        k = draw.choices(range(len(boxes)), boxes)[0]
        boxes[k] -= 1
        if not boxes[k]:
            boxes.pop(k)
            return True
        return False

    total, kept = collections.Counter(), 0
    for sweep in range(sweeps):
        for u, w in customers:
            if sweep:
                n_context[u] -= 1
                if leave(tables[u, w]):
                    of_context[u] -= 1
                    leave(above[w])
            fresh = (1 + d1 * of_context[u]) * root(w)
            n_context[u] += 1
            if sit(tables[u, w], d1, fresh):
                of_context[u] += 1
                t, _ = size()
                sit(above[w], d0, (1 + d0 * t) * base)
        k = collections.Counter(sum(x) for x in above.values())
        d0 = pitmanyor.discount(k[1], k[2])
        if sweep >= burn_in:
            kept += 1
            for u, w in n:
                total[u, w] += (n[u, w] - d1 * len(tables[u, w]) + (1 + d1 * of_context[u]) * root(w)) / (1 + n_context[u])
    return {k: x / kept for k, x in total.items()}


def test_pitman_yor_like_plain(spark):
    """The distributed sampler against a sequential one: the scores of texts agree within 2 %."""
    made = random.Random(3)
    texts = [" ".join(made.choices(WORDS, range(1, len(WORDS) + 1), k=25)) for _ in range(12)]
    want = plain_pitman_yor(texts)
    got = {r.doc_id: r.score for r in pitmanyor.score(frame(spark, texts), F.lit(False)).collect()}
    for k, t in enumerate(texts):
        plain = sum(math.log10(want[u, w]) for u, w in zip([None, *token_list(t)], [*token_list(t), None], strict=True))
        assert abs(got[k] - plain) < 0.02 * abs(plain), (got[k], plain)


def test_seating_like_one_by_one():
    """Tables of a dish, against customers seated one by one."""
    np_rng = np.random.default_rng(1)
    c, new, d = 200, 0.8, 0.5
    got = pitmanyor.seat(np.full(4000, c), np.full(4000, new), d, np_rng).mean()
    total = 0.0
    t = np.ones(4000)
    for k in range(1, c):
        t += np_rng.random(4000) < new / (new + k - d * t)
    total = t.mean()
    assert abs(got - total) < 0.15 and pitmanyor.seat(np.array([0, 1]), np.array([1.0, 1.0]), d, np_rng).tolist() == [0, 1]


def test_pitman_yor_with_a_missing_id(spark):
    """A row without an id is none of those with one, whatever that is."""
    docs = frame(spark, ["one two"] * 5, [None, -7, 0, None, -7])
    got = pitmanyor.score(docs, F.lit(False)).collect()
    assert collections.Counter(r.doc_id for r in got) == {None: 2, -7: 2, 0: 1} and all(r.n_tokens == 3 for r in got)


def test_pitman_yor_without_text(spark):
    docs = frame(spark, [None, "a b"])
    got = sorted(pitmanyor.score(docs, F.lit(True)).collect())
    assert [(r.n_tokens, r.n_known, r.train_tokens, r.score) for r in got] == [(1, 0, 0, 0.0), (3, 0, 0, 0.0)]
    assert pitmanyor.score(docs.where("false"), F.lit(False)).count() == 0


# ---- 6 --------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("law", ["bytes", "rows", "key"])
def test_sharding(spark, law):
    texts = [sentence(rng.randrange(1, 60)) for _ in range(600)] + ["same text"] * 300 + [None, "", sentence(4000)]
    ids = [*range(len(texts) - 2), None, -(1 << 63)]
    got = sharding.assign(frame(spark, texts, ids).repartition(6), 8, law).collect()
    assert len(got) == len(texts)
    by = collections.defaultdict(list)
    for r in got:
        by[r.shard].append(r)
    assert all(sorted(r.slot for r in rows) == list(range(len(rows))) for rows in by.values()) and set(by) <= set(range(8))
    want = collections.Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in zip(ids, texts, strict=True))
    assert collections.Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    if law == "bytes":
        sizes = [sum(r.size for r in by[k]) for k in range(8)]
        assert max(sizes) - min(sizes) <= max(r.size for r in got) + 0.001 * sum(sizes)
    elif law == "rows":
        counts = [len(by[k]) for k in range(8)]
        assert max(counts) - min(counts) <= 1
    if law == "key":
        assert all(r.grown_shard in (r.shard, 8) for r in got)
        again = {r.doc_id: r.shard for r in sharding.assign(frame(spark, texts, ids), 9, "key").collect()}
        assert all(again[r.doc_id] == r.grown_shard for r in got)
    else:
        assert all(r.grown_shard is None for r in got)


def test_sharding_edges(spark):
    assert sharding.assign(frame(spark, []), 4).count() == 0
    rows = sharding.assign(frame(spark, ["a"] * 5, [1] * 5), 4).collect()
    assert sorted((r.shard, r.slot) for r in rows) == [(k, s) for k, n in enumerate(collections.Counter(r.shard for r in rows)[j] for j in range(4)) for s in range(n)]
    repeated = sharding.assign(frame(spark, ["a"] * 103, [1] * 103).repartition(3), 4, "rows").collect()
    counts = collections.Counter(r.shard for r in repeated)
    assert len(counts) == 4 and max(counts.values()) - min(counts.values()) == 1
    many = spark.range(0, 60_001, 1, 4).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "same").otherwise(F.concat(F.lit("t"), "id")).alias("text"))
    counts = {r.shard: r for r in sharding.assign(many, 8, "rows").groupBy("shard").agg(F.count("*").alias("n"), F.max("slot").alias("top"), F.countDistinct("slot").alias("d")).collect()}
    assert len(counts) == 8 and {r.n for r in counts.values()} <= {7500, 7501} and all(r.n == r.top + 1 == r.d for r in counts.values())
    placed = many.select(F.col("doc_id").alias("_d"), F.col("doc_id").alias("_r"), F.shiftrightunsigned(F.xxhash64("text"), 1).alias("_u"), F.lit(0).alias("shard"))
    numbered = sharding._numbered(placed, 60_001, 500)
    cells = [r["count"] for r in numbered.groupBy("cell", "cut").count().collect()]
    assert numbered.select("slot").distinct().count() == 60_001 and len(cells) < 3 * 120 and max(cells) <= 1000
    with pytest.raises(ValueError):
        sharding.assign(frame(spark, ["a"]), 4, "no such law")


# ---- 7 --------------------------------------------------------------------------------------------------------------

PAGE = (
    "<!DOCTYPE html><html><head><title>no</title><style>p{}</style><script>var t='</p>';</script></head><body class='x'><nav><ul><li><a href='/'>Menu</a></li></ul></nav><!-- no <p>no</p> -->"
    "<div class='cookie-notice'>We use cookies</div><header><h2>Site</h2></header><div class='page page-12'><aside>Side</aside><article><header><h1>T&amp;l  e</h1></header><p><b>One <i>two</i><br><p>Three&nbsp;\n four</p>"
    "<div class='ad'>Buy</div><form><input name=a>Search</form><ul><li>item</ul><table><tr><td>c1<td>c2</table></article><section class='comments'><p>Nice!</p></section></div><footer>&copy; foot</footer>"
)
WANT = "T&l e\n\nOne two\n\nThree four\n\nitem\n\nc1\n\nc2"


def test_page_text():
    assert htmltext.Page(PAGE).text(None) == WANT
    for broken in ("", "<", "<p", "text only", "</p></div>x", "<!-- open", "<script>x", '<a href="x>y</a>z', "<p>" * 2000 + "deep", "<div " + "a" * 5000):
        htmltext.Page(broken).text(None)
    assert htmltext.Page("plain words").text(None) == "plain words"
    assert htmltext.Page("<div class='has-sidebar'><p>kept</p><div id=siteFooter>no</div><div class=adBanner>no</div><ol class='userComments'><li>no</ol></div>").text(None) == "kept"
    assert htmltext.Page("<div class='sidebar-layout'><p>all there is</p></div>").text(None) == "all there is"


def test_page_keeps_article_classes():
    html = "<article><div class='hidden-gems'><p>one</p></div><p class='share-price'>two</p><div class='search-history'>three</div><p>four</p><div class='ad-slot'>no</div><div id='reader-comments'>no</div></article>"
    assert htmltext.Page(html).text(None) == "one\n\ntwo\n\nthree\n\nfour"


@pytest.mark.parametrize("name", "promo search related copyright notice social subscription form-replies notice-text comment-text".split())
def test_one_word_opens_a_vote_in_an_article(spark, name):
    page = "<article><p>Story {k} begins.</p><div class='%s'><p>{own}</p></div><p>It ends.</p></article><div class='%s'>{own}</div>" % (name, name)
    assert htmltext.Page(page.format(k=1, own="A paragraph of it.")).text(None) == "Story 1 begins.\n\nA paragraph of it.\n\nIt ends."
    rows = [(k, "http://own/", page.format(k=k, own=f"Paragraph {k} of it.")) for k in range(4)]
    rows += [(k, "http://same/", page.format(k=k, own="The same everywhere.")) for k in range(10, 14)]
    rows += [(k, "http://links/", page.format(k=k, own=f"<a href=x>go to {k}</a>")) for k in range(20, 22)]
    for r in htmltext.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect():
        own = f"Paragraph {r.page_id} of it.\n\n" if r.page_id < 4 else ""
        assert r.text == f"Story {r.page_id} begins.\n\n{own}It ends."


def test_parts_stay_out_of_an_article():
    parts = "".join(f"<div class='{c}'>no</div>" for c in "ad|ad-slot|cookie-notice|share-buttons|related-links|newsletter|comments|comment|reader-comments|promo-box|social-bar|sidebar|search-box".split("|"))
    assert htmltext.Page(f"<article><p>one</p>{parts}<p>two</p></article>").text(None) == "one\n\ntwo"


def test_pages_as_made():
    """Pages whose text is known as they are made: blocks of an article, with other parts strewn in."""
    made = random.Random(4)
    word = lambda: "".join(made.choice("abcdeé&") for _ in range(made.randrange(1, 8)))
    words = lambda: " ".join(word() for _ in range(made.randrange(3, 30)))
    escape = lambda t: t.replace("&", made.choice(["&amp;", "&#38;", "&#x26;"])).replace(" ", made.choice([" ", "\n ", "  \t"]))
    noise = ["<nav><a href=x>%s</a></nav>", "<div class='ad'>%s</div>", "<aside><p>%s</p></aside>", "<form><p>%s</p></form>", "<script>if (a</b) '<p>%s</p>'</script>", "<div role=search>%s</div>", "<!-- <p>%s</p> -->", "<div class='cookie-notice'><b>%s</b></div>", "<style>%s</style>", "<ul class='share-buttons'><li>%s</ul>"]
    for _ in range(150):
        body, want = [], []

        def block(depth):
            kind = made.randrange(8 if depth < 4 else 5)
            if kind > 5:
                body.append(made.choice(["<div>", "<section class='hidden-gems'>", "<blockquote class=x1>"]))
                tag = body[-1][1:].split()[0].rstrip(">")
                for _ in range(made.randrange(1, 4)):
                    block(depth + 1)
                body.append(f"</{tag}>")
            elif kind == 5:
                body.append(made.choice(noise) % escape(words()).replace("<", ""))
            else:
                text = words()
                want.append(text)
                first, _, rest = escape(text).partition(" ")
                body.append(made.choice(["<p>%s</p>", "<p class='share-price'>%s</p>", "<h2>%s</h2>", "<p>%s", "<ul><li>%s</ul>"]) % (f"<i>{first}</i> {rest}" if rest else first))

        for _ in range(made.randrange(3, 9)):
            block(0)
        html = "<html><body>" + noise[0] % "menu" + "<article>" + "".join(body) + "</article><footer>foot</footer></body></html>"
        assert htmltext.Page(html).text(None) == "\n\n".join(want)


@pytest.mark.parametrize("html", ["<div>" * 50_000 + "deep", "<div class='a b'>" * 50_000 + "deep" + "</div>" * 50_000, "<div>" * 50_000 + "</p>" * 50_000 + "deep", "<b>" * 50_000 + "</i>" * 50_000 + "deep", "<b>" * 50_000 + "<p>deep</b>" * 50_000, "<ul><li>" * 25_000 + "deep", "<table><tr><td>" * 20_000 + "deep", "<p class='share-price'>deep" * 50_000])
def test_page_takes_linear_time(html):
    import time
    import tracemalloc

    start = time.process_time()
    page = htmltext.Page(html)
    assert "deep" in page.text(None) and time.process_time() - start < 10
    page.best(), page.doubtful()
    tracemalloc.start()
    htmltext.Page(html[:200_000])
    assert tracemalloc.get_traced_memory()[1] < 60e6
    tracemalloc.stop()


def test_doubtful_names_are_voted_on(spark):
    page = "<article><p>Story {k} tells of many things.</p><div class='share-price'>{a}</div><div class='related-gems'>{b}</div></article>"
    rows = [(k, "http://h/", page.format(k=k, a=f"price {k}", b="<a href=x>see also %d</a>" % k)) for k in range(4)]
    rows += [(k, "http://g/", page.format(k=k, a="always the same", b=f"gem {k}")) for k in range(10, 14)]
    for hosts in (100, 0):
        got = {r.page_id: r.text for r in htmltext.main_text(spark.createDataFrame(rows, "page_id long, url string, html string"), hosts).collect()}
        for k in range(4):
            assert got[k] == f"Story {k} tells of many things.\n\nprice {k}"
            assert got[k + 10] == f"Story {k + 10} tells of many things.\n\ngem {k + 10}"


@pytest.mark.parametrize("copies", [1, 2, 3, 10, 100])
def test_copies_of_an_article_are_one_article(spark, copies):
    """Repeated rows, and one article under several addresses with menus of their own, don't vote text out."""
    page = "<nav><a href=x>menu {k}</a></nav><article><p>A story of many things.</p><p class='share-price'>The price fell.</p></article>"
    rows = [(k, f"http://h/{k}", page.format(k=k % 7)) for k in range(copies)]
    # What stands in three different articles is none of theirs; in two it may be.
    other = "<article><p>Story {k} is another.</p><div class='share-price'>Now at a special price</div></article>"
    rows += [(1000 + k, "http://three/", other.format(k=k % 3)) for k in range(3 * copies)] + [(2000 + k, "http://two/", other.format(k=k % 2)) for k in range(2 * copies)]
    for hosts in (100, 0):
        got = {r.page_id: r.text for r in htmltext.main_text(spark.createDataFrame(rows, "page_id long, url string, html string"), hosts).collect()}
        for i, text in got.items():
            if i < 1000:
                assert text == "A story of many things.\n\nThe price fell."
            elif i < 2000:
                assert text == f"Story {(i - 1000) % 3} is another."
            else:
                assert text == f"Story {(i - 2000) % 2} is another.\n\nNow at a special price"


def test_main_text(spark):
    short = "<html><body class='x'><div class='page page-7'><article><p>brief</p></article></div><div class='long'><p>" + "noise " * 200 + "</p></div></body></html>"
    pages = [(k, "http://Host.example/a", PAGE.replace("One", f"One{k}")) for k in range(5)] + [(9, "http://host.example:80/b", short), (10, None, None), (11, "no url", ""), (12, "http://other.example/", short), (None, "x", "<p>t</p>")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    for hosts in (10, 0):
        got = {r.page_id: r for r in htmltext.main_text(df, hosts).collect()}
        assert all(got[k].text == WANT.replace("One", f"One{k}") and got[k].n_chars == len(got[k].text) for k in range(5))
        assert got[9].text == "brief"  # the host's path wins over the longer block
        assert got[12].text.startswith("noise") and got[10].text == got[11].text == "" and got[None].text == "t"
    assert htmltext.main_text(df.where("false")).count() == 0
    top = {r.host: r.path for r in htmltext.winners(df).collect()}
    assert top["host.example"] == ">html>body.x>div.page.page-#>article"


# ---- 8 --------------------------------------------------------------------------------------------------------------


def plain_links(vectors, threshold=0.95):
    def cosine(a, b):
        return sum(x * y for x, y in zip(a, b, strict=True)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))

    good = [v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) for v in vectors]
    return [(a, b) for a, b in itertools.combinations(range(len(vectors)), 2) if good[a] and good[b] and len(vectors[a]) == len(vectors[b]) and cosine(vectors[a], vectors[b]) >= threshold]


@pytest.mark.parametrize("tile", [4096, 16])
def test_embeddings(spark, tile):
    np_rng = np.random.default_rng(5)
    base = np_rng.normal(size=(6, 12))
    vectors = [(base[k % 6] + np_rng.normal(size=12) * 0.12).astype(np.float32).tolist() for k in range(120)]
    vectors += [vectors[0], vectors[0], [2 * x for x in vectors[0]], None, [], [0.0] * 12, [float("nan")] * 12, [float("inf")] + [1.0] * 11, [None] + [1.0] * 11, vectors[0][:5], vectors[0][:5]]
    ids = [500 - k for k in range(len(vectors))]
    df = spark.createDataFrame(list(zip(ids, vectors, strict=True)), "vec_id long, embedding array<float>").withColumn("h", F.lit(1)).repartition(5)
    got = {r.vec_id: r for r in embeddup.near_duplicates(df, tile=tile).collect()}
    vectors = [None if v is None else [None if x is None else float(np.float32(x)) for x in v] for v in vectors]
    links, count, up = plain_links(vectors), collections.Counter(), list(range(len(vectors)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        count[a] += 1
        count[b] += 1
        up[root(a)] = root(b)
    least = {}
    for k in range(len(vectors)):
        least[root(k)] = min(least.get(root(k), ids[k]), ids[k])
    for k in range(len(vectors)):
        r = got[ids[k]]
        assert (r.n_links, r.component_id, r.kept) == (count[k], least[root(k)], least[root(k)] == ids[k]), k
    assert links and embeddup.near_duplicates(df.where("false")).count() == 0


# ---- 9 --------------------------------------------------------------------------------------------------------------


def test_bpe_like_the_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    public = pytest.importorskip("public_tokenizers")
    path = public.path("word_bpe_49k.json")
    library = tokenizers.Tokenizer.from_file(path)
    pool = "''''stredvlm!. 19aé ñ́Σİ²½　\x1c​ 中文🙂ǅ" + "".join(map(chr, range(0x2000, 0x2030)))
    texts = odd_texts() + ["<|endoftext|>", "x<|endoftext|>y <|startoftext|>", "it's we'll 'sx ''s", "a" * 5000]
    for n in (10, 11, 12):
        texts += [f"{x} and {x} {y}" for x, y in (twins(n), twins(n)[::-1])]
    texts += ["".join(rng.choice([rng.choice(pool), "'s", "'ll", "<|endoftext|>", " "]) for _ in range(rng.randrange(25))) for _ in range(400)]
    docs = frame(spark, [*texts, texts[5]], [*range(len(texts)), 5]).repartition(3)
    got = collections.defaultdict(list)
    for r in bpe.digests(docs, path).collect():
        got[r.doc_id].append(r)
    assert len(got[5]) == 2
    for k, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids
        for r in got[k]:
            assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
            assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    full = bpe.encode(docs.withColumns({"ids": F.lit(1), "decoded": F.lit(2), "block": F.lit(3), "_text": F.lit(4)}), path)
    row = full.where("doc_id = 4").first()
    assert row.ids == library.encode(texts[4], add_special_tokens=False).ids and row.decoded == library.decode(row.ids, skip_special_tokens=False) and (row.block, row._text, row.text) == (3, 4, texts[4])
    assert bpe.digests(docs.where("false"), path).count() == 0


def test_bpe_in_small_blocks(spark, monkeypatch):
    public = pytest.importorskip("public_tokenizers")
    path = public.path("word_bpe_49k.json")
    docs = frame(spark, odd_texts()).repartition(2)
    want = sorted(map(str, bpe.digests(docs, path).collect()))
    for name, value in (("PART_BYTES", 64), ("LOCAL_WORDS", 3), ("BLOCK_BYTES", 300), ("SPLIT_BYTES", 200)):
        monkeypatch.setattr(bpe, name, value)
    monkeypatch.setattr(bpe.split, "__defaults__", (300,))
    assert sorted(map(str, bpe.digests(docs, path).collect())) == want


def test_bpe_ids_and_digests(spark, monkeypatch):
    path = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
    docs = frame(spark, odd_texts()).repartition(2)
    want = sorted((r.doc_id, len(r.ids), r.ids, hashlib.sha256(r.decoded.encode()).hexdigest()) for r in bpe.encode(docs, path, ["doc_id"]).collect())
    for run in (bpe.RUN, 5):  # a block's table in one piece, and in many
        monkeypatch.setattr(bpe, "RUN", run)
        assert sorted(map(tuple, bpe.ids_and_digests(docs, path).collect())) == want


def test_bpe_tables_of_characters_take_little_memory():
    import subprocess
    import sys
    from pathlib import Path

    show = "int(next(l for l in open('/proc/self/status') if l.startswith('VmHWM')).split()[1]) // 1024"
    code = f"import tokenizers, numpy, pyarrow\nfrom folioloom.llm import bpe\na = {show}\nbpe._classes(); bpe._lower()\nprint({show} - a)"
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=Path(bpe.__file__).parents[2])
    assert int(out.stdout) < 100


def test_bpe_packs_numbers():
    edges = [0, 1, 191, 192, 12479, 12480, 12480 + 15 * 65536 - 1, 12480 + 15 * 65536, 2**32 - 1]
    for values in ([], edges, [rng.randrange(2 ** rng.randrange(33)) for _ in range(2000)]):
        assert bpe._unpack(bpe._pack(np.array(values, np.int64))).tolist() == values
    for ids in ([], [0, 65535], [1, 70000]):
        assert bpe._unpack_ids(bpe._pack_ids(np.array(ids, np.int64))).tolist() == ids


def test_bpe_words_of_one_hash():
    block, words = bpe._Block(), bpe.Words("aa bb aa cc\n", np.array([0, 3, 6, 9]), np.array([2, 5, 8, 11]), np.array([7, 7, 7, 9], np.uint64), np.array([0, 4]))
    import pyarrow as pa

    block.add(words, pa.RecordBatch.from_arrays([pa.array([1])], names=["x"]))
    assert [list(block.words)[k] for k in block.places[0]] == ["aa", "bb", "aa", "cc"]


# ---- 10 -------------------------------------------------------------------------------------------------------------


def plain_segments(scores):
    """All maximal scoring segments by their recursive definition: the best one, then those to either side."""
    best = max(((sum(scores[a : b + 1]), -(b - a), -a, a, b) for a in range(len(scores)) for b in range(a, len(scores))), default=(0,))
    if best[0] <= 1e-12:
        return []
    a, b = best[3:]
    return plain_segments(scores[:a]) + [(a, b)] + [(x + b + 1, y + b + 1) for x, y in plain_segments(scores[b + 1 :])]


def test_segments():
    for _ in range(300):
        scores = [rng.choice([-0.5, -0.5, -0.51, -1.7, 0.7, 1.3, 2.1]) for _ in range(rng.randrange(14))]
        got = toxicity.segments(np.array(scores, float))
        assert [(a, b) for a, b, _ in got] == plain_segments(scores) and all(abs(s - sum(scores[a : b + 1])) < 1e-9 for a, b, s in got)


@pytest.mark.parametrize("scores", [[1.0, -1.5] * 100_000, [1.0, -0.5] * 100_000, [3.0, *[-0.01, 0.005] * 100_000], np.sin(np.arange(200_000.0)).tolist(), [1.0] * 200_000])
def test_segments_take_linear_time(scores):
    import time

    start = time.process_time()
    assert toxicity.segments(np.array(scores))
    assert time.process_time() - start < 3


def test_toxicity(spark):
    texts, labels = [], []
    for k in range(400):
        words = sentence(60).split()
        words[rng.randrange(60)] = f"filler{rng.randrange(10_000)}"
        if k % 5 == 0:
            for _ in range(4):
                words[rng.randrange(60)] = rng.choice(["nasty", "vile", "scornful%d" % rng.randrange(90)])
        texts.append(" ".join(words))
        labels.append((k, 1, int(k % 5 == 0)))
    texts += [None, "", "!!!", sentence(20_000)]
    docs = frame(spark, texts)
    table = spark.createDataFrame([*labels, (None, 1, 1), (3, 1, None), (77777, 1, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, table, usable=F.col("doc_id") % 4 != 2)
    got = {r.doc_id: r for r in toxicity.scores(docs, model).collect()}
    held = [k for k in range(400) if k % 4 == 2]
    assert np.mean([got[k].predicted == int(k % 5 == 0) for k in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())
    assert got[400].score == got[401].score == got[402].score == min(r.score for r in got.values()) and got[403].predicted == 0
    kept = toxicity.accept(docs, model)
    assert kept.schema == docs.schema and {r.doc_id for r in kept.collect()} == {k for k, r in got.items() if not r.predicted}
    found = toxicity.passages(docs, model).collect()
    assert {r.doc_id for r in found} <= set(range(400)) and all(r.first_word <= r.last_word and r.chance <= toxicity.P_MOST for r in found)
    for none in (table.where("toxic = 0"), table.where("false")):
        assert {r.predicted for r in toxicity.scores(docs, toxicity.train(docs, none)).collect()} == {0}
    assert toxicity.scores(docs.where("false"), model).count() == 0


def plain_weights(texts, labels):
    """Weights by feature, from dictionaries."""
    docs, times, total = collections.Counter(), collections.Counter(), collections.Counter()
    for k, y in labels.items():
        seen = [f for w in word_list(texts[k]) for f in plain_features(w)]
        times.update((f, y) for f in seen)
        docs.update((f, y) for f in set(seen))
        total.update({("texts", y): 1, ("words", y): len(word_list(texts[k]))})

    def odds(count, f, unit):
        n1, n0 = total[unit, 1], total[unit, 0]
        x1, x0, a = count[f, 1], count[f, 0], toxicity.PRIOR * (n1 + n0)
        p = a * (x1 + x0) / (n1 + n0)
        w = math.log((x1 + p) / max(n1 + a - x1 - p, 1)) - math.log((x0 + p) / max(n0 + a - x0 - p, 1))
        return w, w / math.sqrt(1 / (x1 + p) + 1 / (x0 + p))

    out = {}
    for f in {f for f, _ in docs}:
        weight = odds(times, f, "words")[0]
        if docs[f, 0] + docs[f, 1] >= toxicity.COMMON and (odds(docs, f, "texts")[1] >= toxicity.Z or weight < 0):
            out[f] = weight if weight < 0 or weight >= toxicity.LEAST else 0.0
    return out


def plain_features(word):
    return [word, *((n, word[:n]) for n in toxicity.BEGINNINGS if len(word) > n)]


def test_toxicity_like_plain(spark):
    made = random.Random(11)
    common, clean, toxic = ([f"{x}{made.choice('abcdefgh')}{k}é" for k in range(n)] for x, n in (("w", 60), ("fine", 6), ("bad", 9)))
    texts, labels = [], {}
    for k in range(240):
        words = made.choices(common, k=made.randrange(20, 50))
        for _ in range(made.randrange(6)):
            words[made.randrange(len(words))] = made.choice(toxic if k % 4 == 0 else clean)
        texts.append(" ".join(words))
        labels[k] = int(k % 4 == 0)
    texts += [None, "", texts[0] * 2, " ".join(toxic * 30)]
    docs = frame(spark, texts)
    model = toxicity.train(docs, spark.createDataFrame([(k, y) for k, y in labels.items()], "doc_id long, toxic int"))
    weights = plain_weights(texts, labels)
    assert len(model.weights.keys) == len(weights) and all(weights[w] < -1 for w in clean) and min(weights.get(w, 9) for w in toxic) > 1

    def plain_score(text):
        scores, found = [], 0.0
        for w in word_list(text):
            x = next((weights[f] for f in plain_features(w) if f in weights), 0.0)
            scores.append(x if x > 0 else min(x, -toxicity.DRIFT))
        for a, b in plain_segments(scores):
            p = -math.expm1(-model.k * len(scores) * math.exp(-model.lam * sum(scores[a : b + 1])))
            found -= math.log(max(p, 1e-300))
        return 1 / (1 + math.exp(-(model.curve[0] + model.curve[1] * math.log1p(found))))

    for r in toxicity.scores(docs, model).collect():
        assert abs(r.score - plain_score(texts[r.doc_id])) < 1e-9


def test_toxicity_of_words_of_clean_texts_alone(spark):
    texts = [" ".join(f"w{(k * 7 + j) % 97}" for j in range(12)) + (" vile vile vile vile vile vile vile" if k % 4 == 0 else " kindly") + f" id{k}" for k in range(400)]
    model = toxicity.train(frame(spark, texts), spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(400)], "doc_id long, toxic int"))
    import pyarrow as pa

    got = model.weights.of(textscan.scan(pa.array(["kindly vile vile unseen"]), textscan.ALNUM))
    assert got[0] < -2 and got[1] == got[2] > 2 and got[3] == -toxicity.DRIFT


def test_toxicity_backs_off_to_beginnings(spark):
    """Words seen once are weighed by their first characters."""
    texts = [sentence(40) + (f" scornful{k} scornful{k}x" if k % 4 == 0 else f" plainer{k}") for k in range(300)]
    labels = spark.createDataFrame([(k, 1, int(k % 4 == 0)) for k in range(300)], "doc_id long, quality int, toxic int")
    docs = frame(spark, texts)
    model = toxicity.train(docs, labels, usable=F.col("doc_id") % 3 > 0)
    got = {r.doc_id: r.predicted for r in toxicity.scores(docs, model).collect()}
    assert np.mean([got[k] == int(k % 4 == 0) for k in range(0, 300, 3)]) > 0.97
