"""Byte-level BPE against the library that defines it."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from folioloom.llm import bytebpe

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def ranks():
    with open(PATH, "rb") as f:
        return bytebpe.Ranks(f.read(), PATTERN)


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks.ranks, special_tokens={})


def ids(ranks, text):
    return np.frombuffer(ranks.encode([text])[0], "<u4").tolist()


def test_queue_gives_the_lowest_rank_first():
    rng, queue, held = random.Random(1), bytebpe.RankQueue(50_000), {}
    for _ in range(3000):
        if held and rng.random() < 0.5:
            rank, places = queue.pop()
            assert rank == min(held) and places == held.pop(rank)
        else:
            rank = rng.randrange(50_000)
            if rank not in held:
                held[rank] = [rng.randrange(9)]
                queue.open(rank, list(held[rank]))
        assert bool(queue) == bool(held)


def test_random_texts(ranks, library):
    rng = random.Random(2)
    some = ["ab", "aaaa", "xyxyx", " ", "  ", "\n", "\t", "é", "é", "ß", "漢字", "😀", "1", "23", "'s", "'ll", "'", "!", "...", "　", "\x1c", "\x85", "<|endoftext|>", "the", " of", chr(1368), chr(8335), chr(73184), chr(0x1F900)]
    texts = ["".join(rng.choice(some) for _ in range(rng.randrange(40))) for _ in range(4000)]
    assert [np.frombuffer(x, "<u4").tolist() for x in ranks.encode(texts)] == [library.encode_ordinary(x) for x in texts]


@pytest.mark.parametrize("letters", ["a", "ab", "abc", "abcdefghijklmnopqrstuvwxyz", "éèê", "-="])
def test_long_pre_tokens(ranks, library, letters):
    rng = random.Random(3)
    for n in (100, 1000, 30_000):
        text = "".join(rng.choice(letters) for _ in range(n))
        assert ids(ranks, text) == library.encode_ordinary(text)


def test_overlapping_pairs_of_one_rank():
    """Ranks that aren't in the order of their lengths: merges open lower ranks, and pairs of one rank overlap."""
    pieces = [bytes([k]) for k in range(256)] + [b"aba", b"ab", b"ba", b"abab", b"baba", b"ababa", b"aa", b"bb", b"aab", b"bab", b"abb"]
    rng = random.Random(4)
    for _ in range(60):
        order = pieces[:256] + rng.sample(pieces[256:], len(pieces) - 256)
        table = {p: k for k, p in enumerate(order)}
        own = bytebpe.Ranks(bytebpe_lines(table), r"[ab]+", {})
        theirs = tiktoken.Encoding("own", pat_str=r"[ab]+", mergeable_ranks=table, special_tokens={})
        texts = ["".join(rng.choice("ab") for _ in range(rng.randrange(1, 60))) for _ in range(60)]
        assert [np.frombuffer(x, "<u4").tolist() for x in own.encode(texts)] == [theirs.encode_ordinary(x) for x in texts]


def bytebpe_lines(table):
    import base64

    return b"\n".join(base64.b64encode(p) + b" " + str(k).encode() for p, k in table.items())


def test_texts_in_pieces_and_forgotten_words(ranks, library, monkeypatch):
    monkeypatch.setattr(bytebpe, "SPLIT_CHARS", 7)
    monkeypatch.setattr(bytebpe, "RUN_WORDS", 5)
    monkeypatch.setattr(bytebpe, "LOCAL_WORDS", 3)
    monkeypatch.setattr(bytebpe, "LOCAL_CHARS", 4)
    rng = random.Random(5)
    for _ in range(300):
        text = "".join(rng.choice(["word", " ", "  ", "\n", " longer-word", "é", "7", "'s", "\t "]) for _ in range(rng.randrange(60)))
        assert ids(ranks, text) == library.encode_ordinary(text)


def test_table_and_defined_cases(spark, library):
    texts = ["Plain text, twice.", "Plain text, twice.", None, "", "  \n ", "x" * 50_000 + " tail", "nächste Straße 東京"]
    rows = spark.createDataFrame([(k, t, "mine", [7]) for k, t in enumerate(texts)] + [(None, "no id", None, None)], "doc_id long, text string, decoded string, ids array<int>")
    got = {r.doc_id: r for r in bytebpe.digests(rows, PATH, PATTERN).collect()}
    assert set(got) == {*range(len(texts)), None}
    for k, t in [*enumerate(texts), (None, "no id")]:
        want = library.encode_ordinary(t or "")
        assert got[k].n_tokens == len(want)
        assert got[k].ids_sha256 == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert got[k].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    whole = bytebpe.encode(rows, PATH, PATTERN)
    assert whole.columns == ["doc_id", "text", "ids", "decoded"]
    for r in whole.collect():
        assert r.ids == library.encode_ordinary(r.text or "") and bytes(r.decoded).decode() == (r.text or "")
    back = bytebpe.decode(whole, PATH, PATTERN, ["doc_id", "text"]).collect()
    assert all(bytes(r.decoded).decode() == (r.text or "") for r in back)
    assert bytebpe.digests(rows.limit(0), PATH, PATTERN).collect() == []


def test_ids_that_are_not_there(spark):
    rows = spark.createDataFrame([(1, None)], "k int, ids array<long>")
    assert bytebpe.decode(rows, PATH, PATTERN).collect()[0].decoded is None
    with pytest.raises(Exception):
        bytebpe.decode(spark.createDataFrame([(1, [10_000_000])], "k int, ids array<long>"), PATH, PATTERN).collect()
