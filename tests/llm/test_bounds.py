"""What operators hold in the driver or write follows the input."""

import numpy as np
from pyspark.sql import functions as F

from folioloom.llm import ngramjoin, pitmanyor
from folioloom.llm.common import Scratch


def test_near_duplicates_bitmaps_follow_the_input(spark, monkeypatch):
    """A table of a few texts makes bitmaps of kilobytes, not of 16 MB and 8 MB, and links as ever."""
    held = {}
    frequent, bloom = ngramjoin._frequent, ngramjoin._bloom
    monkeypatch.setattr(ngramjoin, "_frequent", lambda *a: held.setdefault("frequent", frequent(*a)))
    monkeypatch.setattr(ngramjoin, "_bloom", lambda *a: held.setdefault("bloom", bloom(*a)))
    texts = [" ".join(f"w{k}x{j}" for j in range(40)) for k in range(30)]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate([*texts, *(t + " tail" for t in texts), None, ""])], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in ngramjoin.jaccard_components(docs).collect()}
    assert got == {k: k % 30 for k in range(60)} | {60: 60, 61: 61}
    assert held["frequent"].repeated.nbytes <= 1 << 16 and held["bloom"].nbytes <= 1 << 10


def test_pitman_yor_keeps_no_row_for_a_pair(spark, monkeypatch):
    """Counts, sweeps and scores hold pairs packed in rows of blocks and shards, so written rows don't grow with pairs."""
    texts = [" ".join(f"w{(k * 7 + j * j) % 97}" for j in range(200)) for k in range(40)]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    written, keep = [], Scratch.keep
    monkeypatch.setattr(Scratch, "keep", lambda self, df: written.append(keep(self, df)) or written[-1])
    monkeypatch.setattr(Scratch, "drop", lambda *_: None)
    assert pitmanyor.score(docs, F.lit(False)).count() == 40
    pairs = {p for t in texts for p in zip([None, *t.split()], [*t.split(), None], strict=True)}
    assert max(x.count() for x in written) < len(pairs) / 4


def test_packed_pairs():
    u = np.array([0, 0, 3, 3, 1 << 63, (1 << 64) - 1], np.uint64)
    w = np.array([5, 1 << 63, 5, (1 << 64) - 1, 2, 0], np.uint64)
    a, b = pitmanyor._unpack_pairs(*pitmanyor._pack_pairs(u, w))
    assert (a == u).all() and (b == w).all()
    assert all((pitmanyor.unpack(pitmanyor.pack(x)) == x).all() for x in (u, w, u[:0], np.zeros(3, np.uint64)))
    assert all(len(x) == 0 for x in pitmanyor._unpack_pairs(*pitmanyor._pack_pairs(u[:0], w[:0])))


def test_mean_tables_like_seats():
    values, rng = np.array([1, 2, 5, 33, 50, 400]), np.random.default_rng(2)
    got = pitmanyor.mean_tables(values, 0.7, 0.6, rng, 4096)
    want = [pitmanyor.seat(np.full(4096, c), np.full(4096, 0.7), 0.6, rng).mean() for c in values]
    assert np.allclose(got, want, rtol=0.04), (got, want)
