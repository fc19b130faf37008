"""Toxicity: maximum-scoring segments over token log-odds.

Weights: labelled texts, at most ``LABELLED_ROWS`` of them (a documented bound,
by a hash of the id) and one of each group that shares its smallest shingle,
give counts of words and of word beginnings by label.  A feature's weight is the
log-odds of its occurrences between the labels under a Dirichlet prior that
spreads ``PRIOR`` of the sample's size over the features by their overall rates.
A word is weighed by its most specific feature that ``COMMON`` labelled texts
have and that speaks for clean text, or for toxic text with log-odds of documents
that are ``Z`` standard errors from zero: the word, else its first 6, 5 or 4
characters.  Words of clean texts alone are weighed like all others.
Log-odds between 0 and ``LEAST`` count as none: many such words would make a
passage of any long clean text in which they are a little more frequent.

Passages: each word scores its weight, one without a weight, or with one closer
to zero from below, ``-DRIFT``.  One linear scan finds every maximal scoring segment.  Segment scores become E-values by the extreme-value law of local
scores, ``E = K n exp(-lambda S)``, where lambda solves the balance equation of
clean labelled text and K is the least that bounds its segments of every score.  A document's evidence is the sum over its segments of ``-ln P``,
where ``P = 1 - exp(-E)`` is the chance of such a segment in clean text; a
logistic curve, fitted on the same labelled rows, turns that into a probability.
Segments with P of at most ``P_MOST`` are reported as passages.

The weight table is bounded by the bound of the sample and goes to every task;
texts are read where they lie and never shuffled.  Features are known by 64-bit
hashes that are no polynomials: two given ones are alike with a chance of 2**-64.

Defined cases: null and empty texts have no evidence and get the score of a text
without segments; labels other than 0 and 1, and null ids, are not learned from;
without labels of both kinds every score is the share of toxic labels, or 0;
repeated rows get equal scores.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ngramjoin, textscan
from .common import Scratch, hash_sample

LABELLED_ROWS = 100_000
PRIOR = 0.05
Z = 4.0
LEAST = 1.5
DRIFT = 0.03
P_MOST = 0.1
THRESHOLD = 0.3
#: Word beginnings, in characters, that are features besides the whole word.
BEGINNINGS = (6, 5, 4)
#: Clean segments that tell a rate.
ENOUGH = 5
#: Steps of scores in the background's histogram, and its ends.
STEP, LOW, HIGH = 1 / 64, -16.0, 16.0
#: A feature that this many labelled documents have is common enough to decide.
COMMON = 8


def features(words: textscan.Words) -> list[np.ndarray]:
    """Hashes of each word and of its beginnings; a word no longer than a beginning repeats its own hash."""
    heads = np.flatnonzero((words.data & 0xC0) != 0x80)
    at, end = np.searchsorted(heads, words.starts), np.searchsorted(heads, words.ends)
    heads = np.append(heads, len(words.data))
    out = [words.hashes]
    for n in BEGINNINGS:
        longer = np.flatnonzero(end - at > n)
        h = words.hashes.copy()
        h[longer] = textscan._hash(words.data, words.starts[longer], heads[at[longer] + n]) ^ np.uint64(n)
        out.append(h)
    return out


class Weights:
    def __init__(self, keys: np.ndarray, weights: np.ndarray) -> None:
        order = np.argsort(keys)
        self.keys, self.weights = keys[order], weights[order]

    def of(self, words: textscan.Words) -> np.ndarray:
        """The score of each word."""
        out = np.zeros(len(words.hashes))
        open_ = np.ones(len(words.hashes), bool)
        for h in features(words):
            at, found = textscan.member(self.keys, h)
            found &= open_
            out[found] = self.weights[at[found]]
            open_ &= ~found
        return np.where(out > 0, out, np.minimum(out, -DRIFT))


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, last, score) of words with these scores, in linear time."""
    sums = np.cumsum(scores)
    places = np.flatnonzero(scores > 0)
    #: Of each segment so far: first, last, sum before it, sum through it, and the last one before it whose sum before is less.
    found: list[tuple[int, int, float, float, int]] = []
    for place, through, score in zip(places.tolist(), sums[places].tolist(), scores[places].tolist(), strict=True):
        first, before, back = place, through - score, len(found) - 1
        while True:
            while back >= 0 and found[back][2] >= before:
                back = found[back][4]
            if back < 0 or found[back][3] >= through:
                break
            first, _, before, _, earlier = found[back]
            del found[back:]
            back = earlier
        found.append((first, place, before, through, back))
    return [(a, b, r - l) for a, b, l, r, _ in found]


class Model:
    def __init__(self, weights: Weights, lam: float, k: float, curve: tuple[float, float]) -> None:
        self.weights, self.lam, self.k, self.curve = weights, lam, k, curve

    def segments(self, words: textscan.Words):
        """(text, first word, last word, score, chance in clean text) of each segment."""
        w = self.weights.of(words)
        for d in np.unique(np.searchsorted(words.first, np.flatnonzero(w > 0), side="right") - 1).tolist():
            first, last = int(words.first[d]), int(words.first[d + 1])
            for a, b, s in segments(w[first:last]):
                yield d, a, b, s, -math.expm1(-self.k * (last - first) * math.exp(-self.lam * s))

    def evidence(self, words: textscan.Words) -> np.ndarray:
        out = np.zeros(words.n_docs)
        for d, _, _, _, p in self.segments(words):
            out[d] -= math.log(max(p, 1e-300))
        return out

    def score(self, words: textscan.Words) -> np.ndarray:
        a, b = self.curve
        return 1 / (1 + np.exp(-(a + b * np.log1p(self.evidence(words)))))


def _held(docs: DataFrame, labels: DataFrame, usable: Column | None, rows: int):
    """Ids and labels to learn from, at most ``rows``."""
    known = labels.where("doc_id is not null and toxic in (0, 1)")
    known = known.where(usable) if usable is not None else known
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("long").alias("y"))
    t = hash_sample(known, rows, "doc_id").toArrow()
    ids, y = t.column(0).to_numpy(), t.column(1).to_numpy()
    order = np.argsort(ids)
    return ids[order], y[order]


def train(docs: DataFrame, labels: DataFrame, usable: Column | None = None, rows: int = LABELLED_ROWS, scratch: Scratch | None = None) -> Model:
    """The model of the labelled rows for which ``usable`` holds."""
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark)
    ids, y = _held(docs, labels, usable, rows)
    shared = spark.sparkContext.broadcast((ids, y))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def learned(batches):
        """(labels, slice) of the labelled rows."""
        ids, y = shared.value
        for batch in batches:
            at, have = textscan.member(ids, batch.column(0).fill_null(-1).to_numpy())
            have &= ~batch.column(0).is_null().to_numpy(zero_copy_only=False)
            some = np.flatnonzero(have)
            if len(some):
                batch = batch.take(pa.array(some)).append_column("y", pa.array(y[at[some]]))
                for part in textscan.slices(batch, "text"):
                    yield part.column(2).to_numpy(), part

    def signed(batches):
        for label, part in learned(batches):
            words = textscan.scan(part.column(1), textscan.ALNUM)
            grams, at = ngramjoin.shingles(words.hashes, words.first, 5)
            low = [int(grams[at[k] : at[k + 1]].min() >> np.uint64(1)) if at[k + 1] > at[k] else None for k in range(words.n_docs)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(label), pa.array(low, pa.int64())], names=["doc_id", "y", "low"])

    one = texts.mapInArrow(signed, "doc_id long, y long, low long").where("low is not null").groupBy("low", "y").agg(F.min("doc_id").alias("doc_id"))
    t = one.toArrow()  # no more rows than the bound
    ids, y = t.column("doc_id").to_numpy(), t.column("y").to_numpy()
    order = np.argsort(ids)
    ids, y = ids[order], y[order]
    n = np.bincount(y, minlength=2)
    if n.min() == 0:
        return Model(Weights(np.zeros(0, np.uint64), np.zeros(0)), 1.0, 1.0, (40.0 if n[1] else -40.0, 0.0))
    shared = spark.sparkContext.broadcast((ids, y))

    def counted(batches):
        """Of each slice, texts and occurrences by feature and label; feature 0 counts texts and words themselves."""
        for label, part in learned(batches):
            for y in (0, 1):
                words = textscan.scan(part.column(1).filter(pa.array(label == y)), textscan.ALNUM)
                f, d, c = (np.append(n, x) for n, x in zip((0, words.n_docs, len(words.hashes)), _per_text(words), strict=True))
                none = np.zeros(len(f), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (f, *((none, none, d, c) if y else (d, c, none, none)))], names=["f", "d0", "c0", "d1", "c1"])

    by = texts.mapInArrow(counted, "f long, d0 long, c0 long, d1 long, c1 long").groupBy("f").agg(*(F.sum(x).alias(x) for x in ("d0", "c0", "d1", "c1")))
    t = by.where((F.col("d0") + F.col("d1") >= COMMON) | (F.col("f") == 0)).toArrow()
    keys = t.column(0).to_numpy().view(np.uint64)
    order = np.argsort(keys)
    keys, d0, c0, d1, c1 = (x[order] for x in (keys, *(t.column(k).to_numpy() for k in range(1, 5))))

    def odds(toxic: np.ndarray, clean: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log-odds under the prior, and how many standard errors they are from zero; the totals stand first."""
        a0 = PRIOR * (toxic[0] + clean[0])
        prior = a0 * (toxic + clean) / (toxic[0] + clean[0])
        out = np.log((toxic + prior) / np.maximum(toxic[0] + a0 - toxic - prior, 1)) - np.log((clean + prior) / np.maximum(clean[0] + a0 - clean - prior, 1))
        return out[1:], (out / np.sqrt(1 / (toxic + prior) + 1 / (clean + prior)))[1:]

    z, weight = odds(d1, d0)[1], odds(c1, c0)[0]
    keep = (z >= Z) | (weight < 0)
    weights = Weights(keys[1:][keep], np.where((weight >= LEAST) | (weight < 0), weight, 0.0)[keep])
    model = Model(weights, 1.0, 1.0, (0.0, 1.0))
    shared_weights = spark.sparkContext.broadcast(weights)
    steps = int((HIGH - LOW) / STEP) + 1

    def background(batches):
        """Of clean labelled texts: words by score, and segments by score."""
        total = np.zeros((2, steps), np.int64)
        at = lambda x: np.rint((np.clip(x, LOW, HIGH) - LOW) / STEP).astype(np.int64)
        for label, part in learned(batches):
            words = textscan.scan(part.column(1).filter(pa.array(label == 0)), textscan.ALNUM)
            model = Model(shared_weights.value, 1.0, 1.0, (0.0, 1.0))
            total[0] += np.bincount(at(shared_weights.value.of(words)), minlength=steps)
            total[1] += np.bincount(at(np.array([s for _, _, _, s, _ in model.segments(words)], float)), minlength=steps)
        kind, q = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(q), pa.array(total[kind, q])], names=["kind", "q", "n"])

    rows = texts.mapInArrow(background, "kind long, q long, n long").groupBy("kind", "q").agg(F.sum("n").alias("n")).collect()  # at most two histograms
    model.lam = _lambda({LOW + r.q * STEP: r.n for r in rows if r.kind == 0})
    model.k = _k({LOW + r.q * STEP: r.n for r in rows if r.kind == 1}, sum(r.n for r in rows if r.kind == 0), model.lam)
    shared_model = spark.sparkContext.broadcast(model)

    def evidence(batches):
        for label, part in learned(batches):
            x = shared_model.value.evidence(textscan.scan(part.column(1), textscan.ALNUM))
            yield pa.RecordBatch.from_arrays([pa.array(np.round(np.log1p(x) * 64).astype(np.int64)), pa.array(label)], names=["x", "y"])

    rows = texts.mapInArrow(evidence, "x long, y long").groupBy("x", "y").count().collect()
    model.curve = _curve([(r.x / 64, r.y, r["count"]) for r in rows])
    return model


def _per_text(words: textscan.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature, texts that have it, occurrences) of these texts."""
    docs, seen = words.docs, []
    for k, h in enumerate(features(words)):
        some = np.ones(len(h), bool) if k == 0 else h != words.hashes
        seen.append((docs[some], h[some]))
    d, h = (np.concatenate(x) for x in zip(*seen, strict=True))
    order = np.lexsort([d, h])
    d, h = d[order], h[order]
    first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (d[1:] != d[:-1])])[: len(h)])
    times = np.diff(np.append(first, len(h)))
    h = h[first]
    group = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])[: len(h)])
    return h[group].view(np.int64), np.diff(np.append(group, len(h))), np.add.reduceat(times, group) if len(group) else group


def _k(segments: dict[float, int], words: int, lam: float) -> float:
    """The least K for which ``K words exp(-lambda s)`` is nowhere below the number of segments of s or more, where that is ENOUGH."""
    best, above = 0.5 / (words + 1), 0
    for s in sorted(segments, reverse=True):
        above += segments[s]
        if above >= ENOUGH:
            best = max(best, above / words * math.exp(lam * s))
    return best


def _lambda(counts: dict[float, int]) -> float:
    """Solves sum p(s) exp(lambda s) = 1 for clean text, with one more word of each score seen."""
    s = np.array(list(counts), float)
    p = np.array(list(counts.values()), float) + 1
    p /= p.sum()
    if s.max(initial=0) <= 0 or (p * s).sum() >= 0:
        return 1.0
    low, high = 1e-9, 1.0
    while (p * np.exp(np.minimum(high * s, 700))).sum() < 1:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if (p * np.exp(np.minimum(mid * s, 700))).sum() < 1 else (low, mid)
    return high


def _curve(rows: list[tuple[float, int, int]]) -> tuple[float, float]:
    """A logistic curve over the evidence, by Newton's method with a small penalty; more evidence never lowers it."""
    x, y, c = (np.array(v, float) for v in zip(*rows, (0.0, 1, 0.5), (0.0, 0, 0.5), (2.0, 1, 0.5), (2.0, 0, 0.5), strict=True))
    design, beta = np.stack([np.ones_like(x), x], axis=1), np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        grad = design.T @ (c * (y - p)) - 0.01 * beta
        step = np.linalg.solve((design * (c * p * (1 - p))[:, None]).T @ design + 0.01 * np.eye(2), grad)
        beta += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    if beta[1] < 0:
        beta = np.array([math.log((c @ y) / (c @ (1 - y))), 0.0])
    return float(beta[0]), float(beta[1])


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, predicted) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.select("doc_id").schema[0].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for part in textscan.slices(batch, "text"):
                p = shared.value.score(textscan.scan(part.column(1), textscan.ALNUM))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(p), pa.array((p >= THRESHOLD).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, score double, predicted int")


def passages(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, first_word, last_word, score, chance) of every significant passage."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.select("doc_id").schema[0].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for part in textscan.slices(batch, "text"):
                rows = [r for r in shared.value.segments(textscan.scan(part.column(1), textscan.ALNUM)) if r[4] <= P_MOST]
                d, a, b, s, e = (list(x) for x in zip(*rows, strict=True)) if rows else ([], [], [], [], [])
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(d, pa.int64())), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(s, pa.float64()), pa.array(e, pa.float64())], names=["doc_id", "first_word", "last_word", "score", "chance"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, first_word long, last_word long, score double, chance double")


def accept(docs: DataFrame, model: Model) -> DataFrame:
    """The documents whose score is under the threshold, all columns unchanged."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for part in textscan.slices(batch, "text"):
                p = shared.value.score(textscan.scan(part.column(part.schema.get_field_index("text")), textscan.ALNUM))
                yield part.filter(pa.array(p < THRESHOLD))

    return docs.mapInArrow(run, docs.schema)
