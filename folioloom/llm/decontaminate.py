"""Benchmark decontamination by suffix arrays.

Each shard of the corpus, a slice of a few MB of whole texts, gets a suffix
array over its words, sorted to full depth by prefix doubling.  Every suffix of
every benchmark item is binary-searched in it, for the interval of places where
``window`` words of it stand.  Of those, places that continue a match of the
suffix before are passed over, a run of the array at a time; the others begin a
match, which is read once to its end.  So time grows with the texts and with the
words of their longest matches, not with the square of a match.

Only words of the benchmark can match, so words are replaced by ids of the
benchmark's vocabulary, others by 0, and runs of known words that are shorter
than the shortest window are left out.  Words are looked up by a 64-bit hash,
and the letters of those in a match are compared.

The corpus is never shuffled.  The benchmark is a stated query set: it goes to
the executors in blocks of at most about ``BLOCK_BYTES`` of text, a block at a
time; with several blocks each is a pass over the texts that keeps matches
alone, once for rows that repeat, and these are put together by document.

Defined cases: a null or empty text has no words and is clean; an item without
words has no suffixes; an item of fewer words than ``window`` matches as a whole;
a null item_id is listed as ``null``; repeated rows each give a row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textscan
from .common import Scratch, small_batches

WINDOW = 10
BLOCK_BYTES = 8 << 20
#: Words that are compared in one step where matches are extended.
AT_ONCE = 1 << 20

ANNOTATED = "doc_id {id}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
MATCHES = "doc_id {id}, item_id string, doc_word long, item_word long, n_words long"


class Block:
    """A block of benchmark items: their words as ids of a vocabulary, and the suffixes that are searched for."""

    def __init__(self, ids: list, texts: list[str | None], window: int = WINDOW) -> None:
        words = textscan.scan(pa.array(texts, pa.string()), textscan.ALNUM)
        self.names = ["null" if x is None else str(x) for x in ids]
        self.hashes, example, which = np.unique(words.hashes, return_index=True, return_inverse=True)
        #: The vocabulary's letters; a word's id is its place among the hashes + 1.
        sizes = words.ends[example] - words.starts[example]
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        at = np.repeat(words.starts[example] - self.starts, sizes) + np.arange(int(sizes.sum()))
        self.letters = words.data[at]
        if not textscan.same_text(words.data, words.starts, words.ends, self.letters, self.starts[which], self.ends[which]).all():
            raise ValueError("two words of the benchmark have one hash")
        counts = np.diff(words.first)
        least = np.minimum(counts, window)
        #: All items' words, one 0 after each item.
        self.words = np.zeros(len(which) + words.n_docs, np.int32)
        self.words[np.arange(len(which)) + words.docs] = which + 1
        begin = words.first[:-1] + np.arange(words.n_docs)
        many = np.where(counts > 0, counts - least + 1, 0)
        #: Of each suffix: its item, its first word's place in the item and in ``words``, and how many words must match.
        self.item = np.repeat(np.arange(words.n_docs, dtype=np.int32), many)
        self.place = (np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)).astype(np.int32)
        self.suffixes = (begin[self.item] + self.place).astype(np.int32)
        self.least = least[self.item].astype(np.int32)
        self.shortest = int(self.least.min(initial=window))


def blocks(benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> Iterator[Broadcast]:
    """The benchmark in blocks of a checked size, each sent to the executors; the driver makes one at a time.

    A block ends before the item that would make it too large; one item of more
    than ``block_bytes`` is a block of its own.
    """
    spark = benchmark.sparkSession
    small_batches(spark)
    items = benchmark.select(F.col("item_id").cast("string").alias("i"), F.col("text").cast("string").alias("t"))
    ids, texts, size = [], [], 0
    for row in items.toLocalIterator():
        n = len(row.t.encode()) if row.t else 0
        if texts and size + n > block_bytes:
            yield spark.sparkContext.broadcast(Block(ids, texts, window))
            ids, texts, size = [], [], 0
        ids.append(row.i)
        texts.append(row.t)
        size += n
    yield spark.sparkContext.broadcast(Block(ids, texts, window))


def _bisect(column: np.ndarray, low: np.ndarray, high: np.ndarray, wanted: np.ndarray, right: bool) -> np.ndarray:
    """For many queries at once: where ``wanted`` goes in column[low:high]."""
    low, high = low.copy(), high.copy()
    while (open_ := low < high).any():
        middle = (low + high) >> 1
        seen = column[np.minimum(middle, len(column) - 1)]
        up = open_ & ((seen <= wanted) if right else (seen < wanted))
        low = np.where(up, middle + 1, low)
        high = np.where(open_ & ~up, middle, high)
    return low


def suffix_array(ids: np.ndarray, members: np.ndarray, longest: int) -> np.ndarray:
    """The members, places in ``ids``, by the ids from there up to the next 0; no run is longer than ``longest``."""
    rank = ids.astype(np.int64)
    order, depth = members[np.argsort(rank[members], kind="stable")], 1
    while depth < longest:
        # Ranks by the first ``depth`` ids give those by twice as many.
        first = rank[members]
        second = np.where(members + depth < len(rank), rank[np.minimum(members + depth, len(rank) - 1)], 0)
        by = np.lexsort([second, first])
        order, first, second = members[by], first[by], second[by]
        new = np.concatenate([[1], (first[1:] != first[:-1]) | (second[1:] != second[:-1])])
        ranks = np.cumsum(new)
        rank = np.zeros(len(rank), np.int64)
        rank[order] = ranks
        if ranks[-1] == len(members):
            break
        depth *= 2
    return order


class Shard:
    """The words of some texts as ids of a block's vocabulary, and their suffix array."""

    def __init__(self, words: textscan.Words, block: Block) -> None:
        self.block = block
        at, known = textscan.member(block.hashes, words.hashes)
        # One 0 after each text ends every match.
        shift = words.docs
        self.ids = np.zeros(len(at) + words.n_docs + 1, np.int64)
        self.ids[np.arange(len(at)) + shift] = np.where(known, at + 1, 0)
        edges = np.diff(np.concatenate([[0], self.ids > 0, [0]]).astype(np.int8))
        start, stop = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        long_ = stop - start >= block.shortest
        start, stop = start[long_], stop[long_]
        self._known_only(words, start, stop)
        size = stop - start
        members = np.repeat(start - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
        members = members[self.ids[members] > 0]
        self.suffixes = suffix_array(self.ids, members, int(size.max(initial=1))) if len(members) else members
        self.doc_of = np.repeat(np.arange(words.n_docs), np.diff(words.first) + 1)
        self.begin = words.first[:-1] + np.arange(words.n_docs)

    def _known_only(self, words: textscan.Words, start: np.ndarray, stop: np.ndarray) -> None:
        """Words in long runs that have another word's hash become unknown: their letters decide."""
        size = stop - start
        at = np.repeat(start - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
        if len(at):
            doc = np.searchsorted(words.first + np.arange(len(words.first)), at, side="right") - 1
            w, v = at - doc, self.ids[at] - 1
            same = textscan.same_text(words.data, words.starts[w], words.ends[w], self.block.letters, self.block.starts[v], self.block.ends[v])
            self.ids[at[~same]] = 0

    def search(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(suffix of the block, place in the shard, words that match) of every match that is long enough and can't begin earlier."""
        b, none = self.block, np.zeros(0, np.int64)
        if not len(self.suffixes) or not len(b.suffixes):
            return none, none, none
        live = np.arange(len(b.suffixes))
        low, high = np.zeros(len(live), np.int64), np.full(len(live), len(self.suffixes), np.int64)
        whole = []
        for depth in range(int(b.least.max())):
            wanted = b.words[b.suffixes[live] + depth]
            column = self.ids[np.minimum(self.suffixes + depth, len(self.ids) - 1)]
            lo = _bisect(column, low[live], high[live], wanted, right=False)
            hi = _bisect(column, lo, high[live], wanted, right=True)
            low[live], high[live] = lo, hi
            live = live[lo < hi]
            whole.append(live[b.least[live] == depth + 1])
            live = live[b.least[live] > depth + 1]
        suffix = np.concatenate(whole)
        suffix, place = self._heads(suffix, low[suffix], high[suffix])
        return suffix, place, self._extended(suffix, place)

    def _heads(self, suffix: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(suffix, place) of all in the intervals but those where the words before are one known word.

        Neighbours in the suffix array mostly follow the same word, so whole runs of
        them are passed over at once.
        """
        b = self.block
        left = self.ids[np.maximum(self.suffixes, 1) - 1] * (self.suffixes > 0)
        new = np.concatenate([[True], left[1:] != left[:-1]])
        first, run = np.flatnonzero(new), np.cumsum(new) - 1
        stop = np.append(first[1:], len(left))
        mine = np.where(b.place[suffix] > 0, b.words[np.maximum(b.suffixes[suffix], 1) - 1], -1)
        which, k = _ranges(run[low], run[high - 1] + 1)
        other = (left[first[k]] == 0) | (left[first[k]] != mine[which])
        which, k = which[other], k[other]
        row, at = _ranges(np.maximum(first[k], low[which]), np.minimum(stop[k], high[which]))
        return suffix[which[row]], self.suffixes[at]

    def _extended(self, suffix: np.ndarray, place: np.ndarray) -> np.ndarray:
        """How many words match from each place on, each match read once, in steps that grow."""
        b = self.block
        length = b.least[suffix].astype(np.int64)
        start = b.suffixes[suffix].astype(np.int64)
        for k in range(0, len(suffix), AT_ONCE >> 4):
            live, step = np.arange(k, min(k + (AT_ONCE >> 4), len(suffix))), 8
            while len(live):
                ahead = length[live][:, None] + np.arange(step)
                mine = b.words[np.minimum(start[live][:, None] + ahead, len(b.words) - 1)]
                same = (mine > 0) & (mine == self.ids[np.minimum(place[live][:, None] + ahead, len(self.ids) - 1)])
                through = same.all(axis=1)
                length[live] += np.where(through, step, same.argmin(axis=1))
                live = live[through]
                step = min(2 * step, max(8, AT_ONCE // max(len(live), 1)))
        return length


def _ranges(first: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, number) of each number in the rows' ranges."""
    n = stop - first
    row = np.repeat(np.arange(len(n)), n)
    return row, np.arange(len(row)) + (first - np.cumsum(n) + n)[row]


def matches(words: textscan.Words, block: Block) -> tuple[np.ndarray, ...]:
    """(text, first word in it, item, first word in it, words) of every verbatim match that can't be made longer."""
    shard = Shard(words, block)
    suffix, place, length = shard.search()
    doc = shard.doc_of[place]
    return doc, place - shard.begin[doc], block.item[suffix].astype(np.int64), block.place[suffix].astype(np.int64), length


def _texts(part: pa.RecordBatch) -> pa.Array:
    return part.column(part.schema.get_field_index("text"))


def _annotated(words: textscan.Words, spans: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> np.ndarray:
    """Words of each text that lie in any of the spans (text, first word, words)."""
    change = np.zeros(len(words.hashes) + 1, np.int64)
    for doc, place, length in spans:
        np.add.at(change, words.first[doc] + place, 1)
        np.add.at(change, words.first[doc] + place + length, -1)
    sums = np.concatenate([[0], np.cumsum(np.cumsum(change[:-1]) > 0)])
    return sums[words.first[1:]] - sums[words.first[:-1]]


def _covered(spans: np.ndarray) -> int:
    """Words in any of the spans (first word, words)."""
    if not len(spans):
        return 0
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    ends = np.maximum.accumulate(spans.sum(axis=1))
    return int(np.maximum(0, ends - np.maximum(spans[:, 0], np.append(spans[0, 0], ends[:-1]))).sum())


def _batch(ids: pa.Array, n_words: np.ndarray, hit: np.ndarray, items: list[set]) -> pa.RecordBatch:
    listed = [",".join(sorted(x)) for x in items]
    return pa.RecordBatch.from_arrays(
        [
            ids,
            pa.array(n_words, pa.int64()),
            pa.array(hit, pa.int64()),
            pa.array([len(x) for x in items], pa.int64()),
            pa.array([hashlib.sha256(x.encode()).hexdigest() for x in listed], pa.string()),
            pa.array(hit > 0, pa.bool_()),
        ],
        names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
    )


def _thin(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.col("text").cast("string").alias("text"))


def _key() -> list:
    """Two independent 64-bit hashes of id and text: rows alike in both have equal matches."""
    id_, text = F.col("doc_id").cast("string"), F.col("text").cast("string")
    return [F.xxhash64(id_, text, F.lit(1)).alias("_k1"), F.xxhash64(F.lit(2), text, id_).alias("_k2")]


def _hits(docs: DataFrame, part: Broadcast) -> DataFrame:
    """(_k1, _k2, spans, items) of the documents in which a block's matches stand."""

    def run(batches):
        block = part.value
        for batch in batches:
            for some in textscan.slices(batch, "text"):
                doc, place, item, _, length = matches(textscan.scan(_texts(some), textscan.ALNUM), block)
                order = np.argsort(doc, kind="stable")
                which, first = np.unique(doc[order], return_index=True)
                cut = [order[a:b] for a, b in zip(first, [*first, len(order)][1:], strict=True)]
                rows = some.take(pa.array(which))
                spans = pa.array([np.stack([place[c], length[c]], axis=1).astype(np.int64).tobytes() for c in cut], pa.binary())
                items = pa.array([sorted({block.names[i] for i in item[c].tolist()}) for c in cut], pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), spans, items], names=["_k1", "_k2", "spans", "items"])

    return docs.select(*_key(), F.col("text").cast("string").alias("text")).mapInArrow(run, "_k1 long, _k2 long, spans binary, items array<string>")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document: its words, those inside a match, and the items that match."""
    kind = docs.select("doc_id").schema[0].dataType.simpleString()
    parts = blocks(benchmark, window, block_bytes)
    one, more = next(parts), next(parts, None)

    def run(batches):
        block = one.value
        for batch in batches:
            for part in textscan.slices(batch, "text"):
                words = textscan.scan(_texts(part), textscan.ALNUM)
                doc, place, item, _, length = matches(words, block)
                items: list[set] = [set() for _ in range(words.n_docs)]
                for d, i in zip(doc.tolist(), item.tolist(), strict=True):
                    items[d].add(block.names[i])
                yield _batch(part.column(0), np.diff(words.first), _annotated(words, [(doc, place, length)]), items)

    if more is None:
        return _thin(docs).mapInArrow(run, ANNOTATED.format(id=kind))

    scratch, found = Scratch(docs.sparkSession), None
    for part in (one, more, *parts):
        hits = scratch.keep(_hits(docs, part).dropDuplicates(["_k1", "_k2"]))  # rows alike in both have equal matches
        part.destroy()
        found = hits if found is None else found.union(hits)
    found = found.groupBy("_k1", "_k2").agg(F.collect_list("spans").alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))

    def counted(batches):
        for batch in batches:
            for part in textscan.slices(batch, "text"):
                words = textscan.scan(_texts(part), textscan.ALNUM)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array(np.diff(words.first), pa.int64())], names=["_k1", "_k2", "doc_id", "n_words"])

    def merged(batches):
        for batch in batches:
            hit, items = [], [set(x or ()) for x in batch.column(3).to_pylist()]
            for cells in batch.column(2).to_pylist():
                hit.append(_covered(np.frombuffer(b"".join(cells or ()), np.int64).reshape(-1, 2)))
            yield _batch(batch.column(0), np.asarray(batch.column(1)), np.array(hit, np.int64), items)

    rows = docs.select(*_key(), "doc_id", F.col("text").cast("string").alias("text")).mapInArrow(counted, f"_k1 long, _k2 long, doc_id {kind}, n_words long")
    joined = rows.join(found, ["_k1", "_k2"], "left").select("doc_id", "n_words", "spans", "items")
    return joined.mapInArrow(merged, ANNOTATED.format(id=kind))


def longest_matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Longest verbatim matches: where they begin in text and item, and how many words they have; a row for each."""
    kind = docs.select("doc_id").schema[0].dataType.simpleString()

    def found(part: Broadcast) -> DataFrame:
        def run(batches):
            block = part.value
            for batch in batches:
                for some in textscan.slices(batch, "text"):
                    doc, place, item, inside, length = matches(textscan.scan(_texts(some), textscan.ALNUM), block)
                    names = pa.array([block.names[i] for i in item.tolist()], pa.string())
                    yield pa.RecordBatch.from_arrays([some.column(0).take(pa.array(doc)), names, pa.array(place), pa.array(inside), pa.array(length)], names=["doc_id", "item_id", "doc_word", "item_word", "n_words"])

        return _thin(docs).mapInArrow(run, MATCHES.format(id=kind))

    parts = blocks(benchmark, window, block_bytes)
    one, more = next(parts), next(parts, None)
    if more is None:
        return found(one)
    scratch, out = Scratch(docs.sparkSession), None
    for part in (one, more, *parts):
        rows = scratch.keep(found(part))
        part.destroy()
        out = rows if out is None else out.union(rows)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents, all columns unchanged, in which nothing of the benchmark matches."""
    parts = blocks(benchmark, window, block_bytes)
    one, more = next(parts), next(parts, None)

    def run(batches):
        block = one.value
        for batch in batches:
            for part in textscan.slices(batch, "text"):
                words = textscan.scan(_texts(part), textscan.ALNUM)
                clean = np.ones(words.n_docs, bool)
                clean[matches(words, block)[0]] = False
                yield part.filter(pa.array(clean))

    if more is None:
        return docs.mapInArrow(run, docs.schema)
    scratch, gone = Scratch(docs.sparkSession), None
    for part in (one, more, *parts):
        hits = scratch.keep(_hits(docs, part).select("_k1", "_k2"))
        part.destroy()
        gone = hits if gone is None else gone.union(hits)
    gone = gone.distinct()
    k1, k2 = _key()
    return docs.join(gone, (k1 == gone["_k1"]) & (k2 == gone["_k2"]), "left_anti")
