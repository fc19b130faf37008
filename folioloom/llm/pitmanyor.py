"""LM scoring by a hierarchical Pitman-Yor model.

Every token of the training text opens the context of what follows it, and the
end token that of a text's first word; each context is a restaurant, and all of
them share one parent, the root over the whole vocabulary and one class of
unknown words.  The root's base gives the unknown class ``UNKNOWN`` and the rest
to the words in equal parts, so every restaurant is a proper distribution.  No
word and no context is left out: the model grows with the text.

Seating is sampled by Gibbs, distributed: in each of ``SWEEPS`` sweeps the
customers of every (context, word) are seated anew, given the tables of their
context and the root's probability of the word as the sweep before left them
(as Newman et al., 2009, sample topics in parallel).  Tables are the customers
of the root.  The last sweep seats ``DRAWS`` times; its mean tables give the
averaged predictive probabilities.  Customers of one dish are seated one by one
up to the 32nd and then in runs of a 32nd of those seated, within which the
chance of a new table is held.

Where the data meet: texts are read once and written as blocks, each with its
distinct words and its tokens as places among them.  Words go by key: the rank of
one of the ``FREQUENT`` most frequent, whose state goes to every task, or else the
hash, whose state is met by a join.  A block's distinct pairs are dealt, packed,
to shards by context and run of words, so that a context that follows or precedes
everything needs no shard of its own size.  A shard counts its pairs and keeps
those met more than once, which are seated there in every sweep; only sums of
tables by word and by context leave it.  It tells each block, by place, the
customers and tables of the block's pairs, and the block adds up its texts.
A pair that was met once has one table and is not seated.

The probability of word w after u is p(w) * back(u) * (1 + extra(u, w)), where
p is the root's, back(u) the share that context u hands to the root, and extra is
0 for pairs that training never met.  A text's tokens and its contexts are the
same words, so a score is a sum over its words of log p + log back and over its
pairs of log (1 + extra).

Defined cases: a null or empty text is one end token; a document without an id
is in training; without training text every token is unknown with certainty;
rows that repeat an id and a text each get a row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textscan
from .common import Scratch, most_frequent

#: Words in the table that goes to every task: at most 24 bytes for each.
FREQUENT = 1 << 19
SWEEPS, DRAWS = 3, 8
STRENGTH = 1.0
UNKNOWN = 0.9
#: Tokens of a block, unless one text has more; and about as many of a shard of pairs, and of one of words.
BLOCK_TOKENS, SHARD_TOKENS, WORD_TOKENS = 1_300_000, 1_600_000, 4_000_000
#: Words of one context that stay in one shard, as a power of two of ranks; and ranks that are summed together.
RUN_BITS, RANK_BITS = 10, 15
#: Set in every word's hash, so that none is a rank.
_TOP = np.uint64(1 << 63)
END = np.uint64(0x5851F42D4C957F2D) | _TOP
_MIX = np.uint64(0x9E3779B97F4A7C15)


def pair_hash(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    """A 64-bit hash of context and word."""
    with np.errstate(over="ignore"):
        return textscan.mix(textscan.mix(u + _MIX) * np.uint64(3) + w)


def pack(values: np.ndarray) -> bytes:
    """Whole numbers as compressed planes of bytes, lowest first; planes above the highest number are left out."""
    a = np.ascontiguousarray(values).astype(np.uint64, copy=False)
    width = (int(a.max()).bit_length() + 7) // 8 if len(a) else 0
    planes = np.ascontiguousarray(a.view(np.uint8).reshape(-1, 8).T[:width]).tobytes()
    return len(a).to_bytes(8, "little") + bytes([width]) + (pa.compress(planes, "zstd", asbytes=True) if planes else b"")


def unpack(packed: bytes) -> np.ndarray:
    n, width = int.from_bytes(packed[:8], "little"), packed[8]
    out = np.zeros((n, 8), np.uint8)
    if n * width:
        raw = pa.decompress(packed[9:], n * width, "zstd", asbytes=True)
        out[:, :width] = np.frombuffer(raw, np.uint8).reshape(width, n).T
    return out.reshape(-1).view(np.uint64)


def _steps(values: np.ndarray) -> np.ndarray:
    """Each number less the one before, modulo 2**64; ``np.cumsum`` undoes it."""
    out = values.astype(np.uint64, copy=True)
    out[1:] -= values[:-1].astype(np.uint64, copy=False)
    return out


def _pack_pairs(u: np.ndarray, w: np.ndarray) -> tuple[bytes, bytes]:
    """Pairs in order: steps of contexts, and steps of words within each context."""
    steps = _steps(w)
    new = np.flatnonzero(np.concatenate([[True], u[1:] != u[:-1]])[: len(u)])
    steps[new] = w[new]
    return pack(_steps(u)), pack(steps)


def _unpack_pairs(u: bytes, w: bytes) -> tuple[np.ndarray, np.ndarray]:
    steps, sums = unpack(u), unpack(w)
    contexts = np.cumsum(steps, dtype=np.uint64)
    new = np.flatnonzero(np.concatenate([[True], steps[1:] != 0])[: len(steps)])
    words = np.cumsum(sums, dtype=np.uint64)
    return contexts, words - np.repeat(words[new] - sums[new], np.diff(np.append(new, len(steps))))


def _summed(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """(distinct keys in order, the sums of the values of each)."""
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])[: len(keys)])
    return keys[first], *(np.add.reduceat(v[order], first) if len(first) else v for v in values)


class Tokens:
    """Words and one end of consecutive texts, by hash."""

    def __init__(self, texts: pa.Array) -> None:
        words = textscan.scan(texts, textscan.NONSPACE)
        self.sizes = np.diff(words.first) + 1
        self.hashes = np.full(int(self.sizes.sum()), END, np.uint64)
        self.hashes[np.arange(len(words.hashes)) + words.docs] = words.hashes | _TOP


BLOCKS = "block long, tokens long, ids binary, missing binary, held binary, sizes binary, words binary, places binary"


def _blocks(docs: DataFrame, held_out: Column) -> DataFrame:
    """Texts in blocks; words in the order of their number in the block, then by hash."""

    def run(batches):
        held: list[tuple[pa.RecordBatch, Tokens]] = []
        k = TaskContext.get().partitionId() << 24

        def row():
            sizes, hashes = (np.concatenate([getattr(t, x) for _, t in held]) for x in ("sizes", "hashes"))
            ids, out = (pa.concat_arrays([part.column(c) for part, _ in held]) for c in (0, 2))
            words, places, many = np.unique(hashes, return_inverse=True, return_counts=True)
            order = np.lexsort([words, -many])
            at = np.empty(len(order), np.int64)
            at[order] = np.arange(len(order))
            cells = [ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False), out.to_numpy(zero_copy_only=False), sizes, _steps(words[order]), at[places]]
            return pa.RecordBatch.from_arrays([pa.array([k]), pa.array([len(hashes)]), *(pa.array([pack(x)], pa.binary()) for x in cells)], names=[x.split()[0] for x in BLOCKS.split(", ")])

        for batch in batches:
            for part in textscan.slices(batch, "text"):
                held.append((part.select(["doc_id", "text", "held"]), Tokens(part.column(1))))
                if sum(len(t.hashes) for _, t in held) >= BLOCK_TOKENS:
                    yield row()
                    held, k = [], k + 1
        if held:
            yield row()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(held_out, F.lit(False)).alias("held"))
    return rows.mapInArrow(run, BLOCKS)


class Block:
    """A row of ``_blocks``, unpacked as far as it is asked for."""

    def __init__(self, rows, k: int = 0) -> None:
        self.of = lambda name: unpack(rows.column(name)[k].as_py())
        self.block = rows.column("block")[k].as_py()
        self.words = np.cumsum(self.of("words"), dtype=np.uint64)
        self.places = self.of("places").astype(np.int64)
        self.sizes = self.of("sizes").astype(np.int64)

    @cached_property
    def taught(self) -> np.ndarray:
        """Whether each token is in training."""
        return np.repeat(self.of("held") == 0, self.sizes)

    def pairs(self, keys: np.ndarray, shards: int) -> None:
        """The distinct pairs, as places in the words by key, dealt to shards and in order of their keys within each."""
        order = np.argsort(keys)
        at = np.empty(len(order), np.int64)
        at[order] = np.arange(len(order))
        places, self.keys, self.order = at[self.places], keys[order], order
        codes, pair_of = np.unique(np.roll(places, 1) * len(keys) + places, return_inverse=True)
        u, w = codes // max(len(keys), 1), codes % max(len(keys), 1)
        with np.errstate(over="ignore"):
            shard = (textscan.mix(textscan.mix(self.keys[u] + _MIX) + (self.keys[w] >> np.uint64(RUN_BITS))) % np.uint64(shards)).astype(np.int64)
        dealt = np.argsort(shard, kind="stable")
        self.u, self.w, self.ends = u[dealt], w[dealt], np.searchsorted(shard[dealt], np.arange(shards + 1))
        at = np.empty(len(dealt), np.int64)
        at[dealt] = np.arange(len(dealt))
        self.pair_of = at[pair_of]


def _each(batches) -> Iterator[Block]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield Block(batch, k)
        textscan.release()


def _word_counts(blocks: DataFrame, shards: int) -> DataFrame:
    """(w, c): how often each word stands in training."""

    def deal(batches):
        for b in _each(batches):
            c = np.bincount(b.places[b.taught], minlength=len(b.words))
            order = np.argsort(b.words)
            order = order[c[order] > 0]
            w, c = b.words[order], c[order]
            # Words in order of their hashes: a shard is a range of them.
            part = ((w & ~_TOP) >> np.uint64(31)) * np.uint64(shards) >> np.uint64(32)
            ends = np.searchsorted(part, np.arange(shards + 1, dtype=np.uint64))
            some = np.flatnonzero(np.diff(ends))
            cut = [slice(ends[k], ends[k + 1]) for k in some]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([pack(_steps(w[x])) for x in cut], pa.binary()), pa.array([pack(c[x]) for x in cut], pa.binary())], names=["shard", "w", "c"])

    def add(t: pa.Table) -> pa.Table:
        w = np.concatenate([np.cumsum(unpack(x), dtype=np.uint64) for x in t.column("w").to_pylist()])
        w, c = _summed(w, np.concatenate([unpack(x) for x in t.column("c").to_pylist()]))
        return pa.table({"w": w.view(np.int64), "c": c.view(np.int64)})

    return blocks.select("block", "held", "sizes", "words", "places").mapInArrow(deal, "shard long, w binary, c binary").groupBy("shard").applyInArrow(add, "w long, c long")


def seat(c: np.ndarray, new: np.ndarray, d: float, rng: np.random.Generator) -> np.ndarray:
    """Tables of dishes with c customers each; ``new`` is the weight of a new table."""
    tables = (c > 0).astype(np.int64)
    some = np.flatnonzero(c > 1)
    c, new, t, k = c[some], new[some], np.ones(len(some), np.int64), 1
    while len(some):
        run = np.minimum(max(1, k >> 5), c - k)
        t = t + rng.binomial(run, new / (new + np.maximum(k - d * t, 1e-9)))
        t = np.minimum(t, c)
        k += max(1, k >> 5)
        over = c <= k
        tables[some[over]] = t[over]
        some, c, new, t = some[~over], c[~over], new[~over], t[~over]
    return tables


def discount(once: int, twice: int) -> float:
    return float(np.clip(once / (once + 2 * twice), 0.1, 0.9)) if once else 0.5


def mean_tables(values: np.ndarray, new: float, d: float, rng: np.random.Generator, draws: int) -> np.ndarray:
    """Mean tables of dishes with these numbers of customers, in order, as ``seat`` seats them: each seating of the most goes through all smaller numbers."""
    out, t, k = np.ones(len(values)), np.ones(draws, np.int64), 1
    at = int(np.searchsorted(values, 1, side="right"))
    while at < len(values):
        run, chance = max(1, k >> 5), new / (new + np.maximum(k - d * t, 1e-9))
        end = int(np.searchsorted(values, k + run, side="right"))
        out[at:end] = t.mean() + (values[at:end] - k) * chance.mean()
        t = t + rng.binomial(run, chance)
        k, at = k + run, end
    return out


def root_probabilities(values: np.ndarray, words: np.ndarray, seed: int = 11, sweeps: int = 12, burn_in: int = 4, draws: int = 4096) -> np.ndarray:
    """The root's probability of one word of each number of customers, and in the last place of the unknown class.

    ``values`` are distinct numbers of customers, in order, and ``words`` how many words
    have each; seating depends on that number alone, so ``draws`` seatings serve all.
    """
    rng = np.random.default_rng(seed)
    types, customers = int(words.sum()), int((values * words).sum())
    d = discount(int(words[values == 1].sum()), int(words[values == 2].sum()))
    base, unknown = ((1 - UNKNOWN) / types, UNKNOWN) if types else (0.0, 1.0)
    tables, total = float(types), np.zeros(len(values) + 1)
    for sweep in range(sweeps):
        t = mean_tables(values, (STRENGTH + d * tables) * base, d, rng, draws)
        tables = float((t * words).sum())
        if sweep >= burn_in:
            back = STRENGTH + d * tables
            total += np.append(values - d * t + back * base, back * unknown) / (STRENGTH + customers)
    return total / (sweeps - burn_in)


@dataclass
class Counts:
    """What training counted; of the frequent words in arrays by rank, of the others in tables."""

    blocks: DataFrame
    shards: int
    table: object  # broadcast: (hashes of the frequent words in order, the rank of each)
    hashes: np.ndarray
    c: np.ndarray
    ones: tuple[np.ndarray, np.ndarray]  # pairs that were met once, by context and by word
    rare: DataFrame  # (key, c, u, w): the same of the other words
    merged: DataFrame  # of ``_merged``
    asks: DataFrame  # (shard, key) of other words in pairs that are seated
    discount: float
    n: int
    v: int


def _keys(table, words: np.ndarray) -> np.ndarray:
    hashes, ranks = table
    at, found = textscan.member(hashes, words)
    return np.where(found, ranks[at], words) if len(hashes) else words


MERGED = "shard long, block long, places binary, counts binary, us binary, ws binary, once long, twice long"


def _merged(blocks: DataFrame, table, shards: int) -> DataFrame:
    """For each block and shard the places of the block's pairs among the shard's; for each shard, with no block, its counts and its pairs of several customers."""

    def deal(batches):
        for b in _each(batches):
            b.pairs(_keys(table.value, b.words), shards)
            c = np.bincount(b.pair_of[b.taught], minlength=len(b.u))
            some = np.flatnonzero(np.diff(b.ends))
            u, w = b.keys[b.u], b.keys[b.w]
            cut = [slice(b.ends[k], b.ends[k + 1]) for k in some]
            packed = [(*_pack_pairs(u[x], w[x]), pack(c[x])) for x in cut]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(np.full(len(some), b.block)), *(pa.array([x[k] for x in packed], pa.binary()) for k in range(3))], names=["shard", "block", "u", "w", "c"])

    def merge(t: pa.Table) -> pa.Table:
        parts = [_unpack_pairs(u, w) for u, w in zip(t.column("u").to_pylist(), t.column("w").to_pylist(), strict=True)]
        ends = np.cumsum([0] + [len(u) for u, _ in parts])
        u, w = (np.concatenate([x[k] for x in parts]) for k in range(2))
        c = np.concatenate([unpack(x) for x in t.column("c").to_pylist()])
        order = np.lexsort([w, u])
        u, w, c = u[order], w[order], c[order]
        new = np.concatenate([[True], (u[1:] != u[:-1]) | (w[1:] != w[:-1])])
        at = np.empty(len(order), np.int64)
        at[order] = np.cumsum(new) - 1
        first = np.flatnonzero(new)
        u, w, c = u[first], w[first], np.add.reduceat(c, first)
        # Pairs that stand in training are kept with their words: those met once are summed from here, the others seated.
        n, some = len(parts), c > 0
        us, ws = _pack_pairs(u[some], w[some])
        own = [[None], [None], [pack(c)], [us], [ws], [int((c == 1).sum())], [int((c == 2).sum())]]
        of_blocks = [t.column("block").to_pylist(), [pack(_steps(at[ends[k] : ends[k + 1]])) for k in range(n)], *([None] * n for _ in range(5))]
        kinds = [pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64()]
        cells = [pa.array(x + y, kind) for x, y, kind in zip(own, of_blocks, kinds, strict=True)]
        return pa.Table.from_arrays([pa.array([t.column("shard")[0].as_py()] * (n + 1), pa.int64()), *cells], names=[x.split()[0] for x in MERGED.split(", ")])

    dealt = blocks.select("block", "held", "sizes", "words", "places").mapInArrow(deal, "shard long, block long, u binary, w binary, c binary")
    return dealt.groupBy("shard").applyInArrow(merge, MERGED)


def _own(merged: DataFrame) -> DataFrame:
    return merged.where("block is null").select("shard", "counts", "us", "ws")


def _pairs_of(row) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(contexts, words, customers of a shard's training pairs, counts of all its pairs)."""
    counts, us, ws = row
    every = unpack(counts).astype(np.int64)
    return *_unpack_pairs(us, ws), every[every > 0], every


def _sums(rows: DataFrame, shards: int) -> DataFrame:
    """(key, u, w): sums by context and by word of the rows (by, keys, values), packed."""

    def deal(batches):
        for batch in batches:
            for by, keys, values in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                keys, values = np.cumsum(unpack(keys), dtype=np.uint64), unpack(values)
                part = np.where(keys < _TOP, keys >> np.uint64(RANK_BITS), (FREQUENT >> RANK_BITS) + 1 + (textscan.mix(keys) % np.uint64(shards))).astype(np.int64)
                order = np.argsort(part, kind="stable")
                some, first = np.unique(part[order], return_index=True)
                cut = np.split(order, first[1:]) if len(some) else []
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([by] * len(some), pa.int32()), pa.array([pack(_steps(keys[x])) for x in cut], pa.binary()), pa.array([pack(values[x]) for x in cut], pa.binary())], names=["part", "by", "k", "v"])

    def add(t: pa.Table) -> pa.Table:
        by = t.column("by").to_pylist()
        keys = [np.cumsum(unpack(x), dtype=np.uint64) for x in t.column("k").to_pylist()]
        values = [unpack(x).astype(np.int64) for x in t.column("v").to_pylist()]
        both = [np.concatenate([v if b == side else np.zeros(len(v), np.int64) for v, b in zip(values, by, strict=True)]) for side in range(2)]
        k, u, w = _summed(np.concatenate(keys), *both)
        return pa.table({"key": k.view(np.int64), "u": u, "w": w})

    return rows.mapInArrow(deal, "part long, by int, k binary, v binary").groupBy("part").applyInArrow(add, "key long, u long, w long")


def _side_sums(u, w, of_u, of_w) -> list[tuple[int, bytes, bytes]]:
    out = []
    for by, keys, values in ((0, u, of_u), (1, w, of_w)):
        k, v = _summed(keys, values)
        out.append((by, pack(_steps(k)), pack(v)))
    return out


def _by_rank(sums: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The sums of the frequent words, by rank."""
    found = sums.where("key >= 0").toArrow()
    out = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for k, x in enumerate(out):
        x[found.column("key").to_numpy()] = found.column(k + 1).to_numpy()
    return out


def _counts(blocks: DataFrame, scratch: Scratch) -> Counts:
    spark = blocks.sparkSession
    tokens = blocks.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    shards, word_shards = max(4, -(-tokens // SHARD_TOKENS)), max(4, -(-tokens // WORD_TOKENS))
    words = scratch.keep(_word_counts(blocks, word_shards))
    n, v = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    top, least = most_frequent(words, FREQUENT, "c")
    top = top.toArrow()
    hashes, c = top.column("w").to_numpy().view(np.uint64), top.column("c").to_numpy()
    order = np.lexsort([hashes, -c])
    hashes, c = hashes[order], c[order]
    order = np.argsort(hashes)
    table = spark.sparkContext.broadcast((hashes[order], order.astype(np.uint64)))
    merged = scratch.keep(_merged(blocks, table, shards))
    some = merged.where("block is null").agg(F.coalesce(F.sum("once"), F.lit(0)), F.coalesce(F.sum("twice"), F.lit(0))).first()

    def once(batches):
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(1, 4)), strict=True):
                u, w, c, _ = _pairs_of(row)
                one = np.ones(int((c == 1).sum()), np.int64)
                sides = _side_sums(u[c == 1], w[c == 1], one, one)
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in sides], pa.int32()), *(pa.array([x[k] for x in sides], pa.binary()) for k in (1, 2))], names=["by", "keys", "values"])

    def asked(batches):
        for batch in batches:
            for shard, *row in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                u, w, c, _ = _pairs_of(row)
                keys = np.unique(np.concatenate([u[c > 1], w[c > 1]]))
                keys = keys[keys >= _TOP]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), shard, np.int64)), pa.array(keys.view(np.int64))], names=["shard", "key"])

    own = _own(merged)
    ones = scratch.keep(_sums(own.mapInArrow(once, "by int, keys binary, values binary"), word_shards))
    rare = words.where(F.col("c") < least).withColumnRenamed("w", "key").join(ones.where("key < 0"), "key", "left")
    rare = scratch.keep(rare.select("key", "c", F.coalesce("u", F.lit(0)).alias("u"), F.coalesce("w", F.lit(0)).alias("w")))
    found = Counts(blocks, shards, table, hashes, c, _by_rank(ones, len(c)), rare, merged, scratch.keep(own.mapInArrow(asked, "shard long, key long")), discount(*some), n, v)
    scratch.drop(words, ones)
    return found


@dataclass
class Seated:
    """Tables of pairs of several customers."""

    by_rank: tuple[np.ndarray, np.ndarray]  # sums by context over all drawings, and by word of the last one
    rare: DataFrame  # (key, c, k, tables): of the other words, with the pairs that were met once
    draws: int
    tables: DataFrame | None  # (shard, counts, tables): a shard's counts and, for those above 1, the tables of all drawings


class Root:
    """The root's probabilities by number of customers."""

    def __init__(self, counts: Counts, seated: Seated) -> None:
        self.counts, self.seated = counts, seated
        self.k = counts.ones[1] + seated.by_rank[1]
        here, many = np.unique(self.k, return_counts=True)
        more = seated.rare.groupBy("k").agg(F.count("*").alias("n")).toArrow()  # at most sqrt(2 N) rows
        self.values, words = _summed(np.concatenate([here, more.column(0).to_numpy()]).astype(np.int64), np.concatenate([many, more.column(1).to_numpy()]).astype(np.int64))
        p = root_probabilities(self.values, words)
        self.of_value, self.unknown = p[:-1], float(p[-1])

    @property
    def of_rank(self) -> np.ndarray:
        return self.of_value[np.searchsorted(self.values, self.k)]

    def rare(self) -> DataFrame:
        """(key, c, p, tables) of the other words."""
        table = self.seated.rare.sparkSession.createDataFrame(pa.table({"k": pa.array(self.values, pa.int64()), "p": pa.array(self.of_value, pa.float64())}))
        return self.seated.rare.join(F.broadcast(table), "k").select("key", "c", "p", "tables")

    def rows(self) -> DataFrame:
        """(w, p) of every word."""
        top = pa.table({"w": pa.array(self.counts.hashes.view(np.int64)), "p": pa.array(self.of_rank, pa.float64())})
        return self.seated.rare.sparkSession.createDataFrame(top).union(self.rare().select("key", "p"))

    def collect(self) -> list:
        return self.rows().collect()


def _root(counts: Counts, seated: Seated) -> tuple[Root, float]:
    """(the root, its probability of the unknown class): tables of all contexts are its customers."""
    root = Root(counts, seated)
    return root, root.unknown


@dataclass
class State:
    """(c, p, back) of every word, ``back`` being the weight with which its own context opens a table: by rank, and of the others in a table."""

    c: np.ndarray
    p: np.ndarray
    back: np.ndarray
    rare: DataFrame  # (key, c, p, back)
    unknown: float


def _state(counts: Counts, seated: Seated) -> State:
    root, unknown = _root(counts, seated)
    back = STRENGTH + counts.discount * (counts.ones[0] + seated.by_rank[0] / seated.draws)
    return State(counts.c, root.of_rank, back, root.rare().select("key", "c", "p", (STRENGTH + counts.discount * F.col("tables")).alias("back")), unknown)


def _values(keys: np.ndarray, by_rank: np.ndarray, rare_keys: np.ndarray, of_rare: np.ndarray, else_: float = np.nan) -> np.ndarray:
    """A number for each key: by its rank, or as given for another word."""
    out = np.full(len(keys), else_)
    known = keys < _TOP
    out[known] = by_rank[keys[known].astype(np.int64)]
    at, found = textscan.member(rare_keys, keys)
    return np.where(found & ~known, of_rare[at], out) if len(rare_keys) else out


def _sorted_rare(t: pa.Table) -> tuple[np.ndarray, tuple[np.ndarray, ...]]:
    """Other words' keys in order, and (c, p, back) of each."""
    keys = t.column("key").to_numpy().view(np.uint64)
    order = np.argsort(keys)
    return keys[order], tuple(t.column(x).to_numpy()[order] for x in ("c", "p", "back"))


def _sweep(counts: Counts, state: State | None, scratch: Scratch, draws: int, seed: int) -> Seated:
    """Seats the customers of every pair of several; without a state each pair has one table."""
    d, spark = counts.discount, counts.blocks.sparkSession
    shared = spark.sparkContext.broadcast((state.p, state.back) if state else None)
    kind = "shard long, counts binary, tables binary, by int, keys binary, values binary"

    def run(t: pa.Table, rare: pa.Table) -> pa.Table:
        shard, *row = (t.column(k)[0].as_py() for k in range(4))
        u, w, c, _ = _pairs_of(row)
        u, w, c = u[c > 1], w[c > 1], c[c > 1]
        if shared.value is None:
            last = total = np.ones(len(c), np.int64)
        else:
            p, back = shared.value
            keys, (_, rare_p, rare_back) = _sorted_rare(rare)
            new = _values(u, back, keys, rare_back) * _values(w, p, keys, rare_p)
            # A sweep that is repeated for a lost executor seats alike only if it draws by what it seats.
            rng = np.random.default_rng([seed, shard, int(np.bitwise_xor.reduce(pair_hash(u, w))) if len(u) else 0])
            last, total = np.zeros(len(c), np.int64), np.zeros(len(c), np.int64)
            for _ in range(draws):
                last = seat(c, new, d, rng)
                total += last
        sides = _side_sums(u, w, total, last)
        cells = [[shard] * 3, [row[0], None, None], [pack(total), None, None], [None] + [x[0] for x in sides], [None] + [x[1] for x in sides], [None] + [x[2] for x in sides]]
        kinds = [pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.binary(), pa.binary()]
        return pa.Table.from_arrays([pa.array(x, y) for x, y in zip(cells, kinds, strict=True)], names=[x.split()[0] for x in kind.split(", ")])

    none = counts.asks.where("false").select("shard", "key", F.lit(0).cast("long").alias("c"), F.lit(0.0).alias("p"), F.lit(0.0).alias("back"))
    asked = counts.asks.join(state.rare, "key").select("shard", "key", "c", "p", "back") if state else none
    tables = scratch.keep(_own(counts.merged).groupBy("shard").cogroup(asked.groupBy("shard")).applyInArrow(run, kind))
    sums = scratch.keep(_sums(tables.where("by is not null").select("by", "keys", "values"), max(4, counts.shards // 2)))
    more = sums.where("key < 0").toDF("key", "more_u", "more_w")
    tables_u = F.col("u") + F.coalesce("more_u", F.lit(0)) / draws
    rare = scratch.keep(counts.rare.join(more, "key", "left").select("key", "c", (F.col("w") + F.coalesce("more_w", F.lit(0))).alias("k"), tables_u.alias("tables")))
    found = Seated(_by_rank(sums, len(counts.c)), rare, draws, tables)
    scratch.drop(sums)
    return found


@dataclass
class Model:
    words: DataFrame  # (h, c, g): log10 of the root's probability and of what the word's own context hands to the root
    answered: DataFrame  # (block, shard, counts, tables, key, c, p, back): what blocks are told of their pairs and other words
    counts: Counts
    state: object  # broadcast: (c, p, back) by rank
    unknown: float  # log10 of the unknown class
    n: int
    v: int

    @property
    def pairs(self) -> DataFrame:
        """(h, c, g) of every pair in training: log10 of what its context adds."""
        scored = self._scored()

        def run(t: pa.Table, told: pa.Table) -> pa.Table:
            b, c, _, _, of_pair = scored(t, told)
            words = b.words[b.order]
            h, kept = pair_hash(words[b.u], words[b.w]).view(np.int64), c > 0
            return pa.table({"h": h[kept], "c": c[kept], "g": of_pair[kept]})

        return self._met().applyInArrow(run, "h long, c long, g double").dropDuplicates(["h"])

    def _met(self):
        return self.counts.blocks.groupBy("block").cogroup(self.answered.groupBy("block"))

    def _scored(self):
        table, shards, state, unknown, d = self.counts.table, self.counts.shards, self.state, self.unknown, self.counts.discount

        def run(t: pa.Table, told: pa.Table):
            """(block, its pairs' counts, its words' counts, log10 of words, log10 of what pairs' contexts add); pairs and words by key."""
            b = Block(t)
            b.pairs(_keys(table.value, b.words), shards)
            rare = told.filter(pa.compute.is_valid(told.column("key")))
            keys, of_rare = _sorted_rare(rare)
            c, p, back = (_values(b.keys, x, keys, y, e) for x, y, e in zip(state.value, of_rare, (0.0, 10**unknown, STRENGTH), strict=True))
            counts, tables = np.zeros(len(b.u), np.int64), np.zeros(len(b.u))
            told = told.filter(pa.compute.is_valid(told.column("shard")))
            for shard, x, y in zip(*(told.column(k).to_pylist() for k in ("shard", "counts", "tables")), strict=True):
                at = slice(b.ends[shard], b.ends[shard + 1])
                counts[at], tables[at] = unpack(x), unpack(y) / DRAWS
            of_pair = np.log10(1 + (counts - d * tables) / (back[b.u] * p[b.w]))
            return b, counts, c, np.log10(p) + np.log10(back / (STRENGTH + c)), of_pair

        return run


def train(docs: DataFrame, held_out: Column, scratch: Scratch) -> Model:
    """Counts and seats; what it keeps is in the shared folder, in blocks and shards."""
    spark = docs.sparkSession
    counts = _counts(scratch.keep(_blocks(docs, held_out)), scratch)
    seated = _sweep(counts, None, scratch, 1, 0)
    for sweep in range(SWEEPS):
        before = seated
        seated = _sweep(counts, _state(counts, seated), scratch, DRAWS if sweep == SWEEPS - 1 else 1, sweep)
        scratch.drop(before.tables, before.rare)
    state = _state(counts, seated)
    handed = F.log10(F.col("back") / (STRENGTH + F.col("c")))
    top = pa.table({"h": pa.array(counts.hashes.view(np.int64)), "c": pa.array(counts.c, pa.int64()), "g": pa.array(np.log10(state.p) + np.log10(state.back / (STRENGTH + state.c)), pa.float64())})
    words = spark.createDataFrame(top).union(state.rare.select(F.col("key").alias("h"), "c", F.log10("p") + handed))

    def tell(t: pa.Table, asked: pa.Table) -> pa.Table:
        c = unpack(t.column("counts")[0].as_py()).astype(np.int64)
        tables = np.where(c == 1, DRAWS, 0)
        tables[c > 1] = unpack(t.column("tables")[0].as_py())
        at = [np.cumsum(unpack(x), dtype=np.uint64).astype(np.int64) for x in asked.column("places").to_pylist()]
        told = [pa.array([pack(x[k]) for k in at], pa.binary()) for x in (c, tables)]
        return pa.Table.from_arrays([asked.column("block"), asked.column("shard"), *told], names=["block", "shard", "counts", "tables"])

    places = counts.merged.where("block is not null").select("shard", "block", "places")
    mine = seated.tables.where("counts is not null").select("shard", "counts", "tables")
    told = mine.groupBy("shard").cogroup(places.groupBy("shard")).applyInArrow(tell, "block long, shard long, counts binary, tables binary")

    def others(batches):
        """A block's words that are not in the table."""
        for batch in batches:
            for block, words in zip(*(batch.column(k).to_pylist() for k in range(2)), strict=True):
                keys = _keys(counts_table.value, np.cumsum(unpack(words), dtype=np.uint64))
                keys = keys[keys >= _TOP]
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(np.full(len(keys), block, np.int64))], names=["key", "block"])

    counts_table = counts.table
    rare = counts.blocks.select("block", "words").mapInArrow(others, "key long, block long").join(state.rare, "key")
    nothing = F.lit(None).cast("long")
    told = told.select("*", nothing.alias("key"), nothing.alias("c"), *(F.lit(None).cast("double").alias(x) for x in ("p", "back")))
    answered = told.union(rare.select("block", nothing, *(F.lit(None).cast("binary") for _ in range(2)), "key", "c", "p", "back"))
    shared = spark.sparkContext.broadcast((state.c.astype(float), state.p, state.back))
    return Model(words, answered, counts, shared, float(np.log10(state.unknown)), counts.n, counts.v)


def score(docs: DataFrame, held_out: Column, scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score, held_out) of every row."""
    model = train(docs, held_out, scratch or Scratch(docs.sparkSession))
    n, v, scored = model.n, model.v, model._scored()

    def run(t: pa.Table, told: pa.Table) -> pa.Table:
        b, _, c, of_word, of_pair = scored(t, told)
        first = np.concatenate([[0], np.cumsum(b.sizes)[:-1]])
        place = np.empty(len(b.order), np.int64)
        place[b.order] = np.arange(len(b.order))
        place = place[b.places]
        sums = lambda values: np.add.reduceat(values, first)
        ids = pa.array(b.of("ids").view(np.int64), mask=b.of("missing") > 0)
        base = np.log10((c + 0.5) / (n + 0.5 * (v + 1)))
        cells = [ids, b.sizes, sums((c > 0)[place].astype(np.int64)), np.full(len(ids), n, np.int64), sums(base[place]), sums(of_word[place] + of_pair[b.pair_of]), b.of("held") > 0]
        textscan.release()
        return pa.Table.from_arrays([pa.array(x) for x in cells], names=["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score", "held_out"])

    return model._met().applyInArrow(run, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double, held_out boolean")
