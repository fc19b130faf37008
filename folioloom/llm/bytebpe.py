"""Byte-level BPE encoding and decoding, with merges taken from a queue of ranks.

A text is cut into pre-tokens by a pattern, and each is merged on its own: of all
neighbouring pairs whose joined bytes are in the table of ranks the lowest rank
goes first, and of equal ranks the leftmost.  ``Ranks`` keeps a pre-token as a
linked list of places.  ``RankQueue`` has a bucket for every rank, which holds the
places of the pairs of that rank, and a bitmap in levels of 64 bits over the
buckets: the first set bit of each level leads to the next rank in as many steps
as there are levels.  A place whose pair has changed since is skipped
when it is met.  A pre-token of n bytes so takes about n steps, however long it
is and however many ranks there are.

Texts don't meet each other: each task encodes its own rows, and what is the same
everywhere, the ranks, is as large as the tokenizer's file.  Nothing is shuffled.
A worker keeps the ids of pre-tokens it has met, up to ``LOCAL_WORDS`` of up to
``LOCAL_CHARS`` characters; past that it begins anew.  New ones go into one linked
list together, parted by places that join with nothing.  Long texts are cut where
a pre-token ends in any case, before white space that follows something else.

The patterns' classes are taken as the library that defines them has them: where
its tables of characters differ from the ones here, a stand-in of the right class
is put in before splitting.

Defined cases: null and empty texts have no ids and decode to nothing; strings of
special tokens are ordinary text; repeated rows get equal results; of the input's
own columns, ``ids`` and ``decoded`` are replaced.  Ids that are not in the table
are an error in ``decode``; a null list decodes to null.
"""

from __future__ import annotations

import base64
import hashlib
import sys
from array import array
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textscan
from .common import small_batches

#: Pre-tokens a worker remembers, and the characters of the longest of them.
LOCAL_WORDS, LOCAL_CHARS = 1_000_000, 128
#: Characters that are split at a time, and pre-tokens that are looked up at a time.
SPLIT_CHARS, RUN_WORDS = 1 << 20, 1 << 18

_CUT = regex.compile(r"(?<=\S)(?=\s)")


class RankQueue:
    """Buckets of places by rank; a bitmap in levels says which have any, so that the lowest rank comes out first."""

    def __init__(self, ranks: int) -> None:
        self.levels: list[list[int]] = []
        while not self.levels or ranks > 1:
            ranks = (ranks + 63) >> 6
            self.levels.append([0] * ranks)
        self.buckets: dict[int, list[int]] = {}

    def __bool__(self) -> bool:
        return self.levels[-1][0] != 0

    def open(self, rank: int, places: list[int]) -> None:
        """A bucket for a rank that has none."""
        self.buckets[rank] = places
        for level in self.levels:
            k, bit = rank >> 6, rank & 63
            before = level[k]
            level[k] = before | 1 << bit
            if before:
                return
            rank = k

    def pop(self) -> tuple[int, list[int]]:
        """The lowest rank and its places, which leave the queue."""
        rank = 0
        for level in reversed(self.levels):
            bits = level[rank]
            rank = rank << 6 | (bits & -bits).bit_length() - 1
        k = rank
        for level in self.levels:
            k, bit = k >> 6, k & 63
            level[k] &= ~(1 << bit)
            if level[k]:
                break
        return rank, self.buckets.pop(rank)


def _classes(pattern: str) -> dict[int, str]:
    """Stand-ins for characters that the defining library puts into another class than ``regex`` does."""
    import tiktoken

    every = "".join(map(chr, (*range(0xD800), *range(0xE000, sys.maxunicode + 1))))
    single = {bytes([k]): k for k in range(256)}

    def found(of: str) -> set[str]:
        return set(bytes(tiktoken.Encoding("classes", pat_str=of, mergeable_ranks=single, special_tokens={}).encode_ordinary(every)).decode())

    out: dict[int, str] = {}
    theirs = {of: found(of) for of in (r"\p{L}", r"\p{N}", r"\s")}
    for of, there in theirs.items():
        for c in there ^ set(regex.findall(of, every)):
            out[ord(c)] = next((x for x, k in (("ж", r"\p{L}"), ("7", r"\p{N}"), ("\t", r"\s")) if c in theirs[k]), "§")
    return out


class Ranks:
    """A table of ranks with its pattern: encodes texts to packed ids, decodes ids to bytes."""

    def __init__(self, lines: bytes, pattern: str, odd: dict[int, str] | None = None) -> None:
        self.lines, self.pattern = lines, pattern
        self.odd = _classes(pattern) if odd is None else odd
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines.splitlines()) if a}
        if any(bytes([k]) not in self.ranks for k in range(256)):
            raise ValueError("this table has no ids for some single bytes")
        self.pieces: list[bytes | None] = [None] * (max(self.ranks.values()) + 1)
        for piece, k in self.ranks.items():
            self.pieces[k] = piece
        self.split = regex.compile(pattern)
        self.strange = np.zeros(sys.maxunicode + 1, bool)
        self.strange[list(self.odd)] = True
        self.queue = RankQueue(len(self.pieces))
        self.known: dict[str, bytes] = {}
        # What parts pre-tokens has a number of its own; pairs are numbers of two tokens.
        self.none, self.shift = len(self.pieces), len(self.pieces).bit_length()
        self.single = np.array([self.ranks[bytes([k])] for k in range(256)])
        self.of_bytes = np.full((256, 256), -1, np.int64)
        self.joins: dict[int, int] = {}
        for piece, k in self.ranks.items():
            if len(piece) == 2:
                self.of_bytes[piece[0], piece[1]] = k
            for cut in range(1, len(piece)):
                a, b = self.ranks.get(piece[:cut]), self.ranks.get(piece[cut:])
                if a is not None and b is not None:
                    self.joins[a << self.shift | b] = k

    def __reduce__(self):
        return Ranks, (self.lines, self.pattern, self.odd)

    def merged(self, pieces: list[bytes]) -> list[np.ndarray]:
        """The ids of each pre-token.  All lie in one linked list, parted by places that join with nothing."""
        whole = [self.ranks.get(p) for p in pieces]
        some = [p for p, w in zip(pieces, whole, strict=True) if w is None]
        found = iter(self._merged(some))
        return [next(found) if w is None else np.array([w], np.uint32) for w in whole]

    def _merged(self, pieces: list[bytes]) -> list[np.ndarray]:
        if not pieces:
            return []
        sizes = np.array([len(p) for p in pieces])
        ends = np.cumsum(sizes + 1)
        raw = np.frombuffer(b"\0".join(pieces) + b"\0", np.uint8)
        first = self.single[raw]
        first[ends - 1] = self.none
        start = np.full(len(raw), -1, np.int64)
        inside = np.flatnonzero(first[:-1] != self.none)
        inside = inside[first[inside + 1] != self.none]
        start[inside] = self.of_bytes[raw[inside], raw[inside + 1]]
        queue, buckets, n = self.queue, self.queue.buckets, len(raw)
        some = np.flatnonzero(start >= 0)
        some = some[np.argsort(start[some], kind="stable")]
        cuts = np.flatnonzero(np.diff(start[some])) + 1
        for places in np.split(some, cuts) if len(some) else []:
            queue.open(int(start[places[0]]), places.tolist())
        # Lists are faster, arrays of numbers smaller.
        held = (lambda x: x.tolist()) if n < SPLIT_CHARS else (lambda x: array("i", x.astype(np.int32).tobytes()))
        token, pair = held(first), held(start)
        after, before = held(np.arange(1, n + 1)), held(np.arange(-1, n - 1))
        join, shift = self.joins.get, self.shift
        while queue:
            rank, bucket = queue.pop()
            bucket.sort()
            lower = rank
            for at, k in enumerate(bucket):
                if pair[k] != rank:  # its pair has changed, or it is in another token
                    continue
                gone = after[k]
                end = after[k] = after[gone]
                before[end] = k
                token[k], token[gone], pair[gone] = rank, -1, -1
                new = pair[k] = join(rank << shift | token[end], -1)
                if new >= 0:
                    if new in buckets:
                        buckets[new].append(k)
                    else:
                        queue.open(new, [k])
                    if new < lower:
                        lower = new
                k = before[k]
                if k >= 0:
                    new = pair[k] = join(token[k] << shift | rank, -1)
                    if new >= 0:
                        if new in buckets:
                            buckets[new].append(k)
                        else:
                            queue.open(new, [k])
                        if new < lower:
                            lower = new
                if lower < rank:  # the rest of the bucket waits
                    if at + 1 < len(bucket):
                        queue.open(rank, bucket[at + 1 :])
                    break
        left = np.array(token, np.int64)
        real = (left >= 0) & (left != self.none)
        return np.split(left[real].astype(np.uint32), np.cumsum(real)[ends - 1][:-1])

    def words(self, text: str):
        """The text's pre-tokens, in lists."""
        start = 0
        while start < len(text):
            cut = _CUT.search(text, start + SPLIT_CHARS) if start + SPLIT_CHARS < len(text) else None
            end = cut.start() if cut else len(text)
            some = text[start:end]
            if not some.isascii() and self.strange[np.frombuffer(some.encode("utf-32-le"), np.uint32)].any():
                yield [some[m.start() : m.end()] for m in self.split.finditer(some.translate(self.odd))]
            else:
                yield self.split.findall(some)
            start = end

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit numbers."""
        parts: list[list[bytes]] = [[] for _ in texts]
        met: list[tuple[int, list[str]]] = []
        n = 0
        for k, text in enumerate(texts):
            for some in self.words(text or ""):
                met.append((k, some))
                n += len(some)
                if n >= RUN_WORDS:
                    self._put(met, parts)
                    met, n = [], 0
        self._put(met, parts)
        return [b"".join(x) for x in parts]

    def _put(self, met: list[tuple[int, list[str]]], parts: list[list[bytes]]) -> None:
        known = self.known
        new = list(set().union(*(some for _, some in met)).difference(known))
        known.update(zip(new, (x.astype("<u4").tobytes() for x in self.merged([w.encode() for w in new])), strict=True))
        for k, some in met:
            parts[k].append(b"".join(map(known.__getitem__, some)))
        if len(known) > LOCAL_WORDS:
            known.clear()
        for w in new:
            if len(w) > LOCAL_CHARS:
                known.pop(w, None)

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids))


def _over(rows: DataFrame, path: str, pattern: str, kept: list[str], value, schema, out) -> DataFrame:
    """The kept columns and what ``out`` makes of (ranks, values), slice by slice."""
    spark = rows.sparkSession
    small_batches(spark)
    with open(path, "rb") as f:
        shared = spark.sparkContext.broadcast(Ranks(f.read(), pattern))

    def run(batches):
        for batch in batches:
            for some in textscan.slices(batch, "_value") if pa.types.is_string(batch.schema.field("_value").type) else [batch]:
                yield pa.RecordBatch.from_arrays([*some.columns[:-1], *out(shared.value, some.column(some.num_columns - 1).to_pylist())], names=schema.names)

    return rows.select(*(rows[f"`{c}`"].alias(f"c{k}") for k, c in enumerate(kept)), value.alias("_value")).mapInArrow(run, schema)


def encode(docs: DataFrame, path: str, pattern: str, columns: list[str] | None = None) -> DataFrame:
    """These columns (or all), and ``ids`` and ``decoded``: the text's token ids and the bytes they decode to."""
    kept = [c for c in (docs.columns if columns is None else columns) if c not in ("ids", "decoded")]
    schema = T.StructType([*(docs.schema[c] for c in kept), T.StructField("ids", T.ArrayType(T.LongType())), T.StructField("decoded", T.BinaryType())])

    def out(ranks: Ranks, texts: list):
        ids = [np.frombuffer(x, "<u4") for x in ranks.encode(texts)]
        return [pa.array([x.astype(np.int64) for x in ids], pa.list_(pa.int64())), pa.array([ranks.decode(x.tolist()) for x in ids], pa.binary())]

    return _over(docs, path, pattern, kept, F.col("text").cast("string"), schema, out)


def decode(rows: DataFrame, path: str, pattern: str, columns: list[str] | None = None) -> DataFrame:
    """These columns (or all), and ``decoded``: the bytes of the ids in ``ids``."""
    kept = [c for c in (rows.columns if columns is None else columns) if c != "decoded"]
    schema = T.StructType([*(rows.schema[c] for c in kept), T.StructField("decoded", T.BinaryType())])

    def out(ranks: Ranks, ids: list):
        return [pa.array([None if x is None else ranks.decode(x) for x in ids], pa.binary())]

    return _over(rows, path, pattern, kept, F.col("ids"), schema, out)


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row."""
    schema = T.StructType([docs.schema["doc_id"], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])

    def out(ranks: Ranks, texts: list):
        n, ids, decoded = [], [], []
        for packed in ranks.encode(texts):
            n.append(len(packed) // 4)
            ids.append(hashlib.sha256(packed).hexdigest())
            decoded.append(hashlib.sha256(ranks.decode(np.frombuffer(packed, "<u4").tolist())).hexdigest())
        return [pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())]

    return _over(docs, path, pattern, ["doc_id"], F.col("text").cast("string"), schema, out)
