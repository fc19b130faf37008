"""Vectorised word scanning over Arrow string columns.

Texts arrive as Arrow batches, whose characters lie in one UTF-8 buffer with
offsets.  Words are found and hashed with a fixed number of NumPy passes over
that buffer, so the cost is a few nanoseconds a byte and no Python object is
made per word.  Work goes in slices of about ``SLICE_BYTES`` of text; one row is
never cut by slicing, but the hashing itself works in blocks, so a single very
long text needs only a bounded multiple of its own size.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2 << 20
#: Ranges that are hashed, and symbols that are compared, at a time, so that the arrays over them stay in a cache.
RANGES, BLOCK_SYMBOLS = 1 << 15, 1 << 16

#: A-Z to a-z, every other byte to itself.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Word bytes of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True

#: Word bytes of ``[^\x20\x09-\x0D]+``.
NONSPACE = np.ones(256, dtype=bool)
NONSPACE[[9, 10, 11, 12, 13, 32]] = False

#: Places in a word whose characters' hashes are kept in a table.
_PLACES = 64
_tables: dict[str, list] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def string_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; a null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("" if not pa.types.is_binary(texts.type) else b"")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    kind = np.int64 if wide else np.int32
    _, offsets, data = texts.buffers()
    if offsets is None or len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    at = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def release() -> None:
    """Gives memory that is free in this process back to the system: Python workers live through many stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library than glibc
        pass


def slices(batch: pa.RecordBatch, column: str, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about ``size`` bytes of text each."""
    if batch.num_rows == 0:
        return
    _, offsets = string_buffer(batch.column(batch.schema.get_field_index(column)))
    start = 0
    while start < batch.num_rows:
        end = int(np.searchsorted(offsets, offsets[start] + size, side="right")) - 1
        end = min(max(end, start + 1), batch.num_rows)
        yield batch.slice(start, end - start)
        start = end
    release()


class Words:
    """Words of consecutive texts: byte ranges, 64-bit hashes, and the text of each."""

    __slots__ = ("data", "starts", "ends", "hashes", "first", "n_docs")

    def __init__(self, data, starts, ends, hashes, first):
        self.data, self.starts, self.ends, self.hashes = data, starts, ends, hashes
        #: Text k has words first[k] .. first[k+1]-1.
        self.first = first
        self.n_docs = len(first) - 1

    @property
    def docs(self) -> np.ndarray:
        return np.repeat(np.arange(self.n_docs), np.diff(self.first))

    def text(self, k: int) -> str:
        return self.data[self.starts[k] : self.ends[k]].tobytes().decode("utf-8", "replace")


def scan(texts: pa.Array, word_bytes: np.ndarray) -> Words:
    """Words of every text, lower-cased in A-Z only."""
    raw, offsets = string_buffer(texts)
    data = LOWER[raw]
    inside = word_bytes[data]
    n = len(data)
    if n == 0:
        none = np.zeros(0, np.int64)
        return Words(data, none, none, np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64))
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    opens = inside.copy()
    opens[1:] &= ~inside[:-1] | edge[1:n]
    closes = inside.copy()
    closes[:-1] &= ~inside[1:] | edge[1:n]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    hashes = _hash(data, starts, ends)
    return Words(data, starts, ends, hashes, np.searchsorted(starts, offsets))


def _of_place(place, symbols: np.ndarray) -> np.ndarray:
    """A 64-bit number for each (place in its word, symbol); from a table for one of the first places and symbols of a byte."""
    if np.ndim(place) == 0:
        if "z" not in _tables:
            _tables["z"] = [_numbers(np.uint64(k), np.arange(256, dtype=np.uint64)) for k in range(_PLACES)]
        if symbols.dtype == np.uint8 or not len(symbols) or symbols.max() < 256:
            return _tables["z"][place][symbols]
        place = np.uint64(place)
    return _numbers(place, symbols.astype(np.uint64))


def _numbers(place, symbols: np.ndarray) -> np.ndarray:
    return mix(mix((place << np.uint64(32) | symbols) + np.uint64(0x9E3779B97F4A7C15)))


def _hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each range: the sum of a random number for each symbol and its place, finished by ``mix``.

    Unlike a polynomial of the symbols it has no family of words that it takes
    for equal; two given words are alike with a chance of 2**-64.  Ranges are
    taken longest first, so that those with a symbol at some place are in front.
    """
    out = np.empty(len(starts), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(0, len(starts), RANGES):
            begin, size = starts[k : k + RANGES], ends[k : k + RANGES] - starts[k : k + RANGES]
            short = np.minimum(size, _PLACES).astype(np.int16)
            order = np.argsort(-short, kind="stable")
            begin, size, short = begin[order], size[order], short[order]
            sums = size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
            many = np.cumsum(np.bincount(short, minlength=_PLACES + 1)[::-1])[::-1]
            for place in range(int(short[0])):
                n = many[place + 1]
                sums[:n] += _of_place(place, data[begin[:n] + place])
            for j in range(many[_PLACES]):  # what lies beyond the table's places
                rest = data[begin[j] + _PLACES : begin[j] + size[j]]
                for at in range(0, len(rest), BLOCK_SYMBOLS):
                    piece = rest[at : at + BLOCK_SYMBOLS]
                    sums[j] += _of_place(np.arange(at, at + len(piece), dtype=np.uint64) + np.uint64(_PLACES), piece).sum()
            out[k + order] = sums
    return mix(out)


def same_text(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, other: np.ndarray, other_starts: np.ndarray, other_ends: np.ndarray) -> np.ndarray:
    """Whether the k-th range of ``data`` holds what the k-th range of ``other`` holds."""
    sizes = (ends - starts).astype(np.int64)
    same = sizes == other_ends - other_starts
    k, n = 0, len(sizes)
    total = np.concatenate([[0], np.cumsum(np.where(same, sizes, 0))])
    while k < n:
        stop = max(int(np.searchsorted(total, total[k] + BLOCK_SYMBOLS, side="right")) - 1, k + 1)
        size = np.where(same[k:stop], sizes[k:stop], 0)
        at = np.concatenate([[0], np.cumsum(size)])
        every, here, there = np.arange(at[-1]), starts[k:stop] - at[:-1], other_starts[k:stop] - at[:-1]
        wrong = np.concatenate([[0], np.cumsum(data[np.repeat(here, size) + every] != other[np.repeat(there, size) + every])])
        same[k:stop] &= wrong[at[1:]] == wrong[at[:-1]]
        k = stop
    return same


def hash_words(words: list[str]) -> np.ndarray:
    """The hashes ``scan`` gives to these words."""
    data = [w.encode() for w in words]
    ends = np.cumsum([len(x) for x in data], dtype=np.int64) if data else np.zeros(0, np.int64)
    starts = ends - np.array([len(x) for x in data], dtype=np.int64) if data else ends
    return _hash(LOWER[np.frombuffer(b"".join(data), np.uint8)], starts, ends)


def member(sorted_values: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions in sorted_values, whether found) of each wanted value."""
    if len(sorted_values) == 0:
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.searchsorted(sorted_values, wanted)
    at[at == len(sorted_values)] = 0
    return at, sorted_values[at] == wanted
