"""BPE encoding and decoding through a table of distinct words.

The tokenizer's own steps before the merges, composing, lower-casing and
splitting by its pattern, never depend on what stands beside a word, so a text's
ids are the ids of its words in order.

1. Texts are split in Spark, in blocks of about ``BLOCK_BYTES``.  A block keeps,
   for each text, the places of its words in the block's list of distinct words.
   Words that have one hash are compared letter by letter.
2. The blocks' distinct words are dealt out by their hash, so that every distinct
   word meets itself in one task, which encodes it once.
3. The ids return to the blocks and are joined back by position; the pieces of
   the ids are joined to the distinct words by id, from the vocabulary's table of
   pieces (as large as the tokenizer's file), and the texts put together from them.

What is shuffled is one packed row for each (block, part of the words) there and
back, and the blocks' places; texts are not.  No table of words is ever in one
place: a task holds the words of its parts, and past ``LOCAL_WORDS`` begins anew.

Defined cases: null and empty texts, and texts of white space, have no ids and
decode to the empty string; the added tokens' strings in a text become their
ids, as the library does; repeated rows get equal results; of the input's own
columns, ``ids`` and ``decoded`` are replaced.
"""

from __future__ import annotations

import hashlib
import json
import sys
import unicodedata
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textscan
from .common import Scratch

#: Text of a block, and text that is split at a time.
BLOCK_BYTES, SPLIT_BYTES = 12 << 20, 2 << 20
#: Text of a block where ids go on to a table: its columns are in memory several times over, in the JVM and in Python.
WIDE_BLOCK_BYTES = 4 << 20
#: Text for each part of the distinct words, and the most parts.
PART_BYTES, PARTS = 16 << 20, 1 << 16
#: Distinct words that a task holds.
LOCAL_WORDS = 1_000_000
#: Characters that are encoded in one call, about.
CALL_CHARS = 20_000

# The pattern that the splitting below is for.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")

_SPACE, _LETTER, _NUMBER, _OTHER = range(4)
#: Of all characters, those that the library is asked about at a time.
EVERY = 1 << 14


def _every() -> str:
    return np.concatenate([np.arange(0xD800), np.arange(0xE000, sys.maxunicode + 1)]).astype("<u4").tobytes().decode("utf-32-le")


@lru_cache(1)
def _classes() -> np.ndarray:
    """White space, letter, number or other, for each code point, as the library's patterns take it."""
    from tokenizers import Regex, pre_tokenizers

    out, every = np.full(sys.maxunicode + 1, _OTHER, np.uint8), _every()
    for kind, pattern in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_SPACE, r"\s+")):
        split = pre_tokenizers.Split(Regex(pattern), "removed", invert=True)
        for k in range(0, len(every), EVERY):  # the library takes about 250 MB for all characters at once
            runs = split.pre_tokenize_str(every[k : k + EVERY])
            out[_points("".join(x for x, _ in runs))] = kind
    return out


@lru_cache(1)
def _lower() -> tuple[dict[int, str], np.ndarray]:
    """What the library lower-cases otherwise than Python does to single characters, and a flag for each code point."""
    from tokenizers import normalizers

    every, odd = _every(), {}
    for k in range(0, len(every), EVERY):
        some = every[k : k + EVERY].replace("\n", "")  # the line feed is its own
        theirs = normalizers.Lowercase().normalize_str("\n".join(some)).split("\n")
        odd |= {ord(c): low for c, low in zip(some, theirs, strict=True) if low != c.lower()}
    odd[ord("Σ")] = "σ"
    flags = np.zeros(sys.maxunicode + 1, bool)
    flags[list(odd)] = True
    return odd, flags


class Words:
    """The words of consecutive texts: where they stand in ``text``, their hashes, and the place of each text's first."""

    def __init__(self, text: str, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray, first: np.ndarray) -> None:
        self.text, self.starts, self.ends, self.hashes, self.first = text, starts, ends, hashes, first

    def strings(self, places: np.ndarray) -> list[str]:
        text = self.text
        return [text[a:b] for a, b in zip(self.starts[places].tolist(), self.ends[places].tolist(), strict=True)]


def _prepared(text: str) -> str:
    if not text.isascii():
        text = unicodedata.normalize("NFC", text)
        odd, flags = _lower()
        if flags[_points(text)].any():
            text = text.translate(odd)
    return text.lower()


class Tokenizer:
    """A tokenizer file's steps, taken apart: split, encode single words, decode."""

    def __init__(self, text: str) -> None:
        spec = json.loads(text)
        kinds = [x["type"] for x in spec["normalizer"]["normalizers"]]
        split = spec["pre_tokenizer"]["pretokenizers"][0]
        if kinds != ["NFC", "Replace", "Lowercase"] or spec["normalizer"]["normalizers"][1]["pattern"] != {"Regex": "\\s+"} or (split["behavior"], split["invert"], split["pattern"]["Regex"]) != ("Removed", True, PATTERN) or spec["decoder"] or spec["post_processor"]:
            raise ValueError("this tokenizer has other steps than composing, lower-casing and splitting into words")
        if not (suffix := spec["model"]["end_of_word_suffix"]):
            raise ValueError("this tokenizer doesn't mark the ends of words")
        self.text = text
        self.added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        pieces = {i: p for p, i in spec["model"]["vocab"].items()} | {i: p for p, i in self.added.items()}
        self.pieces = [pieces.get(i) for i in range(max(pieces) + 1)]
        self.last = np.array([p is not None and p.endswith(suffix) for p in self.pieces])
        self.special = regex.compile("(" + "|".join(map(regex.escape, self.added)) + ")") if self.added else None

    def split(self, texts: list[str]) -> Words:
        """All words of the texts."""
        marked = [k for k, t in enumerate(texts) if self.special and self.special.search(t)]
        if not marked:
            return self._plain(texts)
        # Texts with added tokens are cut at them; every cut gives a text, put together again below.
        parts, owner, special = [], [], []
        for k, t in enumerate(texts):
            for n, part in enumerate(self.special.split(t)):
                parts.append("" if n % 2 else part)
                owner.append(k)
                special.append(part if n % 2 else "")
        w = self._plain(parts)
        tail = "".join(special)
        at = np.concatenate([[0], np.cumsum([len(x) for x in special])]) + len(w.text)
        some = np.flatnonzero([bool(x) for x in special])
        hashes = textscan._hash(_points(tail), at[some] - len(w.text), at[some + 1] - len(w.text))
        part_of = np.concatenate([np.repeat(np.arange(len(parts)), np.diff(w.first)), some])
        order = np.argsort(part_of, kind="stable")
        first = np.searchsorted(np.array(owner)[part_of[order]], np.arange(len(texts) + 1))
        return Words(w.text + tail, np.concatenate([w.starts, at[some]])[order], np.concatenate([w.ends, at[some + 1]])[order], np.concatenate([w.hashes, hashes])[order], first)

    def _plain(self, texts: list[str]) -> Words:
        ready = [_prepared(t) for t in texts]
        text = "\n".join(ready) + "\n"
        points = _points(text)
        kind = _classes()[points]
        begins = np.empty(len(kind), bool)
        begins[0] = True
        np.not_equal(kind[1:], kind[:-1], out=begins[1:])
        begins |= kind == _NUMBER
        begins &= kind != _SPACE
        for p in np.flatnonzero((points == 39) & begins).tolist():
            if kind[p + 1] == _LETTER:  # an ending goes with its apostrophe, what follows begins anew
                end = next((e for e in ENDINGS if text.startswith(e, p + 1)), None)
                if end:
                    begins[p + 1] = False
                    begins[p + 1 + len(end)] = kind[p + 1 + len(end)] != _SPACE
        starts = np.flatnonzero(begins)
        stops = np.concatenate([starts, [len(kind)]])[1:]
        spaces = np.append(np.flatnonzero(kind == _SPACE), len(kind))
        ends = np.minimum(stops, spaces[np.searchsorted(spaces, starts)])
        lengths = np.fromiter(map(len, ready), np.int64, len(ready)) + 1
        return Words(text, starts, ends, textscan._hash(points, starts, ends), np.searchsorted(starts, np.concatenate([[0], np.cumsum(lengths)])))

    @lru_cache(1)
    def _model(self):
        from tokenizers import Tokenizer as Library
        from tokenizers import normalizers, pre_tokenizers

        spec = json.loads(self.text)
        spec["added_tokens"] = []
        model = Library.from_str(json.dumps(spec))
        model.normalizer = normalizers.Sequence([])
        model.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(" ", "removed"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        model.no_truncation()
        model.no_padding()
        return model

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, how many each has): words go to the library in runs, and the marked last pieces part them."""
        ids, sizes = [np.zeros(0, np.int32)], np.zeros(len(words), np.int64)
        plain = [k for k, w in enumerate(words) if w not in self.added]
        per = max(1, CALL_CHARS // 8)
        model = self._model()
        for k in range(0, len(plain), per):
            ids.append(np.array(model.encode(" ".join([words[i] for i in plain[k : k + per]]), add_special_tokens=False).ids, np.int32))
        flat = np.concatenate(ids)
        ends = np.flatnonzero(self.last[flat]) + 1
        if len(ends) != len(plain):
            raise ValueError("words and their ends don't match")
        sizes[plain] = np.diff(np.concatenate([[0], ends]))
        if len(plain) < len(words):
            at = np.concatenate([[0], np.cumsum(sizes)])
            for k, w in reversed(list(enumerate(words))):
                if w in self.added:
                    flat = np.insert(flat, at[k], self.added[w])
                    sizes[k] = 1
        return flat.astype(np.int32), sizes

    def __getstate__(self):
        return self.text

    def __setstate__(self, text: str) -> None:
        self.__init__(text)


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


#: Words of a block that are worked on at a time, so that the arrays over them stay small.
RUN = 1 << 17
#: First bytes that stand for numbers of one, two and three bytes; 255 is for those of five.
_ONE, _TWO, _THREE = 192, 240, 255


def _pack(values: np.ndarray) -> bytes:
    """Numbers from 0 below 2**32, short ones in a byte, compressed: all first bytes, then the others by their number."""
    parts: list[list[bytes]] = [[], [], [], []]
    for k in range(0, len(values), RUN):
        v = values[k : k + RUN].astype(np.int64)
        two = v - _ONE
        three = two - ((_TWO - _ONE) << 8)
        five = three >= (_THREE - _TWO) << 16
        kind = np.where(v < _ONE, 1, np.where(three < 0, 2, np.where(five, 5, 3)))
        head = np.select([kind == 1, kind == 2, kind == 3], [v, _ONE + (two >> 8), _TWO + (three >> 16)], _THREE).astype(np.uint8)
        rest = [(two[kind == 2] & 255).astype(np.uint8), (three[kind == 3] & 65535).astype("<u2"), v[kind == 5].astype("<u4")]
        for held, x in zip(parts, [head, *rest], strict=True):
            held.append(x.tobytes())
    return len(values).to_bytes(8, "little") + zlib.compress(b"".join(x for held in parts for x in held), 6)


def _unpack(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    raw = zlib.decompress(data[8:])
    head = np.frombuffer(raw, np.uint8, n)
    out = head.astype(np.uint32)
    for low, high, kind, base in ((_ONE, _TWO, "u1", _ONE), (_TWO, _THREE, "<u2", _ONE + ((_TWO - _ONE) << 8))):
        some = (head >= low) & (head < high)
        rest = np.frombuffer(raw, kind, int(some.sum()), n)
        out[some] = base + ((out[some] - low) << (8 * rest.itemsize)) + rest
        n += rest.nbytes
    out[head == _THREE] = np.frombuffer(raw, "<u4", int((head == _THREE).sum()), n)
    return out


def _pack_ids(ids: np.ndarray) -> bytes:
    """Ids as two bytes each where that is enough."""
    wide = int(bool(len(ids)) and int(ids.max()) > 65535)
    return bytes([wide]) + zlib.compress(ids.astype("<u4" if wide else "<u2").tobytes(), 6)


def _unpack_ids(data: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data[1:]), "<u4" if data[0] else "<u2").astype(np.int64)


class _Block:
    """Distinct words of consecutive slices of texts, and each text's places in them."""

    def __init__(self) -> None:
        self.size, self.words, self.hashes, self.places, self.counts, self.rows = 0, {}, [], [], [], []

    def add(self, split: Words, rows: pa.RecordBatch) -> None:
        hashes, example, which = np.unique(split.hashes, return_index=True, return_inverse=True)
        points = _points(split.text)
        same = textscan.same_text(points, split.starts, split.ends, points, split.starts[example][which], split.ends[example][which])
        place = self._places(split.strings(example), hashes)[which]
        if not same.all():  # other words of a hash that is taken
            other = np.flatnonzero(~same)
            place[other] = self._places(split.strings(other), split.hashes[other])
        self.places.append(place.astype(np.uint32))
        self.counts.append(np.diff(split.first))
        self.rows.append(rows)
        self.size += len(split.text)

    def _places(self, words: list[str], hashes: np.ndarray) -> np.ndarray:
        known, out = self.words, np.empty(len(words), np.int64)
        for k, w in enumerate(words):
            place = known.get(w)
            if place is None:
                place = known[w] = len(known)
                self.hashes.append(hashes[k])
            out[k] = place
        return out

    def packed(self, block: int, parts: int) -> pa.RecordBatch:
        """A row with the texts' places, and a row for each part of the words; the commonest words get the smallest places."""
        places = np.concatenate(self.places) if self.places else np.zeros(0, np.uint32)
        order = np.argsort(-np.bincount(places, minlength=len(self.words)), kind="stable")
        rank = np.empty(len(order), np.uint32)
        rank[order] = np.arange(len(order))
        words = list(self.words)
        part = np.array(self.hashes, np.uint64)[order] % np.uint64(parts)
        by = np.argsort(part, kind="stable")
        first = np.flatnonzero(np.concatenate([[True], part[by][1:] != part[by][:-1]])[: len(by)])
        cut = np.split(by, first[1:]) if len(by) else []
        sink = pa.BufferOutputStream()
        table = pa.Table.from_batches(self.rows)
        with pa.ipc.new_stream(sink, table.schema) as out:
            out.write_table(table)
        # How many words each part has, and which, rising in each part.
        sizes = np.array([len(c) for c in cut], np.int64)
        own = [[len(cut)], [int(part[c[0]]) for c in cut], sizes, *(np.diff(c, prepend=0) for c in cut)]
        columns = [
            [block] * (1 + len(cut)),
            [None, *(int(part[c[0]]) for c in cut)],
            [sink.getvalue().to_pybytes(), *[None] * len(cut)],
            [_pack(np.concatenate(self.counts)), *[None] * len(cut)],
            [_pack(rank[places]), *[None] * len(cut)],
            [_pack(np.concatenate(own)), *[None] * len(cut)],
            [None, *(zlib.compress("\n".join([words[k] for k in order[c]]).encode(), 6) for c in cut)],
        ]
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["block", "part", "rows", "counts", "places", "order", "words"])


SPLIT = "block long, part long, rows binary, counts binary, places binary, order binary, words binary"


def split(docs: DataFrame, kept: list[str], shared: Broadcast, parts: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents in blocks, split by a tokenizer; of their columns those in ``kept`` go along."""

    def run(batches):
        from pyspark import TaskContext

        block, made = _Block(), TaskContext.get().partitionId() << 32
        for batch in batches:
            for some in textscan.slices(batch, "_text", SPLIT_BYTES):
                block.add(shared.value.split([x or "" for x in some.column(some.num_columns - 1).to_pylist()]), some.select(list(range(some.num_columns - 1))))
                if block.size >= block_bytes:
                    row, block, made = block.packed(made, parts), _Block(), made + 1
                    textscan.release()
                    yield row
        if block.rows:
            yield block.packed(made, parts)

    return docs.select(*(docs[f"`{c}`"].alias(f"c{k}") for k, c in enumerate(kept)), F.col("text").cast("string").alias("_text")).mapInArrow(run, SPLIT)


def encode_distinct(words: DataFrame, shared: Broadcast, parts: int) -> DataFrame:
    """(block, part, ids, sizes) for each row (block, part, words): every distinct word is encoded once, in its part's task."""

    def run(batches):
        known: dict[str, int] = {}
        flat, at = np.zeros(0, np.int32), np.zeros(1, np.int64)
        for batch in batches:
            for block, part, packed in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                some = zlib.decompress(packed).decode().split("\n")
                if len(known) > LOCAL_WORDS:
                    known, flat, at = {}, np.zeros(0, np.int32), np.zeros(1, np.int64)
                if new := [w for w in some if w not in known]:
                    ids, sizes = shared.value.encode_words(new)
                    known.update(zip(new, range(len(known), len(known) + len(new)), strict=True))
                    flat, at = np.concatenate([flat, ids]), np.concatenate([at, at[-1] + np.cumsum(sizes)])
                which = np.fromiter((known[w] for w in some), np.int64, len(some))
                size = at[which + 1] - at[which]
                ids = flat[np.repeat(at[which] - np.cumsum(size) + size, size) + np.arange(int(size.sum()))]
                yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([part]), pa.array([_pack_ids(ids)], pa.binary()), pa.array([_pack(size)], pa.binary())], names=["block", "part", "ids", "sizes"])
        del known, flat, at
        textscan.release()

    return words.repartition(parts, "part").select("block", "part", "words").mapInArrow(run, "block long, part long, ids binary, sizes binary")


def _joined(left: pa.Table, right: pa.Table, pieces: pa.Array) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray, list[str]]]:
    """(rows, ids of their texts, where each text's begin, what each decodes to) of a block, in runs of about ``RUN`` words."""
    rows = pa.ipc.open_stream(left.column("rows")[0].as_py()).read_all()
    counts, places, own = (_unpack(left.column(c)[0].as_py()) for c in ("counts", "places", "order"))
    own = own.astype(np.int64)
    n = int(own[0])
    parts, many, steps = own[1 : n + 1], own[n + 1 : 2 * n + 1], own[2 * n + 1 :]
    place = {int(p): np.cumsum(x) for p, x in zip(parts, np.split(steps, np.cumsum(many)[:-1]), strict=True)} if n else {}
    none = np.zeros(0, np.int64)
    ids = np.concatenate([none, *map(_unpack_ids, right.column("ids").to_pylist())])
    sizes = np.concatenate([none, *map(_unpack, right.column("sizes").to_pylist())])
    place = np.concatenate([none, *(place[p] for p in right.column("part").to_pylist())])
    start, size = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
    start[place], size[place] = np.cumsum(sizes) - sizes, sizes
    # Pieces by id, to one string for each distinct word.
    found = pieces.take(pa.array(ids)).to_pylist()
    words = [found[a] if n == 1 else " ".join(found[a : a + n]) for a, n in zip(start.tolist(), size.tolist(), strict=True)]
    first = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
    k = 0
    while k < len(counts):
        stop = max(int(np.searchsorted(first, first[k] + RUN, side="right")) - 1, k + 1)
        some = places[first[k] : first[stop]]
        n = size[some]
        begin = np.concatenate([[0], np.cumsum(n)])
        edges = first[k : stop + 1] - first[k]
        each = list(map(words.__getitem__, some.tolist()))
        texts = [" ".join(each[a:b]) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
        yield rows.slice(k, stop - k), ids[np.repeat(start[some] - begin[:-1], n) + np.arange(begin[-1])].astype(np.int32), begin[edges], texts
        k = stop


def _encoded(docs: DataFrame, path: str, kept: list[str], schema: T.StructType, out: Callable, block_bytes: int) -> DataFrame:
    with open(path, encoding="utf-8") as f:
        tokenizer = Tokenizer(f.read())
    scratch = Scratch(docs.sparkSession)
    size = docs.agg(F.coalesce(F.sum(F.octet_length(F.col("text").cast("string"))), F.lit(0)).alias("b")).first().b
    parts = min(PARTS, max(4, -(-size // PART_BYTES)))
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer)
    blocks = scratch.keep(split(docs, kept, shared, parts, block_bytes))
    words = encode_distinct(blocks.where("part is not null").select("block", "part", "words"), shared, parts)
    pieces = docs.sparkSession.sparkContext.broadcast(pa.array(tokenizer.pieces, pa.string()))

    def join(left: pa.Table, right: pa.Table) -> pa.Table:
        # A table in pieces: each goes to the JVM as a batch of its own.
        found = pa.concat_tables([pa.table(out(*run), names=schema.names) for run in _joined(left, right, pieces.value)])
        textscan.release()
        return found

    places = blocks.where("part is null").select("block", "rows", "counts", "places", "order")
    return places.groupBy("block").cogroup(words.groupBy("block")).applyInArrow(join, schema)


def _lists(at: np.ndarray, ids: np.ndarray) -> pa.Array:
    return pa.LargeListArray.from_arrays(at, ids).cast(pa.list_(pa.int32()))


def _sha256(parts) -> pa.Array:
    return pa.array([hashlib.sha256(x).hexdigest() for x in parts], pa.string())


def encode(docs: DataFrame, path: str, columns: list[str] | None = None) -> DataFrame:
    """These columns (or all), and ``ids`` and ``decoded``: the text's token ids and what they decode to."""
    kept = [c for c in (docs.columns if columns is None else columns) if c not in ("ids", "decoded")]
    schema = T.StructType([*(docs.schema[c] for c in kept), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])
    return _encoded(docs, path, kept, schema, lambda rows, ids, at, texts: [*rows.columns, _lists(at, ids), pa.array(texts, pa.string())], WIDE_BLOCK_BYTES)


def ids_and_digests(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded_sha256) of every row: what is decoded is digested where it is put together."""
    schema = T.StructType([docs.schema["doc_id"], T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded_sha256", T.StringType())])
    return _encoded(docs, path, ["doc_id"], schema, lambda rows, ids, at, texts: [rows.column(0), pa.array(np.diff(at), pa.int64()), _lists(at, ids), _sha256(x.encode() for x in texts)], WIDE_BLOCK_BYTES)


def digests(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row."""
    schema = T.StructType([docs.schema["doc_id"], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])

    def out(rows, ids, at, texts):
        raw = ids.astype("<u4")
        return [rows.column(0), pa.array(np.diff(at), pa.int64()), _sha256(raw[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)), _sha256(x.encode() for x in texts)]

    return _encoded(docs, path, ["doc_id"], schema, out, BLOCK_BYTES)
