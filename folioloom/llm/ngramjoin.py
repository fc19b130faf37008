"""N-gram Jaccard join with several global token orders.

A document's set is its distinct word n-grams, as 64-bit hashes.  Two documents
link when ``100 * |A and B| >= percent * |A or B|``.  If they do, then under any
global order of the tokens their prefixes of ``n - ceil(n * percent / 100) + 1``
tokens share one.  So:

1. Documents with equal sets become one entity, named by a 64-bit hash of the
   set; a second, independent one proves that no two sets share a name.
2. Document frequencies of all tokens are counted in hash buckets, and the most
   frequent ones form a table of bounded size that is sent to every task.
3. Order 1 puts tokens outside that table first, by hash, then those inside by
   frequency.  Its prefixes are dealt by token; each token's entities are paired
   with one pivot only, never all with all.
4. A pair goes on if the prefixes also meet under orders 2 and 3, which are
   independent of order 1; only then are the whole sets compared.
5. Entities of one token that are still in different components are compared
   with each other; those already connected need no comparison for the result.
   A pair is made only if its sketches allow it: bits that differ between the
   parities of two sets' tokens are no more than the tokens in which they differ.

Sets hold 64-bit hashes of shingles whose word hashes are no polynomials; two
given shingles are alike with a chance of 2**-64, so one in a pair of sets of a
million shingles each with 2**-24, and it changes their overlap by one.

Any consistent order is exact, so the bounded table of frequent tokens affects
cost alone.  Texts are read in each of four narrow passes and never shuffled.

Defined cases: a null or empty text, or one without words, has an empty set and
links with nothing; a text of fewer words than n has its whole sequence as one
shingle; repeated rows link with each other; rows of a null doc_id keep a null
component unless they are linked with a row that has an id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textscan
from .common import Scratch, components, most_frequent

#: Tokens in the table of frequent ones: at most 16 bytes each for every task.
FREQUENT = 1 << 20
#: Tokens in fewer documents than this are never in it.
LEAST_DF = 8
#: A token of more documents than this is dealt out to several tasks.
SPLIT_DF = 20_000
#: Entities of one token that are compared with each other, or with as many others, in one group.
GROUP = 512
#: Bytes of text for each hash bucket of tokens.
BUCKET_BYTES = 16 << 20
#: Spots, as a power of two, of the bitmap of tokens that two documents have, and of the Bloom filter of candidates: at most 16 MB and 8 MB, less for small tables.
REPEATED_BITS, BLOOM_BITS = 27, 26

#: Bits of a set's sketch, in longs of 64.
SKETCH_LONGS = 8

COUNTED = pa.schema([("bucket", pa.int64()), ("repeated", pa.binary()), ("token", pa.list_(pa.int64())), ("df", pa.list_(pa.int64()))])

_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
_ORDERS = tuple(np.uint64(x) for x in (0, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB))


def shingles(hashes: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """All n-grams of each text, and where each text's begin; a short text has one, of all its words."""
    with np.errstate(over="ignore"):
        power = [np.uint64(1)]
        for _ in range(n):
            power.append(power[-1] * _A)
        counts = np.diff(first)
        total = len(hashes)
        grams = np.zeros(max(total - n + 1, 0), np.uint64)
        for d in range(n):
            grams += hashes[d : d + len(grams)] * power[d + 1]
        grams = textscan.mix(grams)
        have = np.where(counts >= n, counts - n + 1, (counts > 0).astype(np.int64))
        at = np.concatenate([[0], np.cumsum(have)])
        out = np.empty(at[-1], np.uint64)
        long_ = np.flatnonzero(counts >= n)
        spread = np.repeat(first[long_] - at[long_], have[long_]) + np.flatnonzero(np.repeat(counts >= n, have))
        out[np.repeat(counts >= n, have)] = grams[spread]
        for k in np.flatnonzero((counts > 0) & (counts < n)):
            some = hashes[first[k] : first[k + 1]]
            out[at[k]] = textscan.mix(np.array([np.sum(some * np.array(power[1 : len(some) + 1])) + _B * np.uint64(len(some))], np.uint64))[0]
    return out, at


class Sets:
    """The distinct n-grams of consecutive texts, sorted within each, and a name for each set."""

    def __init__(self, part: pa.RecordBatch, n: int) -> None:
        words = textscan.scan(part.column(part.schema.get_field_index("text")), textscan.NONSPACE)
        tokens, at = shingles(words.hashes, words.first, n)
        for k in range(words.n_docs):
            tokens[at[k] : at[k + 1]].sort()
        new = np.ones(len(tokens), bool)
        new[1:] = tokens[1:] != tokens[:-1]
        new[at[:-1][at[:-1] < len(tokens)]] = True
        self.tokens = tokens[new]
        self.at = np.concatenate([[0], np.cumsum(new)])[at]
        self.sizes = np.diff(self.at)
        # A set's name is a 64-bit hash that doesn't depend on the order of its tokens; a second one proves it.
        self.proofs = textscan.mix(self.sums(textscan.mix(self.tokens ^ _C))).view(np.int64)
        self.names = textscan.mix(self.sums(textscan.mix(self.tokens + _B)) * _A + self.sizes.astype(np.uint64)).view(np.int64)

    def sums(self, values: np.ndarray) -> np.ndarray:
        """The sum over each set's tokens."""
        total = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values, dtype=values.dtype)])
        return total[self.at[1:]] - total[self.at[:-1]]

    def of(self, k: int) -> np.ndarray:
        return self.tokens[self.at[k] : self.at[k + 1]]

    def distinct(self) -> np.ndarray:
        """One place of each set that isn't empty."""
        some = np.flatnonzero(self.sizes)
        return some[np.unique(self.names[some], return_index=True)[1]]


def prefix_length(n, percent: int):
    return n - -(-n * percent // 100) + 1


def _prefix(tokens: np.ndarray, order: int, percent: int) -> np.ndarray:
    """The first tokens under order 2 or 3: by a hash that is independent of the others."""
    keys = textscan.mix(tokens ^ _ORDERS[order])
    p = prefix_length(len(tokens), percent)
    return np.sort(tokens[np.argpartition(keys, p - 1)[:p]]) if p < len(tokens) else tokens


class Frequent:
    """What order 1 goes by: a bitmap of the tokens that two documents have, and the table of the most frequent ones."""

    def __init__(self, repeated: np.ndarray, tokens: np.ndarray, df: np.ndarray, bits: int) -> None:
        order = np.argsort(tokens)
        self.repeated, self.tokens, self.df, self.shift = repeated, tokens[order], df[order], np.uint64(64 - bits)
        self.spot = np.uint64(64 - int(np.log2(len(repeated) << 3)))
        hot = self.df > SPLIT_DF
        #: Token parts of very frequent tokens: part -> token.
        self.parts = {self.part(int(t), s): int(t) for t, d in zip(self.tokens[hot], self.df[hot], strict=True) for s in range(-(-int(d) // SPLIT_DF))}

    @staticmethod
    def part(key: int, s: int) -> int:
        return int(textscan.mix(np.array([(key * 31 + s + 1) & ((1 << 64) - 1)], np.uint64))[0] | np.uint64(1))

    def find(self, tokens: np.ndarray) -> np.ndarray:
        """0 for tokens of one document, 1 for tokens outside the table, else document frequencies."""
        spot = tokens >> self.spot
        out = (self.repeated[spot >> np.uint64(3)] >> (spot & np.uint64(7)).astype(np.uint8) & np.uint8(1)).astype(np.int64)
        if len(self.df):
            some = np.flatnonzero(out)
            at, found = textscan.member(self.tokens, tokens[some] >> self.shift)
            out[some[found]] = self.df[at[found]]
        return out

    def prefixes(self, sets: Sets, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """(token, set) for the first tokens of each distinct set under order 1 that other documents may have.

        Very frequent tokens are given as parts, by the set's name.
        """
        df = self.find(sets.tokens)
        p = prefix_length(sets.sizes, percent)
        alone = sets.sums((df == 0).astype(np.int64))
        tokens, owners = [], []
        for k in (k for k in sets.distinct() if alone[k] < p[k]):
            some, most = sets.of(k), df[sets.at[k] : sets.at[k + 1]]
            keys = np.minimum(most, 0xFFFFFF).astype(np.uint64) << np.uint64(40) | some >> np.uint64(24)
            first = np.argpartition(keys, p[k] - 1)[: p[k]] if p[k] < len(some) else np.arange(len(some))
            first = first[most[first] > 0]
            out = some[first]
            for i in np.flatnonzero(most[first] > SPLIT_DF):
                out[i] = self.part(int(out[i] >> self.shift), int(sets.names[k]) % -(-int(most[first[i]]) // SPLIT_DF))
            tokens.append(out)
            owners.append(np.full(len(out), k))
        return (np.concatenate(tokens), np.concatenate(owners)) if tokens else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def _frequent(texts: DataFrame, n: int, low: int, spots_bits: int, scratch: Scratch) -> Frequent:
    """Counts document frequencies by 2**low buckets of the hash, as packed arrays of ``low + 32`` bits a token; the bitmap has 2**spots_bits spots."""
    bits = low + 32

    def count(batches):
        held: list[np.ndarray] = []

        def flush():
            tokens, counts = np.unique(np.concatenate(held) >> np.uint64(64 - bits), return_counts=True)
            held.clear()
            bucket = (tokens >> np.uint64(32)).astype(np.int64)
            ends = np.searchsorted(bucket, np.arange((1 << low) + 1))
            small, counts = tokens.astype(np.uint32), np.minimum(counts, 65535).astype(np.uint16)
            some = np.flatnonzero(np.diff(ends))
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(some, pa.int64()),
                    pa.array([small[ends[b] : ends[b + 1]].tobytes() for b in some], pa.binary()),
                    pa.array([counts[ends[b] : ends[b + 1]].tobytes() for b in some], pa.binary()),
                ],
                names=["bucket", "tokens", "counts"],
            )

        size = 0
        for batch in batches:
            for part in textscan.slices(batch, "text"):
                sets = Sets(part, n)
                keep = np.zeros(len(sets.sizes), bool)
                keep[sets.distinct()] = True
                held.append(sets.tokens[np.repeat(keep, sets.sizes)])
                size += len(held[-1])
                if size > 2_000_000:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    def add(t: pa.Table) -> pa.Table:
        bucket = t.column("bucket")[0].as_py()
        tokens = np.concatenate([np.frombuffer(x, np.uint32) for x in t.column("tokens").to_pylist()])
        counts = np.concatenate([np.frombuffer(x, np.uint16) for x in t.column("counts").to_pylist()])
        order = np.argsort(tokens)
        tokens, counts = tokens[order], counts[order].astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
        df = np.add.reduceat(counts, first)
        tokens = tokens[first]
        spots = np.zeros(1 << (spots_bits - low), np.uint8)
        spots[tokens[df > 1] >> np.uint32(32 - (spots_bits - low))] = 1
        keep = df >= LEAST_DF
        keys = tokens[keep].astype(np.int64) | np.int64(bucket << 32)
        return pa.table({"bucket": [bucket], "repeated": [np.packbits(spots, bitorder="little").tobytes()], "token": [keys.tolist()], "df": [df[keep].tolist()]}, schema=COUNTED)

    packed = texts.mapInArrow(count, "bucket long, tokens binary, counts binary")
    counted = scratch.keep(packed.groupBy("bucket").applyInArrow(add, "bucket long, repeated binary, token array<long>, df array<long>"))
    rows = counted.select(F.explode(F.arrays_zip("token", "df")).alias("x")).select("x.token", "x.df")
    rows = most_frequent(rows, FREQUENT, "df")[0].toArrow()
    bitmap, step = np.zeros(1 << (spots_bits - 3), np.uint8), 1 << (spots_bits - low - 3)
    for row in counted.select("bucket", "repeated").toLocalIterator():  # at most 16 MB in all
        bitmap[row.bucket * step : (row.bucket + 1) * step] = np.frombuffer(row.repeated, np.uint8)
    scratch.drop(counted)
    return Frequent(bitmap, rows.column("token").to_numpy().astype(np.uint64), rows.column("df").to_numpy(), bits)


def _sketch(tokens: np.ndarray) -> bytes:
    """Parities of the numbers of tokens by the hash's first bits."""
    odd = np.bincount((tokens >> np.uint64(55)).astype(np.int64), minlength=64 * SKETCH_LONGS) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def _may_link(percent: int):
    """Whether the sketches of two entities allow a link: tokens on one side only are at most (1 - t) / (1 + t) of both sides' sum."""
    differ = sum((F.bit_count(F.col(f"q{k}1").bitwiseXOR(F.col(f"q{k}2"))) for k in range(SKETCH_LONGS)), F.lit(0))
    return differ * (100 + percent) <= (F.col("n1") + F.col("n2")) * (100 - percent)


def _bloom(names: DataFrame, bits: int = 1 << BLOOM_BITS) -> np.ndarray:
    """A bitmap in which the names' bits are set."""
    spots = names.select(F.explode(F.array(F.pmod("s", F.lit(bits)), F.pmod(F.shiftright("s", 32), F.lit(bits)))).alias("b"))
    words = spots.groupBy(F.shiftright("b", 3).alias("w")).agg(F.bit_or(F.expr("shiftleft(1, cast(b & 7 as int))")).alias("v")).toArrow()
    out = np.zeros(bits >> 3, np.uint8)
    out[words.column("w").to_numpy()] = words.column("v").to_numpy()
    return out


def _in_bloom(bloom: np.ndarray, names: np.ndarray) -> np.ndarray:
    bits = len(bloom) << 3
    a, b = names % bits, (names >> 32) % bits
    return ((bloom[a >> 3] >> (a & 7).astype(np.uint8)) & (bloom[b >> 3] >> (b & 7).astype(np.uint8)) & 1).astype(bool)


def jaccard_components(docs: DataFrame, n: int = 3, percent: int = 90, scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row: component_id is the smallest doc_id reachable by links."""
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark)
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = texts.schema[0].dataType.simpleString()

    size, rows = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b"), F.count("*").alias("n")).first()
    low = min(24, max(4, int(np.ceil(np.log2(size / BUCKET_BYTES + 1)))))
    # A spot for each byte of text, and 16 or more for each name, unless that is too many.
    spots_bits = min(REPEATED_BITS, max(low + 3, int(size).bit_length()))
    bloom_bits = min(BLOOM_BITS, max(10, int(16 * rows).bit_length()))
    found = _frequent(texts.select("text"), n, low, spots_bits, scratch)
    split_tokens = bool(found.parts)
    frequent = spark.sparkContext.broadcast(found)
    del found  # it is in the broadcast's file
    names = ["doc_id", "n", "s", "proof", "bucket", "t", "ss", "ns"]

    def postings(batches):
        """A row for each text, and packed rows (token, set, its size) for each bucket."""
        for batch in batches:
            for part in textscan.slices(batch, "text"):
                sets = Sets(part, n)
                none = [pa.nulls(part.num_rows, x) for x in (pa.int64(), pa.binary(), pa.binary(), pa.binary())]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets.sizes, pa.int64()), pa.array(sets.names, mask=sets.sizes == 0), pa.array(sets.proofs), *none], names=names)
                tokens, owner = frequent.value.prefixes(sets, percent)
                bucket = (textscan.mix(tokens) >> np.uint64(64 - low)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                tokens, owner, bucket = tokens[order], owner[order], bucket[order]
                ends = np.searchsorted(bucket, np.arange((1 << low) + 1))
                some = np.flatnonzero(np.diff(ends))
                none = [pa.nulls(len(some), x) for x in (part.column(0).type, pa.int64(), pa.int64(), pa.int64())]
                packed = [pa.array([x[ends[b] : ends[b + 1]].tobytes() for b in some], pa.binary()) for x in (tokens, sets.names[owner], sets.sizes[owner].astype(np.uint32))]
                yield pa.RecordBatch.from_arrays([*none, pa.array(some, pa.int64()), *packed], names=names)

    read = scratch.keep(texts.mapInArrow(postings, f"doc_id {kind}, n long, s long, proof long, bucket long, t binary, ss binary, ns binary"))
    named = read.where("bucket is null").select("doc_id", "n", "s", "proof")

    def groups(t: pa.Table) -> pa.Table:
        """Of each token that several entities have: rows (token, entity, its size, the pivot)."""
        tokens, names, sizes = (np.concatenate([np.frombuffer(x, kind) for x in t.column(c).to_pylist()]) for c, kind in (("t", np.uint64), ("ss", np.int64), ("ns", np.uint32)))
        order = np.argsort(tokens)
        tokens = tokens[order]
        same = tokens[1:] == tokens[:-1]
        parts = frequent.value.parts
        hot = np.array(list(parts), np.uint64)
        # An entity that is alone in its part may link with those of the token's other parts.
        several = np.concatenate([[False], same]) | np.concatenate([same, [False]]) | np.isin(tokens, hot)
        order, tokens = order[several], tokens[several]
        names, sizes = names[order], sizes[order]
        order = np.lexsort([names, sizes, tokens])
        tokens, names, sizes = tokens[order], names[order], sizes[order].astype(np.int64)
        new = np.concatenate([[True], (tokens[1:] != tokens[:-1]) | (names[1:] != names[:-1])])[: len(tokens)]  # copies in several partitions
        tokens, names, sizes = tokens[new], names[new], sizes[new]
        first = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]])[: len(tokens)])
        count = np.diff(np.append(first, len(tokens)))
        # The pivot is of middle size, so that most others can link with it.
        pivot = np.repeat(names[first + count // 2], count) if len(first) else names
        keep = np.repeat(count, count) > 1
        if parts:
            split = np.isin(tokens, hot)
            keep |= split
        tokens, names, sizes, pivot = tokens[keep], names[keep], sizes[keep], pivot[keep]
        whole = tokens.view(np.int64)
        if parts and split[keep].any():
            whole = np.array([parts.get(int(x), int(x)) for x in tokens], np.uint64).view(np.int64)
        return pa.table({"g": whole, "s": names, "n": sizes, "p": pivot})

    dealt = read.where("bucket is not null").select("bucket", "t", "ss", "ns")
    grouped = scratch.keep(dealt.groupBy("bucket").applyInArrow(groups, "g long, s long, n long, p long"))
    candidates = grouped.select("s").distinct()
    bloom = spark.sparkContext.broadcast(_bloom(candidates, 1 << bloom_bits))
    sketch = [f"q{k}" for k in range(SKETCH_LONGS)]

    def whole_sets(batches):
        for batch in batches:
            for part in textscan.slices(batch, "text"):
                sets = Sets(part, n)
                wanted = np.flatnonzero((sets.sizes > 0) & _in_bloom(bloom.value, sets.names))
                wanted = wanted[np.unique(sets.names[wanted], return_index=True)[1]]
                whole = [sets.of(k) for k in wanted]
                sketches = np.array([np.frombuffer(_sketch(x), np.int64) for x in whole], np.int64).reshape(-1, SKETCH_LONGS)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(sets.names[wanted]),
                        pa.array([x.tobytes() for x in whole], pa.binary()),
                        pa.array([_prefix(x, 1, percent).tobytes() for x in whole], pa.binary()),
                        pa.array([_prefix(x, 2, percent).tobytes() for x in whole], pa.binary()),
                        *(pa.array(q) for q in sketches.T),
                    ],
                    names=["s", "tokens", "p2", "p3", *sketch],
                )

    passed = texts.select("text").mapInArrow(whole_sets, "s long, tokens binary, p2 binary, p3 binary, " + ", ".join(f"{q} long" for q in sketch))
    passed = passed.join(candidates, "s", "left_semi")
    sets = scratch.keep(passed.groupBy("s").agg(*(F.any_value(c).alias(c) for c in ("tokens", "p2", "p3", *sketch))))

    pairs = grouped.where("s <> p").select(F.least("s", "p").alias("a"), F.greatest("s", "p").alias("b"))
    if split_tokens:  # the parts' pivots of one token are tied by a pivot of their own
        tops = grouped.groupBy("g").agg(F.min("p").alias("top"), F.max("p").alias("bottom")).where("top <> bottom")
        pairs = pairs.union(grouped.select("g", "p").distinct().join(tops, "g").where("p <> top").select(F.least("p", "top"), F.greatest("p", "top")))
    links = scratch.keep(_verified(pairs.distinct(), sets, percent))

    # Entities of one token whose components differ so far are compared with each other.
    roots = components(links, scratch)
    placed = grouped.select("g", "s", "n").join(roots.withColumnRenamed("node", "s"), "s", "left").withColumn("root", F.coalesce("root", "s"))
    open_ = placed.groupBy("g").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("c")).where("lo <> hi and c > 2")
    # A large group is cut into blocks; each pair of blocks is a key of the join, so no task has a whole group.
    open_ = open_.select("g", F.ceil(F.col("c") / GROUP).alias("blocks"))
    placed = placed.join(open_, "g").join(sets.select("s", *sketch), "s").withColumn("block", F.pmod(F.xxhash64("s"), F.col("blocks")))
    x, y = (placed.select("g", "block", "blocks", *(F.col(c).alias(f"{c}{k}") for c in ("s", "n", "root", *sketch))) for k in (1, 2))
    x = x.withColumn("other", F.explode(F.expr("sequence(block, blocks - 1)"))).drop("blocks")
    y = y.withColumn("other", F.col("block")).withColumn("block", F.explode(F.expr("sequence(0l, block)"))).drop("blocks")
    met = F.expr(f"(block < other or s1 < s2) and root1 <> root2 and least(n1, n2) * 100 >= greatest(n1, n2) * {percent}") & _may_link(percent)
    cross = x.join(y, ["g", "block", "other"]).where(met).select(F.least("s1", "s2").alias("a"), F.greatest("s1", "s2").alias("b")).distinct()
    links = links.union(_verified(cross.join(pairs, ["a", "b"], "left_anti"), sets, percent))

    # Links run between names, through rows without an id too; a component's id is the least id of its names.
    roots = components(links, scratch)
    for sent in (frequent, bloom):  # what follows reads written tables only
        sent.destroy()
    proved = F.when(F.min("proof") == F.max("proof"), F.lit(True)).otherwise(F.raise_error(F.lit("two different sets have one name")).cast("boolean"))
    least = named.where("s is not null").groupBy("s").agg(F.min("doc_id").alias("rep"), proved.alias("proved")).where("proved")
    least = least.join(roots, F.col("s") == F.col("node"), "left").select("s", "rep", F.coalesce("root", "s").alias("root"))
    least = least.join(least.groupBy("root").agg(F.min("rep").alias("least")), "root").select("s", "least")
    return named.join(least, "s", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"))


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of the pairs of entities, those that link: after the prefixes under orders 2 and 3, the whole sets decide."""

    def meet(batches):
        for batch in batches:
            cells = [batch.column(k).to_pylist() for k in range(2, 6)]
            keep = [
                len(np.intersect1d(np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64), assume_unique=True)) > 0
                and len(np.intersect1d(np.frombuffer(u, np.uint64), np.frombuffer(v, np.uint64), assume_unique=True)) > 0
                for p, u, q, v in zip(*cells, strict=True)
            ]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    def compare(batches):
        for batch in batches:
            keep = []
            for p, q in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                u, v = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
                both = int(textscan.member(u, v)[1].sum())
                keep.append(100 * both >= percent * (len(u) + len(v) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    heads = sets.select("s", "p2", "p3")
    near = pairs.join(heads.toDF("a", "p2a", "p3a"), "a").join(heads.toDF("b", "p2b", "p3b"), "b")
    near = near.select("a", "b", "p2a", "p3a", "p2b", "p3b").mapInArrow(meet, "a long, b long")
    body = sets.select("s", "tokens")
    both = near.join(body.toDF("a", "ta"), "a").join(body.toDF("b", "tb"), "b")
    return both.select("a", "b", "ta", "tb").mapInArrow(compare, "a long, b long")


def keep_one(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """One document, that of the smallest doc_id, of each group that links connect; all columns unchanged.

    Of rows that repeat the smallest doc_id, and of rows without an id, all stay.
    """
    found = jaccard_components(docs, n, percent)
    gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias("gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["gone"], "left_anti")
