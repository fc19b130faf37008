"""Removing repeated page margins and near-duplicate elements within documents."""

from __future__ import annotations

import hashlib
from collections import Counter
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import scratch
from ..functions import places, text

#: Shorter normal forms take part in exact comparison only.
SHORTEST = 6
BITS = 64
#: Places that are counted together, prints that one task folds over, places whose prints are compared with those kept in one task, prints that are compared at a time.
BUCKET, HEAD, PART, TILE = 4096, 65_536, 65_536, 1024
#: Character pairs whose bits a task holds.
PAIRS = 1 << 18


def margin_noise(df: DataFrame, header: float = 0.15, footer: float = 0.85, share: float = 0.25) -> DataFrame:
    """(doc_id, norm, n_pages): margin texts on two or more pages and on at least this share of a document's pages."""
    page, norm = F.col("location.page_number"), text.margin_form(F.coalesce("content", F.lit("")))
    paged = df.where(page != 0)
    pages = paged.groupBy("doc_id").agg(F.countDistinct(page).alias("_pages"))
    seen = paged.where(places.in_margin(F.col("location.bbox"), header, footer)).select("doc_id", norm.alias("norm"), page.alias("_page")).where("norm <> ''")
    seen = seen.groupBy("doc_id", "norm").agg(F.countDistinct("_page").alias("n_pages"))
    return seen.join(pages, "doc_id").where((F.col("_pages") >= 2) & (F.col("n_pages") >= 2) & (F.col("n_pages") / F.col("_pages") >= share)).select("doc_id", "norm", "n_pages")


def drop_margins(df: DataFrame, header: float = 0.15, footer: float = 0.85, share: float = 0.25) -> DataFrame:
    """Removes every margin element whose normal form is noise in its document.

    Only margin elements meet the noise; all others are read once more and pass by
    unshuffled.  The noise is written before it is used, so this runs a job when it
    is called.
    """
    noise = scratch.keep(margin_noise(df, header, footer, share).select(F.col("doc_id").alias("_doc"), F.col("norm").alias("_noise")))
    in_margin = F.coalesce(places.in_margin(F.col("location.bbox"), header, footer), F.lit(False))
    same = (F.col("doc_id") == F.col("_doc")) & (text.margin_form(F.coalesce("content", F.lit(""))) == F.col("_noise"))
    return df.where(~in_margin).unionByName(df.where(in_margin).join(noise, same, "left_anti"))


def drop_exact(df: DataFrame) -> DataFrame:
    """Keeps the first element of each normal form in a document; blank ones go."""
    norm = text.dedup_form(F.coalesce("content", F.lit("")))
    first = Window.partitionBy("doc_id", "_norm").orderBy("element_idx")
    marked = df.withColumn("_norm", norm).where("_norm <> ''").withColumn("_n", F.row_number().over(first))
    return marked.where("_n = 1").drop("_n", "_norm")


def fingerprint(content: Column) -> Column:
    """A 64-bit SimHash of character pairs, as 16 hex digits, by expressions alone.

    Every pair votes by the first 64 bits of its md5; a bit is set where more
    votes are for than against.
    """
    norm = text.dedup_form(content)
    n = F.length(norm)
    pairs = F.when(n <= 3, F.array(norm)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.substring(norm, i, F.lit(2))))
    halves = F.transform(pairs, lambda p: F.struct(*(F.conv(F.substring(F.md5(p.cast("binary")), k, 8), 16, 10).cast("long").alias(x) for k, x in ((1, "hi"), (9, "lo")))))

    def half(name: str) -> Column:
        votes = F.aggregate(
            halves,
            F.array_repeat(F.lit(0), 32),
            lambda s, h: F.transform(s, lambda v, i: v + F.call_function("shiftright", h[name], 31 - i).bitwiseAND(1).cast("int") * 2 - 1),
        )
        return F.aggregate(votes, F.lit(0).cast("long"), lambda s, v: s * 2 + (v > 0).cast("long"))

    return F.lower(F.concat(F.lpad(F.hex(half("hi")), 8, "0"), F.lpad(F.hex(half("lo")), 8, "0")))


def fingerprint_rows(df: DataFrame) -> DataFrame:
    """(doc_id, element_idx, fingerprint) of the contents that aren't blank, row by row: nothing is grouped, and a task holds bits of ``PAIRS`` pairs."""
    slim = df.select("doc_id", "element_idx", text.dedup_form(F.coalesce("content", F.lit(""))).alias("norm")).where("norm <> ''")
    kinds = {f.name: f.dataType.simpleString() for f in slim.schema}

    def run(batches):
        known = _Pairs()
        for batch in batches:
            f = pa.array([f"{int(known.fingerprint(x)):016x}" for x in batch.column(2).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), f], names=["doc_id", "element_idx", "fingerprint"])

    return slim.mapInArrow(run, f"doc_id {kinds['doc_id']}, element_idx {kinds['element_idx']}, fingerprint string")


def distance(a: Column, b: Column) -> Column:
    """Differing bits of two fingerprints of 16 hex digits."""
    word = lambda c, k: F.conv(F.substring(c, k, 8), 16, 10).cast("long")
    return (F.bit_count(word(a, 1).bitwiseXOR(word(b, 1))) + F.bit_count(word(a, 9).bitwiseXOR(word(b, 9)))).cast("int")


_PLACES = np.arange(BITS - 1, -1, -1, dtype=np.uint64)


class _Pairs:
    """The bits of character pairs, as +1 and -1, a row for each pair met so far."""

    def __init__(self) -> None:
        self.place: dict[str, int] = {}
        self.bits = np.zeros((1024, BITS), np.int32)

    def fingerprint(self, norm: str) -> np.uint64:
        pairs = {norm: 1} if len(norm) <= 3 else Counter(map(add, norm, norm[1:]))
        if len(self.place) > PAIRS:
            self.place, self.bits = {}, np.zeros((1024, BITS), np.int32)
        place = self.place
        for p in pairs:
            if p in place:
                continue
            if len(place) == len(self.bits):
                self.bits = np.concatenate([self.bits, np.zeros_like(self.bits)])
            self.bits[len(place)] = (np.uint64(int(hashlib.md5(p.encode()).hexdigest()[:16], 16)) >> _PLACES & np.uint64(1)).astype(np.int32) * 2 - 1
            place[p] = len(place)
        votes = np.fromiter(pairs.values(), np.int64, len(pairs)) @ self.bits[[place[p] for p in pairs]]
        return np.sum((votes > 0).astype(np.uint64) << _PLACES, dtype=np.uint64)


def _prints(batches):
    """(doc_id, element_idx, f, norm) of normal forms: fingerprints as whole numbers, or short forms as they are."""
    known = _Pairs()
    for batch in batches:
        norms = batch.column(2).to_pylist()
        f = [None if len(x) < SHORTEST else int(known.fingerprint(x).astype(np.int64)) for x in norms]
        short = [x if len(x) < SHORTEST else None for x in norms]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(f, pa.int64()), pa.array(short, pa.string())], names=["doc_id", "element_idx", "f", "norm"])


def _settled(prints: DataFrame, most: int) -> DataFrame:
    """(doc_id, element_idx) of the prints (doc_id, element_idx, f) that a first-come pass keeps.

    A round takes the head of each document, its first undecided prints up to
    ``HEAD``, and folds over it in one group: what stands there is far from all that
    was kept before.  What follows the head is then compared with what the head has
    kept, in groups of ``PART`` places, and only what is far from all of it goes
    into the next round.  A document that is no longer than a head is done in one.
    """
    kinds = {f.name: f.dataType.simpleString() for f in prints.schema}
    row = f"doc_id {kinds['doc_id']}, element_idx {kinds['element_idx']}, f long"

    def fold(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("element_idx").to_numpy(), kind="stable")
        f = table.column("f").to_numpy()[order].astype(np.uint64)
        held, n, kept = np.zeros(len(f), np.uint64), 0, []
        for i, h in enumerate(f):
            if not n or int(np.bitwise_count(held[:n] ^ h).min()) > most:
                held[n] = h
                n += 1
                kept.append(i)
        return table.select(["doc_id", "element_idx", "f"]).take(pa.array(order[kept], pa.int64()))

    def far(rest: pa.Table, kept: pa.Table) -> pa.Table:
        f, k = (x.column("f").to_numpy().astype(np.uint64) for x in (rest, kept))
        stays = np.ones(len(f), bool)
        for at in range(0, len(k), TILE):
            some = np.flatnonzero(stays)
            for start in range(0, len(some), TILE):
                i = some[start : start + TILE]
                stays[i] = np.bitwise_count(f[i][:, None] ^ k[at : at + TILE][None]).min(axis=1) > most
        return rest.select(["doc_id", "element_idx", "f"]).filter(pa.array(stays))

    left, out = scratch.keep(prints), None
    while True:
        bucket = F.floor(F.col("element_idx") / BUCKET)
        counts = left.groupBy("doc_id", bucket.alias("b")).agg(F.count("*").alias("n"))
        # A row for each bucket of places; the first counts as the head in any case.
        sums = counts.select("doc_id", "b", F.sum("n").over(Window.partitionBy("doc_id").orderBy("b")).alias("s"), F.min("b").over(Window.partitionBy("doc_id")).alias("first"))
        ends = sums.groupBy("doc_id").agg(F.max(F.when((F.col("s") <= HEAD) | (F.col("b") == F.col("first")), F.col("b"))).alias("end"), F.max("b").alias("last"))
        ends = scratch.keep(ends.select(F.col("doc_id").alias("_doc"), "end", "last"))
        placed = left.join(ends, F.col("doc_id").eqNullSafe(F.col("_doc")))
        kept = placed.where(bucket <= F.col("end")).select("doc_id", "element_idx", "f").groupBy("doc_id").applyInArrow(fold, row)
        long = ends.where("last > end")
        if long.isEmpty():
            return (kept if out is None else out.unionByName(kept)).select("doc_id", "element_idx")
        kept = scratch.keep(kept)
        out = kept if out is None else out.unionByName(kept)
        part = F.floor(F.col("element_idx") / PART)
        rest = placed.where(bucket > F.col("end")).select("doc_id", "element_idx", "f", part.alias("part"))
        parts = rest.select(F.col("doc_id").alias("_doc"), "part").distinct()
        sent = kept.join(parts, F.col("doc_id").eqNullSafe(F.col("_doc"))).select("_doc", F.col("part").alias("_part"), "f")
        left = scratch.keep(rest.groupBy("doc_id", "part").cogroup(sent.groupBy("_doc", "_part")).applyInArrow(far, row))


def drop_near_duplicates(df: DataFrame, most: int = 10) -> DataFrame:
    """Keeps, in document order, each element whose fingerprint is more than ``most`` bits from all kept before it.

    Blank elements go; of equal normal forms the first stays, and those shorter
    than ``SHORTEST`` are compared in no other way.  Of a document only places and
    prints are dealt out, and no task gets more of them than a head or a part, see
    ``_settled``; what is kept is joined back.  Prints are written before they are
    compared, so this runs jobs when it is called.
    """
    slim = df.select("doc_id", "element_idx", text.dedup_form(F.coalesce("content", F.lit(""))).alias("norm")).where("norm <> ''")
    kinds = {f.name: f.dataType.simpleString() for f in slim.schema}
    found = scratch.keep(slim.mapInArrow(_prints, f"doc_id {kinds['doc_id']}, element_idx {kinds['element_idx']}, f long, norm string"))
    short = found.where("f is null").groupBy("doc_id", "norm").agg(F.min("element_idx").alias("element_idx")).select("doc_id", "element_idx")
    # Of equal prints only the first can stay, so each print of a document is compared once.
    prints = found.where("f is not null").groupBy("doc_id", "f").agg(F.min("element_idx").alias("element_idx")).select("doc_id", "element_idx", "f")
    kept = _settled(prints, most).unionByName(short).toDF("_doc", "_idx")
    return df.join(kept, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("element_idx") == F.col("_idx")), "left_semi")
