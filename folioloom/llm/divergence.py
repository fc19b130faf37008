"""Source divergence audit: how far the sources of a language differ in the words they use.

Every source of a language, and the language itself, gives each kept term a share
``p = 1 + floor(10**9 * (count + 1) / (N + V))``, and a term's part of the divergence
from q is ``f = floor((p - q)**2 / q)``.  All arithmetic is in whole numbers.

1. Tasks count terms and the documents they stand in by (language, source, term)
   and pass sums on.  A term's row is its sparse vector of counts by source.
2. Terms of one vector are one row with a multiplicity.  A pair of sources is
   evaluated once for each distinct vector that has both, and multiplied.
3. Where a vector has a zero, the share is that source's least one, and what is
   needed is only how many terms have which count in one source.  So the sum over
   all V terms is put together from

   * terms with a count in g, against h's least share, by g's distinct counts;
   * terms with a count in h, from g's least share, by h's distinct counts;
   * all other terms, least share against least share, by their number;
   * for vectors with both, the difference to what these three have assumed.

4. Original terms are ranked by source; each partition keeps its best before
   anything is exchanged.

The result has a row for each ordered pair of sources of a language, so the table
of sources, which meets itself on the language, is as large as its square root;
whether it is broadcast is left to its size.  A term's vector is as long as its
language has sources.

Defined cases: null text, language and source are ''; a source without terms
takes part, with least shares; in a language without kept terms all values are 0;
rows that repeat count as documents of their own; ties go by the item's UTF-8
bytes.  No rows give no rows.  Other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textscan
from .common import Scratch

#: (group, term) rows a task holds before it passes them on.
HELD = 400_000
#: Pairs of sources that are evaluated at a time.
CELLS = 1 << 20

_TERM = re.compile(rb"[a-z\x80-\xff]+")


def _counted(batches):
    """(lang, source, term, n, d): occurrences and documents of each term, summed as far as a task holds them."""
    groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def rows():
        for (lang, source), (n, d) in groups.items():
            size = len(n)
            terms = pa.array(n.keys(), pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * size, pa.string()), pa.array([source] * size, pa.string()), terms, pa.array(n.values(), pa.int64()), pa.array([d[t] for t in n], pa.int64())],
                names=["lang", "source", "term", "n", "d"],
            )
        groups.clear()

    for batch in batches:
        for some in textscan.slices(batch, "text"):
            for lang, source, text in zip(*(some.column(k).to_pylist() for k in range(3)), strict=True):
                n, d = groups.setdefault((lang, source), (Counter(), Counter()))
                found = _TERM.findall(text.encode().lower())
                n.update(found)
                d.update(set(found))
            if sum(len(n) for n, _ in groups.values()) > HELD:
                yield from rows()
    yield from rows()


def vectors(docs: DataFrame, least_docs: int) -> DataFrame:
    """(lang, term, total, v) of each kept term: v has (source, n) for every source where it stands, by source."""
    texts = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    counts = texts.mapInArrow(_counted, "lang string, source string, term string, n long, d long").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))
    by_term = counts.groupBy("lang", "term").agg(F.sum("d").alias("d"), F.sum("n").alias("total"), F.array_sort(F.collect_list(F.struct("source", "n"))).alias("v"))
    return by_term.where(F.col("d") >= least_docs).drop("d")


def _share(n, total, terms):
    """1 + floor(10**9 * (n + 1) / (total + terms)); null without terms."""
    top = F.lit(1_000_000_000).cast("decimal(10,0)") * (n + 1).cast("decimal(20,0)")
    return F.call_function("div", top, F.nullif(total + terms, F.lit(0)).cast("decimal(20,0)")) + 1


def _part(p, q):
    """floor((p - q)**2 / q)"""
    return F.call_function("div", (p - q) * (p - q), q)


def _apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


def _shared(batches):
    """(lang, source, item, value) summed over each batch's distinct vectors: what two counted sources change against least shares."""
    for batch in batches:
        lang = batch.column(0).dictionary_encode()
        listed = batch.column(1)
        at = np.concatenate([[0], np.cumsum(np.asarray(listed.value_lengths()))])
        flat = listed.flatten()
        source = flat.field("source").dictionary_encode()
        names, s = len(source.dictionary), source.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        p, least = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("p", "least"))
        of, m = lang.indices.to_numpy(zero_copy_only=False).astype(np.int64), batch.column(2).to_numpy(zero_copy_only=False)
        sizes = np.diff(at)
        codes, values = [], []
        for k in np.unique(sizes[sizes > 1]).tolist():
            rows = np.flatnonzero(sizes == k)
            step = max(1, CELLS // (k * k))
            for some in (rows[i : i + step] for i in range(0, len(rows), step)):
                where = at[some][:, None] + np.arange(k)
                a, b, x, y = p[where][:, :, None], p[where][:, None, :], least[where][:, :, None], least[where][:, None, :]
                value = (_apart(a, b) - _apart(a, y) - _apart(x, b) + _apart(x, y)) * m[some][:, None, None]
                code = (of[some][:, None, None] * names + s[where][:, :, None]) * names + s[where][:, None, :]
                code, which = np.unique(code.ravel(), return_inverse=True)
                total = np.zeros(len(code), np.int64)
                np.add.at(total, which, value.ravel())
                codes.append(code)
                values.append(total)
        if not codes:
            continue
        code, value = np.concatenate(codes), np.concatenate(values)
        yield pa.RecordBatch.from_arrays(
            [lang.dictionary.take(pa.array(code // names // names)), source.dictionary.take(pa.array(code // names % names)), source.dictionary.take(pa.array(code % names)), pa.array(value)],
            names=["lang", "source", "item", "value"],
        )


def audit(docs: DataFrame, least_docs: int = 3, ranks: int = 200) -> DataFrame:
    """(lang, source, part, item, value, rank): other sources of the language by divergence, and each source's ``ranks`` most telling terms."""
    scratch = Scratch(docs.sparkSession)
    terms = scratch.keep(vectors(docs, least_docs))
    distinct = scratch.keep(terms.groupBy("lang", "v").agg(F.count("*").alias("m")).select(F.monotonically_increasing_id().alias("id"), "lang", "v", "m"))
    entries = distinct.select("id", "lang", "m", F.inline("v"))

    # Sources and languages, with their sums and least shares.
    hist = scratch.keep(entries.groupBy("lang", "source", "n").agg(F.sum("m").alias("m")))
    of_lang = distinct.groupBy("lang").agg(F.sum("m").alias("terms")).join(hist.groupBy("lang").agg(F.sum(F.col("n") * F.col("m")).alias("lang_total")), "lang")
    there = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    sums = hist.groupBy("lang", "source").agg(F.sum(F.col("n") * F.col("m")).alias("total"), F.sum("m").alias("counted"))
    groups = there.join(of_lang, "lang", "left").join(sums, ["lang", "source"], "left").fillna(0)
    groups = scratch.keep(groups.withColumn("least", _share(F.lit(0), F.col("total"), F.col("terms"))))

    # Pairs: the three sums over zeros, then the vectors that have both.
    other = groups.select("lang", F.col("source").alias("item"), F.col("least").alias("q"), F.col("counted").alias("item_counted"))
    pairs = groups.join(other, "lang").where("source <> item")
    zeros = pairs.select("lang", "source", "item", F.coalesce((F.col("terms") - F.col("counted") - F.col("item_counted")) * _part(F.col("least"), F.col("q")), F.lit(0)).alias("value"))
    single = hist.join(groups.select("lang", "source", "total", "terms"), ["lang", "source"]).withColumn("p", _share(F.col("n"), F.col("total"), F.col("terms")))
    single = single.groupBy("lang", "source", "p").agg(F.sum("m").alias("m")).join(other, "lang").where("source <> item")
    single = single.groupBy("lang", "source", "item").agg(F.sum(F.col("m") * _part(F.col("p"), F.col("q"))).alias("a"), F.sum(F.col("m") * _part(F.col("q"), F.col("p"))).alias("b"))
    single = single.select("lang", F.inline(F.array(F.struct("source", "item", F.col("a").alias("value")), F.struct(F.col("item").alias("source"), F.col("source").alias("item"), F.col("b").alias("value")))))
    shares = entries.join(groups.select("lang", "source", "total", "terms", "least"), ["lang", "source"]).select("id", "lang", "m", F.struct("source", _share(F.col("n"), F.col("total"), F.col("terms")).alias("p"), "least").alias("e"))
    both = shares.groupBy("id").agg(F.first("lang").alias("lang"), F.collect_list("e").alias("e"), F.first("m").alias("m")).where(F.size("e") > 1)
    both = both.select("lang", "e", "m").mapInArrow(_shared, "lang string, source string, item string, value long").where("source <> item")
    value = zeros.unionByName(single).unionByName(both).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))

    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    found = value.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(best).alias("rank"))

    each = terms.select("lang", F.col("term").alias("item"), F.col("total").alias("lang_n"), F.inline("v"))
    each = each.join(groups.select("lang", "source", "total", "terms", "lang_total"), ["lang", "source"])
    each = each.select("lang", "source", "item", _share(F.col("n"), F.col("total"), F.col("terms")).alias("p"), _share(F.col("lang_n"), F.col("lang_total"), F.col("terms")).alias("q")).where("p > q")
    each = each.select("lang", "source", "item", _part(F.col("p"), F.col("q")).alias("value"))
    told = each.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= ranks).select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")
    return found.unionByName(told)
