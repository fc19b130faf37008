"""Cutting documents into chunks of whole elements."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import location
from .enrich import with_heading_path

SIZE, OVERLAP = 512, 64
PARENT, CHILD, CHILD_OVERLAP = 1024, 256, 32
LONG_DOCUMENT = 1200
STRATEGIES = ("auto", "sliding_window", "parent_child", "header_aware")


def spans(lengths: np.ndarray, size: int, overlap: int) -> list[tuple[int, int]]:
    """(first, last) of each chunk of the sliding window over elements of these lengths.

    Elements are never cut.  One of ``size`` or more stands alone.  Where the
    next element doesn't fit, the chunk closes and the longest run of its last
    elements that is within ``overlap`` opens the next.
    """
    out, start, held = [], 0, 0
    for i, n in enumerate(lengths.tolist()):
        if n >= size:
            if start < i:
                out.append((start, i - 1))
            out.append((i, i))
            start, held = i + 1, 0
        elif held + n <= size:
            held += n
        else:
            if start < i:
                out.append((start, i - 1))
            back, kept = i, 0
            while back > start and kept + lengths[back - 1] <= overlap:
                back -= 1
                kept += int(lengths[back])
            start, held = back, kept + n
    if start < len(lengths):
        out.append((start, len(lengths) - 1))
    return out


def _folded(batches, size: int, overlap: int, name: str):
    """Rows in order, each as often as ``spans`` puts it into a window, window by window.

    ``_n`` is a row's length, ``_first`` says that a group begins with it and
    ``_head`` that a document does.  ``name`` is the window's number in its group,
    ``_all`` that in its document; ``_first`` then says that a window begins, so one
    fold can follow another.  Only the rows that may open the next window are held.
    """
    carry, start, held, c, all_ = None, 0, 0, 0, -1
    fresh = True  # no row of the open window has been given yet
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        k0 = 0 if carry is None else len(carry)
        if k0:
            rows = pa.concat_tables([carry, rows])
        n, first, head = (rows.column(x).to_pylist() for x in ("_n", "_first", "_head"))
        out, begins, heads, within, whole = [], [], [], [], []

        def give(i):
            nonlocal fresh, all_
            all_ += fresh
            out.append(i)
            begins.append(fresh)
            heads.append(head[i] and all_ == 0 and fresh)
            within.append(c)
            whole.append(all_)
            fresh = False

        for i in range(k0, len(n)):
            if first[i]:
                start, held, c, fresh = i, 0, 0, True
                if head[i]:
                    all_ = -1
            if n[i] >= size:
                if start < i:
                    c, fresh = c + 1, True
                give(i)
                start, held, c, fresh = i + 1, 0, c + 1, True
            elif held + n[i] <= size:
                held += n[i]
                give(i)
            else:
                back, kept = i, 0
                while back > max(start, 0) and kept + n[back - 1] <= overlap:
                    back -= 1
                    kept += n[back]
                start, held, c, fresh = back, kept + n[i], c + 1, True
                for j in range(back, i + 1):
                    give(j)
        back, kept = len(n), 0
        while back > max(start, 0) and kept + n[back - 1] <= overlap:
            back -= 1
            kept += n[back]
        carry, start = rows.slice(back), start - back
        if out:
            found = rows.drop_columns(["_first", "_head"]).take(pa.array(out))
            if "_all" in found.column_names:
                found = found.drop_columns(["_all"])
            for x, column in ((name, pa.array(within, pa.int32())), ("_first", pa.array(begins)), ("_head", pa.array(heads)), ("_all", pa.array(whole, pa.int32()))):
                found = found.append_column(x, column)
            yield from found.combine_chunks().to_batches()


def _assembled(df: DataFrame, keys: list[str], chunk_type: str, path: Column, with_box: bool, along: list[str] | None = None) -> DataFrame:
    """Chunks from rows that carry their chunk's keys: contents by order, locations from the first and last element.  ``along`` follows from the keys."""
    along = along or []
    order = F.col("element_idx")
    ordered = F.sort_array(F.collect_list(F.struct(order.alias("i"), F.col("element_id").alias("id"), F.col("content").alias("c"))))
    first, last = F.min_by("location", order), F.max_by("location", order)
    grouped = df.groupBy(*keys, *along).agg(
        ordered.alias("_o"), first.alias("_f"), last.alias("_l"), F.count("*").cast("int").alias("elements_count"), F.min_by("type", order).alias("primary_element_type"), F.max_by(path, order).alias("header_path")
    )
    texts = F.filter(F.transform("_o", lambda x: x["c"]), lambda c: c.isNotNull() & (c != ""))
    merged = {"start_line": F.col("_f.start_line"), "end_line": F.col("_l.end_line"), "page_number": F.col("_f.page_number")}
    if with_box:
        merged |= {k: F.col(f"_f.{k}") for k in ("bbox", "selector", "start_time")} | {"end_time": F.col("_l.end_time")}
    chunk_id = F.substring(F.md5(F.concat_ws("|", F.lit(chunk_type), *(F.col(k).cast("string") for k in keys))), 1, 16)
    return grouped.select(
        chunk_id.alias("chunk_id"),
        *keys,
        *along,
        F.array_join(texts, "\n\n").alias("page_content"),
        F.lit(chunk_type).alias("chunk_type"),
        F.transform("_o", lambda x: x["id"]).alias("element_ids"),
        "elements_count",
        "primary_element_type",
        "header_path",
        location(**merged).alias("location"),
    )


def _none() -> Column:
    return F.lit(None).cast("string")


COLUMNS = ["chunk_id", "doc_id", "chunk_idx", "page_content", "chunk_type", "element_ids", "elements_count", "primary_element_type", "header_path", "parent_id", "location"]


def _windows(df: DataFrame, *levels: tuple[str, int, int]) -> DataFrame:
    """The elements of each document's windows; an element in an overlap comes twice.  Places may have gaps.

    A level (name, size, overlap) numbers its windows in ``name``; another one cuts
    within them.  ``_all`` is the last level's number in the document.  Documents are
    sorted, not gathered, and their rows pass by in batches whatever their lengths,
    so neither a document nor a window costs a call, and nothing is joined back.
    """
    first = F.row_number().over(Window.partitionBy("doc_id").orderBy("element_idx")) == 1
    rows = df.where(F.col("doc_id").isNotNull()).withColumns({"_n": F.length(F.coalesce("content", F.lit(""))), "_first": first})
    rows = rows.withColumn("_head", F.col("_first")).sortWithinPartitions("doc_id", "element_idx")
    names = [*df.columns, *(name for name, _, _ in levels), "_all"]
    schema = T.StructType([*df.schema.fields, *(T.StructField(x, T.IntegerType()) for x in names[len(df.columns) :])])

    def run(batches):
        for level in levels:
            batches = _folded(batches, level[1], level[2], level[0])
        for batch in batches:
            yield batch.select(names)

    return rows.mapInArrow(run, schema)


def sliding_window(df: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """Chunks of up to ``size`` characters of neighbouring elements."""
    out = _assembled(_windows(df, ("chunk_idx", size, overlap)), ["doc_id", "chunk_idx"], "sliding_window", _none(), True)
    return out.withColumn("parent_id", _none()).select(*COLUMNS)


def header_aware(df: DataFrame) -> DataFrame:
    """A chunk for each heading with what follows up to the next, and its path; text before the first is ``root``."""
    headed = with_heading_path(df, "_path", otherwise="root", strip=False)
    order = Window.partitionBy("doc_id").orderBy("element_idx").rowsBetween(Window.unboundedPreceding, 0)
    section = F.sum((F.col("type") == "heading").cast("int")).over(order)
    headed = headed.withColumn("_section", section)
    # Sections are numbered from 0 whether or not text stands before the first heading.
    lead = F.min("_section").over(Window.partitionBy("doc_id"))
    headed = headed.withColumn("chunk_idx", (F.col("_section") - lead).cast("int"))
    out = _assembled(headed, ["doc_id", "chunk_idx"], "header_aware", F.col("_path"), False)
    return out.withColumn("parent_id", _none()).select(*COLUMNS)


def parent_child(df: DataFrame, parent: int = PARENT, child: int = CHILD, overlap: int = CHILD_OVERLAP) -> tuple[DataFrame, DataFrame]:
    """(children, parents): large windows for context, and within each small ones that carry its id."""
    own = lambda idx: F.concat(F.lit("parent_"), F.substring(F.md5(F.concat_ws("|", F.col("doc_id").cast("string"), F.col(idx).cast("string"))), 1, 12))
    large = _windows(df, ("_parent_idx", parent, 2 * overlap)).withColumn("parent_id", own("_parent_idx"))
    parents = _assembled(large, ["doc_id", "parent_id"], "parent", _none(), True).select("parent_id", "doc_id", F.col("page_content").alias("parent_text"))
    small = _windows(df, ("_parent_idx", parent, 2 * overlap), ("chunk_idx", child, overlap)).withColumn("parent_id", own("_parent_idx"))
    out = _assembled(small, ["doc_id", "_parent_idx", "parent_id", "chunk_idx"], "parent_child_child", _none(), True, ["_all"])
    numbered = out.withColumn("chunk_idx", F.col("_all"))
    return numbered.select(*COLUMNS), parents


def _strategy(over=None) -> Column:
    headings, length = F.count_if(F.col("type") == "heading"), F.sum(F.length(F.coalesce("content", F.lit(""))))
    if over is not None:
        headings, length = headings.over(over), length.over(over)
    return F.when(headings >= 2, "header_aware").when(length >= LONG_DOCUMENT, "parent_child").otherwise("sliding_window")


def route(df: DataFrame) -> DataFrame:
    """(doc_id, strategy): by headings for two or more of them, else parent and child for long documents, else windows."""
    return df.groupBy("doc_id").agg(_strategy().alias("strategy"))


def chunk(df: DataFrame, strategy: str = "auto", **options) -> tuple[DataFrame, DataFrame]:
    """(chunks, parents) of any strategy; an unknown one is the sliding window.

    ``parents`` is empty but for parent and child.  Auto routes each document.
    """
    none = df.sparkSession.createDataFrame([], f"parent_id string, doc_id {df.schema['doc_id'].dataType.simpleString()}, parent_text string")
    if strategy == "header_aware":
        return header_aware(df), none
    if strategy == "parent_child":
        return parent_child(df, **options)
    if strategy != "auto":
        return sliding_window(df, **options), none
    # As a window the strategy needs no join: all branches read one exchange by document.
    routed = df.withColumn("_strategy", _strategy(Window.partitionBy("doc_id")))
    of = lambda s: routed.where(F.col("_strategy") == s).drop("_strategy")
    children, parents = parent_child(of("parent_child"))
    return header_aware(of("header_aware")).unionByName(children).unionByName(sliding_window(of("sliding_window"))), parents


def stats(chunks: DataFrame) -> DataFrame:
    """One row: how many chunks, mean and largest length in UTF-16 units, percent with a heading path."""
    n = F.octet_length(F.encode("page_content", "UTF-16BE")) / 2
    nearest = lambda x: F.floor(x + 0.5).cast("long")
    headed = F.count_if(F.coalesce("header_path", F.lit("")) != "")
    return chunks.agg(
        F.count("*").alias("total"),
        F.coalesce(nearest(F.avg(n)), F.lit(0)).alias("avg_length"),
        F.coalesce(F.max(n).cast("long"), F.lit(0)).alias("max_length"),
        F.coalesce(nearest(F.try_divide(headed * 100, F.count("*"))), F.lit(0)).alias("header_path_ratio"),
    )


def profile(chunks: DataFrame, keys: list[str], tiny: int = 50) -> DataFrame:
    """Per group: shortest, middle and longest chunk, and chunks of fewer than ``tiny`` characters."""
    placed = chunks.select(*keys, F.length("page_content").alias("_n"))
    order = Window.partitionBy(*keys).orderBy("_n")
    ranked = placed.withColumns({"_r": F.row_number().over(order) - 1, "_c": F.count("*").over(Window.partitionBy(*keys))})
    middle = F.max(F.when(F.col("_r") == F.floor(F.col("_c") / 2), F.col("_n")))
    return ranked.groupBy(*keys).agg(F.count("*").alias("n_chunks"), F.min("_n").alias("min_length"), middle.alias("middle_length"), F.max("_n").alias("max_length"), F.count_if(F.col("_n") < tiny).alias("n_tiny"))
