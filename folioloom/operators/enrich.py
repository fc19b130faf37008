"""Headings, captions and records added to elements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import scratch
from ..functions import places, tables, text
from ..sinks.buckets import BucketTable
from . import calls

DEEPEST = 6
# The words that the enriched text uses.
NO_HEADING = "正文全局"
NO_NAME = "未命名文档"
CAPTION = r"(?i)^(表\s*[\d.\-_A-Za-z]+|Table\s*[\d.\-_A-Za-z]+)[:：\s]?"
CAPTION_CHARS = 35
CAPTION_TYPES = ("text", "heading")


def with_heading_path(df: DataFrame, name: str = "header_path", separator: str = " > ", otherwise: str = NO_HEADING, strip: bool = True, deepest: int = DEEPEST) -> DataFrame:
    """Adds the path of headings above each row, itself included if it is one.

    The stack of headings as windows: level L's heading is the last one of that
    level, unless a heading of a lower level came after it.
    """
    order = Window.partitionBy("doc_id").orderBy("element_idx").rowsBetween(Window.unboundedPreceding, 0)
    is_heading = F.col("type") == "heading"
    level = F.coalesce("level", F.lit(1))
    title = text.strip(F.col("content")) if strip else F.col("content")
    last = {k: F.last(F.when(is_heading & (level == k), F.struct(F.col("element_idx").alias("at"), title.alias("title"))), ignorenulls=True).over(order) for k in range(1, deepest + 1)}
    df = df.withColumns({f"_h{k}": c for k, c in last.items()})
    titles = []
    for k in range(1, deepest + 1):
        above = [F.coalesce(F.col(f"_h{j}.at"), F.lit(-1)) for j in range(1, k)]
        since = F.greatest(*above, F.lit(-1)) if above else F.lit(-1)
        titles.append(F.when(F.col(f"_h{k}.at") > since, F.col(f"_h{k}.title")))
    path = F.filter(F.array(*titles), lambda t: t.isNotNull())
    joined = F.when(F.size(path) > 0, F.array_join(path, separator)).otherwise(otherwise)
    return df.withColumn(name, joined).drop(*(f"_h{k}" for k in range(1, deepest + 1)))


def enrich_context(df: DataFrame, file_name: bool = True, header_path: bool = True, separator: str = " > ") -> DataFrame:
    """Puts the file's name and the headings above before the content of all but headings.

    Adds ``header_path`` and ``context_prefix``, null for headings.
    """
    df = with_heading_path(df, "_path", separator)
    body = F.col("type") != "heading"
    name = F.when(F.coalesce("file_name", F.lit("")) == "", NO_NAME).otherwise(F.col("file_name"))
    parts = [F.concat(F.lit("文档: "), name)] * file_name + [F.concat(F.lit("上下文: "), F.col("_path"))] * header_path
    prefix = F.concat(F.lit("【"), F.concat_ws(" | ", *parts), F.lit("】")) if parts else F.lit(None).cast("string")
    df = df.withColumns({"header_path": F.when(body, F.col("_path")), "context_prefix": F.when(body, prefix)}).drop("_path")
    return df.withColumn("content", F.when(F.col("context_prefix").isNotNull(), F.concat("context_prefix", F.lit("\n"), "content")).otherwise(F.col("content")))


def caption(distance: int = 2) -> Column:
    """For a table: the nearest text before it, within this many elements, that reads like a caption."""
    order = Window.partitionBy("doc_id").orderBy("element_idx")
    found = []
    for k in range(1, distance + 1):
        words, kind = text.strip(F.lag("content", k).over(order)), F.lag("type", k).over(order)
        short = (F.length(words) <= CAPTION_CHARS) & kind.isin(*CAPTION_TYPES)
        found.append(F.when((words != "") & (words.rlike(CAPTION) | short), words))
    return F.coalesce(*found)


def enrich_tables(df: DataFrame, captions: bool = True, records: bool = True, distance: int = 2) -> DataFrame:
    """Adds ``table_caption`` and ``kv_pairs`` to tables, and the caption before their content."""
    is_table = F.col("type") == "table"
    df = df.withColumn("_caption", caption(distance) if captions else F.lit(None).cast("string"))
    found = tables.records(F.col("content")) if records else F.array().cast("array<map<string,string>>")
    df = df.withColumns({"table_caption": F.when(is_table, F.col("_caption")), "kv_pairs": F.when(is_table & (F.size(found) > 0), found)}).drop("_caption")
    headed = F.concat(F.lit("【表格: "), "table_caption", F.lit("】\n"), F.coalesce("content", F.lit("")))
    return df.withColumn("content", F.when(F.col("table_caption").isNotNull(), headed).otherwise(F.col("content")))


def _target(df: DataFrame) -> Column:
    """An image's file: its own, else its source, else the document's."""
    meta = lambda k: F.get_json_object("metadata", f"$.{k}")
    path = F.col("file_path") if "file_path" in df.columns else F.col("file_name")
    return F.when(F.col("type") == "image", F.coalesce(meta("file_path"), meta("src"), path))


def describe_images(df: DataFrame, describe) -> DataFrame:
    """Replaces images' content by what ``describe``, a function from a column of targets to one of texts, gives.

    The target is the image's own file, else its source, else the document's
    file, as JSON metadata and columns have them; without one the image stays.
    A null description leaves the content and sets ``caption_generated`` false.
    """
    df = df.withColumn("_target", _target(df)).withColumn("_said", F.when(F.col("_target").isNotNull(), describe(F.col("_target"))))
    out = df.withColumn("content", F.coalesce("_said", "content"))
    return out.withColumn("caption_generated", F.when(F.col("_target").isNotNull(), F.col("_said").isNotNull())).drop("_target", "_said")


def caption_images(df: DataFrame, contents: DataFrame, service: calls.Service, known: BucketTable | None = None) -> DataFrame:
    """As ``describe_images``, but pictures are sent themselves, each distinct one once, however many files and elements have it.

    ``contents`` (path, content) has the files.  ``caption_error`` says why an
    image kept its content: the service's error, or that its file isn't there.
    """
    df = df.drop("_target", "_digest", "caption_generated", "caption_error").withColumn("_target", _target(df))
    wanted = contents.join(df.select(F.col("_target").alias("path")).where("path is not null").distinct(), "path", "left_semi").dropDuplicates(["path"])
    wanted = scratch.keep(wanted.select("path", "content", calls.digest(F.col("content")).alias("digest")))
    answers = calls.answered(wanted.select("content"), service, known)
    said = wanted.join(answers, "digest", "left").select(F.col("path").alias("_target"), F.col("answer").alias("_said"), F.col("error").alias("_error"), F.lit(True).alias("_there"))
    out = df.join(said, "_target", "left").withColumn("content", F.coalesce("_said", "content"))
    out = out.withColumn("caption_generated", F.when(F.col("_target").isNotNull(), F.col("_said").isNotNull()))
    error = F.when(F.col("_there").isNull(), F.concat(F.lit("no file "), "_target")).otherwise(F.coalesce("_error", F.lit("the file is empty")))
    return out.withColumn("caption_error", F.when(~F.col("caption_generated"), error)).drop("_target", "_said", "_error", "_there")


#: What a service that recognises text answers to a picture: lines with corner points in pixels.
LINES = "struct<width:int,height:int,lines:array<struct<text:string,confidence:double,corners:array<array<double>>>>>"


def recognise(pages: DataFrame, service: calls.Service, known: BucketTable | None = None) -> tuple[DataFrame, DataFrame]:
    """(lines, failures) of pictures of pages (doc_id, page_number, content): each distinct picture is sent once.

    lines: doc_id, page_number, line, content, confidence and bbox in shares of
    the page; failures: doc_id, page_number, error.
    """
    pages = pages.select("doc_id", "page_number", calls.digest(F.col("content")).alias("digest"), "content")
    answers = calls.answered(pages.select("content"), service, known)
    found = pages.drop("content").join(answers, "digest", "left")
    each = found.where("answer is not null").select("doc_id", "page_number", F.col("answer.width").alias("w"), F.col("answer.height").alias("h"), F.posexplode("answer.lines").alias("line", "l"))
    lines = each.select("doc_id", "page_number", "line", F.col("l.text").alias("content"), F.col("l.confidence").alias("confidence"), places.corners_box(F.col("l.corners"), F.col("w"), F.col("h")).alias("bbox"))
    return lines, found.where("answer is null").select("doc_id", "page_number", F.coalesce("error", F.lit("no picture")).alias("error"))


def stand_in_description(target: Column) -> Column:
    """A deterministic description for tests and dry runs, marked as such; never used unless asked for."""
    return F.concat(F.lit("[stand-in description] "), F.regexp_extract(target, r"([^/\\]*)$", 1))
