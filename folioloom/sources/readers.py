"""Reading: texts, files, folders and archives to (elements, failures)."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..schema import ELEMENTS, LOCATION_FIELDS, element_id, location
from . import folders, media, office, parse, routing, web
from .folders import ARCHIVES

# Folders that are never read.
EXCLUDED = (".git", "__pycache__", ".venv", ".uv-cache", ".idea", ".vscode", ".ds_store")

_TEXT: dict[str, Callable[[str], Iterator[dict]]] = {"txt": parse.parse_text, "csv": parse.parse_csv, "json": parse.parse_json, "html": parse.parse_html, "markdown": parse.parse_markdown}
_BYTES: dict[str, Callable[[bytes], Iterator[dict]]] = {"xlsx": office.parse_xlsx, "docx": office.parse_docx, "pptx": office.parse_pptx}
PARSED = f"{ELEMENTS}, error string"


def text_elements(docs: DataFrame, doc_id: str = "doc_id", column: str = "text") -> DataFrame:
    """A paragraph for each line of each text that isn't blank, in expressions alone."""
    each = docs.select(F.col(doc_id).alias("doc_id"), F.posexplode(text.lines(F.coalesce(column, F.lit(""))))).toDF("doc_id", "pos", "raw")
    kept = each.where(~text.is_blank(F.col("raw"))).withColumn("content", text.strip(F.col("raw")))
    # Places need not be gapless to be an order, so the line is the place and no shuffle is needed.
    return kept.select(
        "doc_id",
        F.lit(None).cast("string").alias("file_name"),
        F.lit("txt").alias("file_type"),
        F.col("pos").alias("element_idx"),
        element_id(F.col("doc_id"), F.col("pos")).alias("element_id"),
        F.lit("paragraph").alias("type"),
        "content",
        F.col("raw").alias("raw_content"),
        location(start_line=F.col("pos") + 1, end_line=F.col("pos") + 1).alias("location"),
        F.lit(None).cast("int").alias("level"),
        F.lit(None).cast("string").alias("metadata"),
    )


def parse_file(data: bytes, name: str, kind: str) -> list[dict]:
    if kind in _TEXT:
        return list(_TEXT[kind](data.decode("utf-8")))
    if kind in _BYTES:
        return list(_BYTES[kind](data))
    if kind in media.PLUGINS:
        return list(media.PLUGINS[kind](data, name))
    if kind == "image":
        return list(media.parse_image(data, name))
    raise ValueError(f"no parser for {kind!r}: register one in sources.media.PLUGINS")


def _rows(doc_id: str, name: str, kind: str, found: list[dict]) -> Iterator[dict]:
    import hashlib

    for k, x in enumerate(found):
        meta = {a: b for a, b in (x.get("metadata") or {}).items() if b is not None}
        yield {
            "doc_id": doc_id,
            "file_name": name,
            "file_type": kind,
            "element_idx": k,
            "element_id": hashlib.md5(f"{doc_id}|{k}".encode()).hexdigest()[:12],
            "type": x["type"],
            "content": x["content"],
            "raw_content": x.get("raw_content"),
            "location": {f: x.get(f) for f in LOCATION_FIELDS},
            "level": x.get("level"),
            "metadata": json.dumps(meta, ensure_ascii=False) if meta else None,
            "error": None,
        }


_NAMES = ["doc_id", "file_name", "file_type", "element_idx", "element_id", "type", "content", "raw_content", "location", "level", "metadata", "error"]


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(path, name, kind, content) to elements, or one row with the error."""
    held: list[dict] = []
    for batch in batches:
        for path, name, kind, content in zip(batch["path"], batch["name"], batch["kind"], batch["content"], strict=True):
            try:
                rows = list(_rows(path, name, kind, parse_file(bytes(content), name, kind)))
            except Exception as e:  # one bad file never fails the others: it goes to the table of failures
                rows = [dict.fromkeys(_NAMES) | {"doc_id": path, "file_name": name, "file_type": kind, "error": f"{type(e).__name__}: {e}"}]
            held += rows
            if len(held) >= 2000:
                yield _frame(held)
                held = []
    if held:
        yield _frame(held)


def _frame(rows: list[dict]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=_NAMES).astype({"element_idx": "Int32", "level": "Int32"})


def parse_files(files: DataFrame) -> DataFrame:
    """Elements of files (path, name, kind, content), and a row with ``error`` for each that fails."""
    return files.select("path", "name", "kind", "content").mapInPandas(_parse, PARSED)


def parse_texts(docs: DataFrame, kind: str, doc_id: str, column: str) -> tuple[DataFrame, DataFrame]:
    """(elements, failures) of documents of one text format that stand in a column; failures: file_path (the id), error."""
    rows = docs.select(F.col(doc_id).cast("string").alias("path"), F.col(doc_id).cast("string").alias("name"), F.lit(kind).alias("kind"), F.encode(F.coalesce(column, F.lit("")), "UTF-8").alias("content"))
    return divided(parse_files(rows))


def divided(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(elements, failures) of what ``parse_files`` gives."""
    return parsed.where("error is null").drop("error"), parsed.where("error is not null").select(F.col("doc_id").alias("file_path"), "error")


def excluded(path: Column, names: tuple[str, ...] = EXCLUDED) -> Column:
    """Whether a part of the path is an excluded folder."""
    return F.arrays_overlap(F.split(F.lower(path), r"[/\\]"), F.array(*map(F.lit, names)))


def files(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """(path, name, kind, content, error) of a file or folder: supported formats outside excluded folders.

    Folders are listed and read in tasks, see ``folders``.  On a file system that
    only Spark reads, Spark's own listing serves, which passes by every name that
    begins with ``_`` or ``.``.
    """
    if not folders.known(path):
        listed = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
        found = listed.select("path", F.regexp_extract("path", r"([^/]*)$", 1).alias("name"), "content", F.lit(None).cast("string").alias("error"))
        inside = F.substring(F.regexp_replace("path", "^[a-z0-9]+:/*", "/"), len(re.sub("^[a-z0-9]+:/*", "/", path.rstrip("/"))) + 1, 1 << 20)
        found = found.where(routing.file_format(F.col("path")).isNotNull() & ~excluded(inside))
    else:
        # Folders of excluded names aren't even listed; what they were listed for are files of supported formats.
        units = folders.units(folders.listing(spark, path, recursive, EXCLUDED), path, archives=False)
        found = folders.read(units.where(F.col("error").isNotNull() | routing.file_format(F.col("inner")).isNotNull()), path)
    return found.select("path", "name", routing.file_format(F.col("path")).alias("kind"), "content", "error")


def archive_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, kind, content, error) of the supported files in an archive, or in all archives of a folder; paths are archive/inner."""
    listed = folders.listing(spark, path, True, EXCLUDED)
    listed = listed.where(F.col("error").isNotNull() | F.lower("inner").rlike("(" + "|".join(map(re.escape, ARCHIVES)) + ")$"))
    units, at = folders.units(listed, path, archives=True), folders.unit_path(path)
    wanted = F.col("error").isNotNull() | (F.col("how") == "stream") | (routing.file_format(at).isNotNull() & ~excluded(at))
    found = folders.read(units.where(wanted), path).withColumn("kind", routing.file_format(F.col("path")))
    # What a compressed stream holds is known only now.
    kept = found.where(F.col("error").isNotNull() | (F.col("kind").isNotNull() & ~excluded(F.col("path"))))
    return kept.select("path", "name", "kind", "content", "error")


def load_batch(spark: SparkSession, path: str, clean: bool = False, web_tools=None, describe=None) -> tuple[DataFrame, DataFrame]:
    """(elements, failures) of a file, a folder, an archive or an address.

    Addresses need ``web_tools``, which makes what resolves and fetches, see
    ``web``.  ``describe`` is a function from a column of pictures' targets to one
    of descriptions, as in ``operators.enrich.describe_images``.
    """
    if path.lower().startswith(("http://", "https://")):
        if web_tools is None:
            raise ValueError("an address needs web_tools, to resolve its host and to fetch it")
        found = web.files(web.fetch(spark.createDataFrame([(path,)], "url string"), web_tools))
    else:
        found = archive_files(spark, path) if folders.is_archive(path) else files(spark, path)
    unread = found.where("error is not null").select(F.col("path").alias("file_path"), "error")
    elements, bad = divided(parse_files(found.where("error is null")))
    if clean:
        from ..operators.clean import clean as cleaned

        elements = cleaned(elements)
    if describe is not None:
        from ..operators.enrich import describe_images

        elements = describe_images(elements, describe).drop("caption_generated")
    return elements, unread.unionByName(bad)
