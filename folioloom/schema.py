"""The data model: documents hold ordered elements, chunks hold runs of elements."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LOCATION = "struct<page_number:int,bbox:array<double>,start_line:int,end_line:int,start_char:int,end_char:int,selector:string,start_time:double,end_time:double>"

#: ``metadata`` holds as JSON what has no column of its own.
ELEMENTS = (
    "doc_id string, file_name string, file_type string, element_idx int, element_id string, type string, "
    f"content string, raw_content string, location {LOCATION}, level int, metadata string"
)

LOCATION_FIELDS = {
    "page_number": "int",
    "bbox": "array<double>",
    "start_line": "int",
    "end_line": "int",
    "start_char": "int",
    "end_char": "int",
    "selector": "string",
    "start_time": "double",
    "end_time": "double",
}


def location(**fields: Column) -> Column:
    """A location with these fields, the others null."""
    if unknown := set(fields) - set(LOCATION_FIELDS):
        raise ValueError(f"no such location fields: {sorted(unknown)}")
    return F.struct(*(fields.get(k, F.lit(None)).cast(t).alias(k) for k, t in LOCATION_FIELDS.items()))


def element_id(doc_id: Column, idx: Column) -> Column:
    """A stable id: tasks may run twice, so nothing random."""
    return F.substring(F.md5(F.concat_ws("|", doc_id.cast("string"), idx.cast("string"))), 1, 12)
