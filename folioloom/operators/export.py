"""Elements as flat rows and as nested documents, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import LOCATION


def _missing(layer: Column, held: Column) -> Column:
    """Of a map the entries whose key another doesn't have."""
    return F.map_filter(layer, lambda k, _: ~F.map_contains_key(held, k))


def flat_rows(df: DataFrame) -> DataFrame:
    """(page_content, metadata): metadata is a map; of equal keys those of the element win over location, raw content and file."""
    base = F.create_map(
        F.lit("file_name"), F.col("file_name"), F.lit("file_type"), F.col("file_type"), F.lit("element_id"), F.col("element_id"), F.lit("element_type"), F.col("type"), F.lit("raw_content"), F.col("raw_content")
    )
    place = F.from_json(F.to_json("location"), "map<string,string>")
    own = F.from_json(F.coalesce("metadata", F.lit("{}")), "map<string,string>")
    level = F.when(F.col("level").isNotNull(), F.create_map(F.lit("level"), F.col("level").cast("string")))
    none = F.create_map().cast("map<string,string>")
    layers = [own, F.coalesce(level, none), F.coalesce(place, none), base]
    merged = layers[0]
    for layer in layers[1:]:
        merged = F.map_concat(merged, _missing(layer, merged))
    return df.select("doc_id", "element_idx", F.col("content").alias("page_content"), F.map_filter(merged, lambda _, v: v.isNotNull()).alias("metadata"))


def to_documents(df: DataFrame) -> DataFrame:
    """(doc_id, file_name, file_type, document): each document as JSON with its elements in order; nulls are left out."""
    element = F.struct("element_idx", F.col("element_id").alias("id"), "type", "content", "raw_content", "location", "level", "metadata")
    nested = df.groupBy("doc_id", "file_name", "file_type").agg(F.sort_array(F.collect_list(element)).alias("elements"))
    return nested.select("doc_id", "file_name", "file_type", F.to_json(F.struct("file_name", "file_type", "elements")).alias("document"))


def from_documents(df: DataFrame) -> DataFrame:
    """The elements of nested documents; unknown keys are ignored."""
    element = f"struct<element_idx:int,id:string,type:string,content:string,raw_content:string,location:{LOCATION},level:int,metadata:string>"
    parsed = F.from_json("document", f"file_name string, file_type string, elements array<{element}>")
    rows = df.select("doc_id", parsed.alias("d")).select("doc_id", "d.file_name", "d.file_type", F.explode("d.elements").alias("e"))
    return rows.select(
        "doc_id", "file_name", "file_type", "e.element_idx", F.col("e.id").alias("element_id"), "e.type", "e.content", "e.raw_content", "e.location", "e.level", "e.metadata"
    )
