"""File names to formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The extensions of each format.
EXTENSIONS = {
    "txt": "txt log",
    "markdown": "md markdown",
    "docx": "docx",
    "xlsx": "xlsx xls",
    "pptx": "pptx",
    "pdf": "pdf",
    "html": "html htm",
    "csv": "csv tsv",
    "json": "json",
    "image": "png jpg jpeg gif bmp tiff tif webp",
    "audio": "mp3 wav flac m4a ogg wma aac",
    "video": "mp4 avi mkv mov wmv flv webm m4v",
}
FORMATS = {f".{e}": f for f, es in EXTENSIONS.items() for e in es.split()}


def extension(path: Column) -> Column:
    """The lower-cased suffix with its dot, empty without one; a leading dot begins no suffix."""
    name = F.regexp_extract(path, r"([^/\\]*)$", 1)
    return F.lower(F.regexp_extract(name, r"^.+(\.[^.]+)$", 1))


def file_format(path: Column) -> Column:
    """The format of a path, null for one that is not supported."""
    out = F.lit(None).cast("string")
    ext = extension(path)
    for name, es in EXTENSIONS.items():
        out = F.when(ext.isin(*(f".{e}" for e in es.split())), name).otherwise(out)
    return out


def supported_extensions() -> list[str]:
    return sorted(FORMATS)
