"""WARC archives: a writer, and a sequential reader of these and of others' archives.

An archive is a sequence of gzip members, one record each, and is kept as one
binary row of a table in the shared folder, so it is written and read by any
executor through Spark alone; archives close at about ``ARCHIVE_BYTES``.  The
reader feeds an archive to zlib in small pieces, takes each member's header,
then exactly Content-Length bytes, checks the block and payload digests that the
record states and that member and record end together, and goes on with the bytes
that zlib left over.  Records of all types are read: of those that hold an HTTP
message the payload is its body, of others the whole block; ids of any form are
``record_id``, and those that this writer gives are page ids too.

Of records with equal payloads the one with the largest page_id is the response
and the others revisit it.  That is settled on (id, digest, size) alone.

Defined cases: a null html is an empty payload; a null page_id never wins over
an id, and stays null; rows that repeat a page's id and payload are all
responses or all revisits.  A record with a wrong digest or without a type or id
is returned with ``valid`` false and reading goes on; one whose framing is broken,
or whose header has more than ``HEADER_BYTES``, ends its archive with a row that
is not valid; of one of more than ``RECORD_BYTES`` everything but the payload is
returned, not valid.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textscan
from .common import Scratch

ARCHIVE_BYTES = 8 << 20
READ_BYTES = 64 << 10
HEADER_BYTES = 1 << 20
RECORD_BYTES = 1 << 30
LEVEL = 6
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORDS = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary, valid boolean, record_id string, refers_to_record string"
_SCHEMA = pa.schema(
    [
        ("page_id", pa.int64()),
        ("url", pa.string()),
        ("record_type", pa.string()),
        ("refers_to", pa.int64()),
        ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()),
        ("payload", pa.binary()),
        ("valid", pa.bool_()),
        ("record_id", pa.string()),
        ("refers_to_record", pa.string()),
    ]
)
_BROKEN = (None,) * 7 + (False, None, None)


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _name(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _page(name: str | None) -> int | None:
    """The page id in a record id of this writer's form."""
    inner = (name or "").removeprefix("<urn:page:").removesuffix(">")
    return int(inner) if inner.removeprefix("-").isdecimal() and len(inner) < 20 else None


def _agrees(said: str | None, data: bytes) -> bool:
    """Whether a stated SHA-1, in base32 or hexadecimal, is that of the data; other digests are not checked."""
    kind, _, value = (said or "").partition(":")
    if kind.lower() != "sha1":
        return True
    return value.upper() == digest(data) if len(value) == 32 else value.lower() == hashlib.sha1(data).hexdigest()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One record as a gzip member."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_name(page_id)}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
        f"WARC-Block-Digest: sha1:{digest(block)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.insert(3, "WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if revisit:
        head += [f"WARC-Refers-To: {_name(refers_to)}", f"WARC-Profile: {REVISIT_PROFILE}"]
    pack = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + pack.flush()


class _Member:
    """Bytes of one gzip member, inflated as they are asked for."""

    def __init__(self, data: memoryview, at: int) -> None:
        self.data, self.at, self.zip, self.held = data, at, zlib.decompressobj(31), bytearray()

    def more(self) -> bool:
        if self.zip.eof or self.at >= len(self.data):
            return False
        piece = self.data[self.at : self.at + READ_BYTES]
        self.held += self.zip.decompress(piece)
        self.at += len(piece) - len(self.zip.unused_data)
        return True

    def until(self, mark: bytes) -> bytes:
        seen = 0
        while (k := self.held.find(mark, max(0, seen - len(mark)))) < 0:
            seen = len(self.held)
            if seen > HEADER_BYTES or not self.more():
                raise ValueError("a record's header has no end")
        out = bytes(self.held[:k])
        del self.held[: k + len(mark)]
        return out

    def take(self, n: int) -> bytes:
        while len(self.held) < n:
            if not self.more():
                raise ValueError("a record is shorter than it says")
        out = bytes(self.held[:n])
        del self.held[:n]
        return out

    def skip(self, n: int) -> None:
        while n > 0:
            if not self.held and not self.more():
                raise ValueError("a record is shorter than it says")
            some = min(n, len(self.held))
            del self.held[:some]
            n -= some

    def end(self) -> int:
        while self.more():
            pass
        if self.held or not self.zip.eof:
            raise ValueError("a member and its record don't end together")
        return self.at


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


def read(data: bytes) -> Iterator[tuple]:
    """The records of an archive, in the order of ``RECORDS``."""
    view, at = memoryview(data), 0
    while at < len(view):
        try:
            member = _Member(view, at)
            head = member.until(b"\r\n\r\n")
            if not head.startswith(b"WARC/"):
                raise ValueError("no WARC record")
            f = _fields(head)
            size = int(f["content-length"])
            if size < 0:
                raise ValueError("a record of less than no bytes")
            block = None
            if size <= RECORD_BYTES:
                block = member.take(size)
            else:
                member.skip(size)
            if member.take(4) != b"\r\n\r\n":
                raise ValueError("a record runs on")
            at = member.end()
        except (ValueError, KeyError, zlib.error):
            yield _BROKEN
            return
        yield _row(f, size, block)


def _row(f: dict[str, str], size: int, block: bytes | None) -> tuple:
    kind, name, refers = f.get("warc-type"), f.get("warc-record-id"), f.get("warc-refers-to")
    said = f.get("warc-payload-digest")
    valid = block is not None and kind is not None and name is not None and _agrees(f.get("warc-block-digest"), block)
    payload, http = block, {}
    if block is not None and f.get("content-type", "").lower().startswith("application/http"):
        message, _, payload = block.partition(b"\r\n\r\n")
        http = _fields(message)
    if kind == "revisit":  # the payload stands in another record; the HTTP header may tell its size
        stated = http.get("content-length", "")
        size, payload = int(stated) if stated.isdecimal() and len(stated) < 19 else None, None
    elif payload is not None:
        size, valid = len(payload), valid and _agrees(said, payload)
    if said is not None:
        bare = said.partition(":")[2] or said
    else:
        bare = None if payload is None else digest(payload)
    return _page(name), f.get("warc-target-uri"), kind, _page(refers), size, bare, payload, valid, name, refers


def archives(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(archive, records, data): the pages' records in archives.  Payloads of fewer than ``least_bytes`` are never revisits."""
    raw = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), raw.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    small = rows.select("page_id", "digest", F.octet_length("payload").alias("n")).where(f"n >= {least_bytes}")
    top = small.groupBy("digest", "n").agg(F.max("page_id").alias("top"), F.count("*").alias("copies")).where("copies > 1 and top is not null")
    revisits = small.join(top, ["digest", "n"]).where("page_id is null or page_id < top").select("page_id", "digest", "top").distinct()
    revisits = revisits.toDF("_id", "_digest", "_top")
    marked = rows.join(revisits, F.col("page_id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest")), "left").select("page_id", "url", "payload", "_top")

    def write(batches):
        from pyspark import TaskContext

        task, made, members, size = TaskContext.get().partitionId(), 0, [], 0

        def row():
            return pa.RecordBatch.from_arrays([pa.array([f"part-{task:06d}-{made:06d}.warc.gz"]), pa.array([len(members)], pa.int64()), pa.array([b"".join(members)], pa.binary())], names=["archive", "records", "data"])

        for batch in batches:
            for part in textscan.slices(batch, "payload", ARCHIVE_BYTES):
                for cells in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    page, url, payload, top = cells
                    members.append(record(page, url, payload, top, top is not None))
                    size += len(members[-1])
                    if size >= ARCHIVE_BYTES:
                        yield row()
                        made, members, size = made + 1, [], 0
        if members:
            yield row()

    return marked.mapInArrow(write, "archive string, records long, data binary")


def records(stored: DataFrame, column: str = "data") -> DataFrame:
    """The records of archives that a binary column holds."""
    def rows(held: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), _SCHEMA, strict=True)], schema=_SCHEMA)

    def run(batches):
        for batch in batches:
            for cell in batch.column(0):
                held, size = [], 0
                for row in read(cell.as_py() or b""):
                    held.append(row)
                    size += len(row[6] or b"")
                    if size > textscan.SLICE_BYTES or len(held) >= 5000:
                        yield rows(held)
                        held, size = [], 0
                if held:
                    yield rows(held)

    return stored.select(column).mapInArrow(run, RECORDS)


def write_archives(pages: DataFrame, path: str, least_bytes: int = 0) -> None:
    """Writes the archives as a table of one binary row each."""
    archives(pages, least_bytes).write.option("compression", "none").parquet(path)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    return records(spark.read.parquet(path))


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """The records of ``.warc.gz`` files."""
    return records(spark.read.format("binaryFile").load(path).select("content"), "content")


def round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Writes the pages to archives in the shared folder and reads every record back."""
    scratch = Scratch(pages.sparkSession)
    return records(scratch.keep(archives(pages, least_bytes)))
