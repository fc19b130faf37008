"""Folders and archives as a data source: listed, indexed and read in tasks, in partitions of even size.

1. ``listing`` goes down a folder level by level.  A level's folders are rows, and
   tasks list them; the driver learns only how many folders come next.
2. ``units`` gives what is to be read.  A file is one unit.  Tasks read the
   directory at the end of a zip file, and pass from header to header of a tar
   file, so that each member is a unit with its place: an archive of any size is
   read by as many tasks as its members fill.  Archives that are one compressed
   stream (``.tar.gz``, ``.tgz``, ``.gz``) have no such places and are one unit.
3. ``planned`` puts units, in the order of their places, into runs of about
   ``RUN_BYTES`` and writes them as a table.
4. ``RunSource`` is a Python data source over that table.  Its partitions are runs,
   which it finds in the table's footers; a task reads its run's units and nothing
   else.

File systems are those of pyarrow (local, HDFS, S3, GCS, Azure).  ``known`` says
whether a path is on one.

Defined cases: an unreadable folder, file or member, a member that is encrypted,
damaged, or larger than ``MEMBER_BYTES`` is a row with ``error``; an archive in
which a path climbs out is refused as a whole; links to folders aren't followed;
a path that isn't there is an error.
"""

from __future__ import annotations

import gzip
import posixpath
import re
import struct
import tarfile
import zipfile
import zlib
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .. import scratch

# The endings of archives.
ARCHIVES = (".zip", ".tar", ".tar.gz", ".tgz", ".gz")
#: Bytes that a task reads, about; units in a file of the plan; bytes of contents that are passed on at a time.
RUN_BYTES, PLAN_UNITS, PASS_BYTES = 64 << 20, 50_000, 4 << 20
#: The most that a file, or a member of an archive, may have.
MEMBER_BYTES = 1 << 30

LISTED = "inner string, size long, folder boolean, error string"
UNITS = "inner string, member string, how string, start long, packed long, size long, method int, crc long, error string"
PLANNED = f"run int, {UNITS}"
READ = "path string, name string, content binary, error string"
_PLANNED = pa.schema([("run", pa.int32()), *((n, pa.string()) for n in ("inner", "member", "how")), *((n, pa.int64()) for n in ("start", "packed", "size")), ("method", pa.int32()), ("crc", pa.int64()), ("error", pa.string())])


def system(path: str) -> tuple[fs.FileSystem, str]:
    """(file system, path within) of a path."""
    local = re.sub("^file:/*", "/", path)
    if local.startswith("/"):
        return fs.LocalFileSystem(), local.rstrip("/") or "/"
    found, inner = fs.FileSystem.from_uri(path)
    return found, inner.rstrip("/")


def known(path: str) -> bool:
    try:
        system(path)
        return True
    except (pa.ArrowException, OSError, ValueError):
        return False


def _prefix(root: str) -> str:
    """What stands before a path within the file system."""
    if re.sub("^file:/*", "/", root).startswith("/"):
        return "file:"
    inner = system(root)[1]
    return root.rstrip("/").removesuffix(inner) or re.match(r"^[^:]+://", root)[0]


def is_archive(path: str) -> bool:
    return path.lower().endswith(ARCHIVES)


def _said(e: Exception) -> str:
    return f"{type(e).__name__}: {e}"


# ---- listing --------------------------------------------------------------------------------------------------------


def listing(spark: SparkSession, root: str, recursive: bool = True, without: tuple[str, ...] = ()) -> DataFrame:
    """(inner, size, folder, error) of the files under a folder, or of one file; entries of the names in ``without`` are left out."""
    there, base = system(root)
    info = there.get_file_info(base)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(root)
    if info.type == fs.FileType.File:
        return spark.createDataFrame([(base, info.size, False, None)], LISTED)

    def run(batches):
        here, _ = system(root)
        local = isinstance(here, fs.LocalFileSystem)
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                try:
                    found = here.get_file_info(fs.FileSelector(folder))
                    # A link may lead back up, so those to folders end here.
                    rows = [(x.path, x.size, x.type == fs.FileType.Directory, None) for x in found if x.base_name.lower() not in without and not (local and x.type == fs.FileType.Directory and _is_link(x.path))]
                except Exception as e:  # a folder that can't be listed never fails the others
                    rows = [(folder, None, False, _said(e))]
                yield from _batches(rows, [("inner", pa.string()), ("size", pa.int64()), ("folder", pa.bool_()), ("error", pa.string())])

    level, out, n = spark.createDataFrame([(base,)], "inner string"), None, 1
    while n:
        found = scratch.keep(level.repartition(max(1, min(n, 4 * spark.sparkContext.defaultParallelism))).mapInArrow(run, LISTED))
        files = found.where("not folder")
        out = files if out is None else out.unionByName(files)
        level = found.where("folder").select("inner")
        n = level.count() if recursive else 0
    return out


def _is_link(path: str) -> bool:
    import os

    return os.path.islink(path)


def _batches(rows: list[tuple], schema: list[tuple[str, pa.DataType]]) -> Iterator[pa.RecordBatch]:
    for k in range(0, len(rows), 10_000):
        some = rows[k : k + 10_000]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in some], t) for i, (_, t) in enumerate(schema)], names=[n for n, _ in schema])


# ---- units ----------------------------------------------------------------------------------------------------------


def _clean(inner: str) -> str:
    clean = posixpath.normpath(inner.replace("\\", "/"))
    if clean.startswith(("/", "..")) or re.match(r"^[A-Za-z]:", clean):
        raise ValueError(f"unsafe path in archive: {inner!r}")
    return clean


def _index(inner: str, f: Any) -> list[tuple]:
    """The units of an archive, from its directory or headers alone."""
    low, out = inner.lower(), []
    if low.endswith(".zip"):
        with zipfile.ZipFile(f) as z:
            for i in z.infolist():
                if not i.is_dir():
                    bad = "is encrypted" if i.flag_bits & 1 else f"has more than {MEMBER_BYTES} bytes" if i.file_size > MEMBER_BYTES else None
                    out.append((inner, _clean(i.filename), "zip", i.header_offset, i.compress_size, i.file_size, i.compress_type, i.CRC, bad and f"ValueError: {i.filename!r} {bad}"))
    elif low.endswith(".tar"):
        try:
            with tarfile.open(fileobj=f, mode="r:") as t:
                for i in t:
                    if i.isfile():
                        bad = f"ValueError: {i.name!r} has more than {MEMBER_BYTES} bytes" if i.size > MEMBER_BYTES else None
                        out.append((inner, _clean(i.name), "sparse" if i.sparse else "tar", i.offset if i.sparse else i.offset_data, i.size, i.size, 0, None, bad))
        except tarfile.TarError as e:  # what stands before the damage is read all the same
            out.append((inner, None, "file", 0, 0, 0, 0, None, _said(e)))
    else:
        out.append((inner, None, "stream", 0, f.size(), f.size(), 0, None, None))
    return out


def units(listed: DataFrame, root: str, archives: bool) -> DataFrame:
    """The units of listed files; with ``archives`` those in archives too."""
    as_file = listed.select("inner", F.lit(None).cast("string").alias("member"), F.lit("file").alias("how"), F.lit(0).cast("long").alias("start"), F.col("size").alias("packed"), "size", F.lit(0).alias("method"), F.lit(None).cast("long").alias("crc"), "error")
    if not archives:
        return as_file
    packed = F.lower("inner").rlike("(" + "|".join(map(re.escape, ARCHIVES)) + ")$") & F.col("error").isNull()

    def run(batches):
        here, _ = system(root)
        kinds = [(f.name, f.type) for f in list(_PLANNED)[1:]]
        for batch in batches:
            for inner in batch.column(0).to_pylist():
                try:
                    with here.open_input_file(inner) as f:
                        rows = _index(inner, f)
                except Exception as e:  # one bad archive never fails the others
                    rows = [(inner, None, "file", 0, 0, 0, 0, None, _said(e))]
                yield from _batches(rows, kinds)

    inside = scratch.keep(listed.where(packed).select("inner").repartition(max(1, listed.sparkSession.sparkContext.defaultParallelism)).mapInArrow(run, UNITS))
    return as_file.where(~packed).unionByName(inside)


def unit_path(root: str) -> Column:
    """The path of a unit: the file's, or archive/member."""
    base = F.regexp_extract("inner", r"([^/]*)$", 1)
    return F.when(F.col("member").isNotNull(), F.concat(base, F.lit("/"), "member")).when(F.col("how") == "stream", base).otherwise(F.concat(F.lit(_prefix(root)), F.col("inner")))


def planned(found: DataFrame, run_bytes: int = RUN_BYTES) -> str:
    """Writes the plan of these units; where it lies."""

    def run(batches):
        number, held = 0, 0
        for batch in batches:
            runs = []
            for size in batch.column(4).to_pylist():
                size = (size or 0) + 512
                if held and held + size > run_bytes:
                    number, held = number + 1, 0
                held += size
                runs.append(number)
            yield pa.RecordBatch.from_arrays([pa.array(runs, pa.int32()), *batch.columns], names=_PLANNED.names)

    total = found.agg(F.count("*").alias("n"), F.coalesce(F.sum("packed"), F.lit(0)).alias("bytes")).first()
    parts = max(1, -(-total.n // PLAN_UNITS), min(found.sparkSession.sparkContext.defaultParallelism, -(-total.bytes // run_bytes)))
    path = scratch.new_dir(found.sparkSession)
    found.repartitionByRange(parts, "inner", "start").sortWithinPartitions("inner", "start").mapInArrow(run, PLANNED).write.parquet(path)
    return path


# ---- reading --------------------------------------------------------------------------------------------------------


def _inflated(f: Any, packed: int, size: int) -> bytes:
    d, out, n = zlib.decompressobj(-15), [], 0
    while packed and not d.eof:
        data = f.read(min(packed, 1 << 20))
        if not data:
            break
        packed -= len(data)
        piece = d.decompress(data, size + 1 - n)
        while piece:
            n += len(piece)
            if n > size:
                raise ValueError(f"unpacks to more than the {size} bytes that it says")
            out.append(piece)
            piece = d.decompress(d.unconsumed_tail, size + 1 - n)
    return b"".join(out)


def _zip_member(f: Any, u: dict) -> bytes:
    if u["method"] not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
        with zipfile.ZipFile(f) as z:  # other methods go through the library, which reads the directory again
            return z.read(next(i for i in z.infolist() if i.header_offset == u["start"]))
    f.seek(u["start"])
    head = f.read(30)
    if head[:4] != b"PK\x03\x04":
        raise ValueError("no member begins where the directory says")
    f.seek(u["start"] + 30 + sum(struct.unpack("<HH", head[26:30])))
    data = f.read(u["packed"]) if u["method"] == zipfile.ZIP_STORED else _inflated(f, u["packed"], u["size"])
    if len(data) != u["size"] or zlib.crc32(data) != u["crc"]:
        raise ValueError("bytes or checksum are not what the directory says")
    return data


def _tar_member(f: Any, u: dict) -> bytes:
    if u["how"] == "sparse":
        f.seek(u["start"])
        with tarfile.open(fileobj=f, mode="r:") as t:
            return t.extractfile(t.next()).read()
    f.seek(u["start"])
    data = f.read(u["size"])
    if len(data) != u["size"]:
        raise ValueError("the archive ends within a member")
    return data


def _stream(inner: str, f: Any) -> Iterator[tuple[str, str, bytes | None, str | None]]:
    """(path, name, content, error) of the members of a compressed stream, one at a time."""
    base = posixpath.basename(inner)
    try:
        if inner.lower().endswith((".tar.gz", ".tgz")):
            with tarfile.open(fileobj=f, mode="r|gz") as t:
                for i in t:
                    if i.isfile():
                        name = _clean(i.name)
                        if i.size > MEMBER_BYTES:
                            yield f"{base}/{name}", posixpath.basename(name), None, f"ValueError: {name!r} has more than {MEMBER_BYTES} bytes"
                        else:
                            yield f"{base}/{name}", posixpath.basename(name), t.extractfile(i).read(), None
        else:
            with gzip.open(f) as g:
                data = g.read(MEMBER_BYTES + 1)
            name, much = base[:-3], len(data) > MEMBER_BYTES
            yield f"{base}/{name}", name, None if much else data, f"ValueError: {name!r} has more than {MEMBER_BYTES} bytes" if much else None
    except Exception as e:
        yield base, base, None, _said(e)


def _contents(here: fs.FileSystem, prefix: str, found: list[dict]) -> Iterator[tuple[str, str, bytes | None, str | None]]:
    """The contents of a run's units; an archive is opened once for neighbours."""
    opened, f = None, None
    try:
        for u in found:
            inner, member = u["inner"], u["member"]
            base = posixpath.basename(inner)
            path = f"{base}/{member}" if member is not None else prefix + inner
            name = posixpath.basename(member or inner)
            if u["error"] is not None:
                yield path, name, None, u["error"]
                continue
            try:
                if opened != inner:
                    if f is not None:
                        f.close()
                    opened, f = None, None
                    f = here.open_input_file(inner)
                    opened = inner
                if u["how"] == "stream":
                    yield from _stream(inner, f)
                    opened, f = None, None if f.closed else f.close()
                    continue
                if u["how"] == "file" and u["size"] > MEMBER_BYTES:
                    raise ValueError(f"has more than {MEMBER_BYTES} bytes")
                content = f.read() if u["how"] == "file" else _zip_member(f, u) if u["how"] == "zip" else _tar_member(f, u)
            except Exception as e:  # one bad file never fails the others
                yield path, name, None, _said(e)
            else:
                yield path, name, content, None
    finally:
        if f is not None and not f.closed:
            f.close()


class Run(InputPartition):
    """A run of the plan: a file of it, and its number there."""

    def __init__(self, file: str, number: int) -> None:
        self.file, self.number = file, number


class RunReader(DataSourceReader):
    def __init__(self, plan: str, root: str) -> None:
        self.plan, self.root = plan, root

    def partitions(self) -> list[Run]:
        """The runs, by the greatest number in the footer of each file of the plan: units are not read here."""
        here, base = system(self.plan)
        out = []
        for x in here.get_file_info(fs.FileSelector(base)):
            if x.path.endswith(".parquet"):
                with here.open_input_file(x.path) as f:
                    meta = pq.read_metadata(f)
                groups = [meta.row_group(k).column(0).statistics.max for k in range(meta.num_row_groups) if meta.row_group(k).num_rows]
                out += [Run(x.path, k) for k in range(max(groups) + 1 if groups else 0)]
        return out or [Run("", 0)]

    def read(self, partition: Run) -> Iterator[pa.RecordBatch]:
        if not partition.file:
            return
        here, _ = system(self.plan)
        with here.open_input_file(partition.file) as f:
            found = pq.read_table(f, filters=[("run", "=", partition.number)]).to_pylist()
        files, _ = system(self.root)
        kinds = [("path", pa.string()), ("name", pa.string()), ("content", pa.binary()), ("error", pa.string())]
        held, n = [], 0
        for row in _contents(files, _prefix(self.root), found):
            held.append(row)
            n += len(row[2] or b"")
            if n >= PASS_BYTES:
                yield from _batches(held, kinds)
                held, n = [], 0
        yield from _batches(held, kinds)


class RunSource(DataSource):
    """Reads a plan of ``planned``: options ``path`` (the plan) and ``root`` (what was listed)."""

    @classmethod
    def name(cls) -> str:
        return "folioloom_runs"

    def schema(self) -> str:
        return READ

    def reader(self, schema: Any) -> RunReader:
        return RunReader(self.options["path"], self.options["root"])


def read(found: DataFrame, root: str, run_bytes: int = RUN_BYTES) -> DataFrame:
    """(path, name, content, error) of these units, with a partition for each run."""
    spark = found.sparkSession
    spark.dataSource.register(RunSource)
    return spark.read.format(RunSource.name()).option("root", root).load(planned(found, run_bytes))
