"""Folders and archives read in planned runs; tables whose rows can be replaced."""

import gzip
import io
import os
import random
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from folioloom.sinks import buckets
from folioloom.sources import folders, readers


def read(spark, path, run_bytes=1000, archives=False):
    units = folders.units(folders.listing(spark, str(path)), str(path), archives)
    return folders.read(units, str(path), run_bytes)


def test_listing_goes_down_and_passes_links_by(spark, tmp_path):
    for k in range(40):
        place = tmp_path / f"d{k % 7}" / f"_e{k % 3}" / (".f" if k % 2 else "g h#%25é")
        place.mkdir(parents=True, exist_ok=True)
        (place / f"{k}.txt").write_text("x" * k)
    os.symlink(tmp_path, tmp_path / "d0" / "up")
    (tmp_path / "empty").mkdir()
    found = {r.inner: r.size for r in folders.listing(spark, str(tmp_path)).collect()}
    want = {str(p): p.stat().st_size for p in tmp_path.rglob("*.txt")}
    assert found == want and len(want) == 40
    assert [r.inner for r in folders.listing(spark, str(tmp_path / "d0"), recursive=False).collect()] == []
    assert all("/d1/" not in r.inner for r in folders.listing(spark, str(tmp_path), without=("d1",)).collect())
    with pytest.raises(FileNotFoundError):
        folders.listing(spark, str(tmp_path / "nothing"))


def test_runs_are_even_and_whole(spark, tmp_path):
    rng = random.Random(1)
    for k in range(120):
        (tmp_path / f"{k:03d}.txt").write_bytes(rng.randbytes(rng.randrange(400)))
    (tmp_path / "large.txt").write_bytes(b"y" * 5000)
    df = read(spark, f"file://{tmp_path}", 2000)
    assert {r.name: bytes(r.content) for r in df.collect()} == {p.name: p.read_bytes() for p in tmp_path.iterdir()}
    sizes = df.groupBy(F.spark_partition_id().alias("p")).agg(F.sum(F.length("content")).alias("n"), F.count("*").alias("files")).collect()
    assert len(sizes) > 20 and all(r.n <= 2000 or r.files == 1 for r in sizes)
    assert read(spark, tmp_path / "large.txt").first().path == f"file:{tmp_path}/large.txt"
    (tmp_path / "none").mkdir()
    assert read(spark, tmp_path / "none").collect() == []


def test_one_archive_is_read_by_several_tasks(spark, tmp_path):
    rng = random.Random(2)
    members = {f"a/{k}.txt": rng.randbytes(300) if k % 2 else b"z" * 3000 for k in range(50)}
    with zipfile.ZipFile(tmp_path / "m.zip", "w") as z:
        for k, (name, data) in enumerate(members.items()):
            z.writestr(name, data, (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED, zipfile.ZIP_BZIP2, zipfile.ZIP_LZMA)[k % 4])
    with tarfile.open(tmp_path / "m.tar", "w") as t:
        for name, data in members.items():
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
        t.addfile(tarfile.TarInfo("link.txt"))
    for name in ("m.zip", "m.tar"):
        df = read(spark, tmp_path / name, 2000, archives=True)
        got = {r.path: bytes(r.content) for r in df.where("path not like '%link.txt'").collect()}
        assert got == {f"{name}/{k}": v for k, v in members.items()}
        assert df.select(F.spark_partition_id()).distinct().count() > 4
    # A folder of archives, some of them compressed streams.
    with tarfile.open(tmp_path / "s.tgz", "w:gz") as t:
        info = tarfile.TarInfo("in/s.txt")
        info.size = 3
        t.addfile(info, io.BytesIO(b"abc"))
    (tmp_path / "n.txt.gz").write_bytes(gzip.compress(b"alone"))
    got = {r.path: bytes(r.content) for r in readers.archive_files(spark, str(tmp_path)).collect()}
    assert len(got) == 103 and got["s.tgz/in/s.txt"] == b"abc" and got["n.txt.gz/n.txt"] == b"alone"


def test_damaged_archives_and_large_members(spark, tmp_path, monkeypatch):
    with zipfile.ZipFile(tmp_path / "bad.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("good.txt", b"good" * 50)
        z.writestr("hurt.txt", b"0123456789" * 50)
    data = bytearray((tmp_path / "bad.zip").read_bytes())
    at = data.index(b"hurt.txt") + len(b"hurt.txt")
    data[at + 3] ^= 255
    (tmp_path / "bad.zip").write_bytes(data)
    with zipfile.ZipFile(tmp_path / "evil.zip", "w") as z:
        z.writestr("ok.txt", "x")
        z.writestr("../../evil.txt", "x")
    (tmp_path / "no.zip").write_bytes(b"not a zip")
    with tarfile.open(tmp_path / "cut.tar", "w") as t:
        info = tarfile.TarInfo("c.txt")
        info.size = 30_000
        t.addfile(info, io.BytesIO(b"c" * 30_000))
    (tmp_path / "cut.tar").write_bytes((tmp_path / "cut.tar").read_bytes()[:20_000])
    rows = {r.path: r for r in read(spark, tmp_path, 1000, archives=True).collect()}
    assert bytes(rows["bad.zip/good.txt"].content) == b"good" * 50 and rows["bad.zip/hurt.txt"].error
    errors = {p.split("/")[-1]: r.error for p, r in rows.items() if r.error}
    assert set(errors) == {"hurt.txt", "evil.zip", "no.zip", "c.txt", "cut.tar"} and "unsafe" in errors["evil.zip"]
    # What says to be small and isn't is not unpacked any further.
    with zipfile.ZipFile(tmp_path / "bomb.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("bomb.txt", b"\0" * 100_000)
    data = (tmp_path / "bomb.zip").read_bytes().replace((100_000).to_bytes(4, "little"), (10).to_bytes(4, "little"))
    (tmp_path / "bomb.zip").write_bytes(data)
    assert "more than the 10 bytes" in read(spark, tmp_path / "bomb.zip", 1000, archives=True).first().error


ROWS = "doc_id string, chunk_id string, page string, n int"


def held(df):
    return sorted(tuple(r) for r in df.collect())


def test_documents_are_replaced_whole(spark, tmp_path):
    table = buckets.BucketTable(spark, str(tmp_path / "t"), ROWS, "doc_id", 8)
    make = lambda *rows: spark.createDataFrame(list(rows), ROWS)
    assert table.read().count() == 0 and table.replace(make()) is None and table.versions() == []
    many = [(f"d{k}", f"d{k}-{j}", "first", j) for k in range(30) for j in range(3)]
    assert table.replace(make(*many)) == 1
    before = table.manifest()
    assert table.replace(make(("d1", "d1-0", "second", 0), (None, "x", "no id", 1))) == 2
    want = sorted([r for r in many if r[0] != "d1"] + [("d1", "d1-0", "second", 0)])
    assert held(table.read().where("doc_id is not null")) == want
    assert held(table.of("d1")) == [("d1", "d1-0", "second", 0)] and held(table.of(None)) == [(None, "x", "no id", 1)]
    # Only the buckets of d1 and null were written anew.
    after = table.manifest()
    changed = {k for k in after["folders"] if after["folders"][k] != before["folders"].get(k)}
    assert len(changed) <= 2 and held(table.read(1)) == sorted(many)
    assert table.replace(make(), spark.createDataFrame([("d2",), ("unknown",)], "i string")) == 3
    assert held(table.of("d2")) == []
    assert table.delete(spark.createDataFrame([(None,)], "i string")) == 4 and held(table.of(None)) == []
    assert buckets.BucketTable(spark, str(tmp_path / "t"), ROWS, "doc_id", 99).buckets == 8


def test_a_write_that_ends_early_leaves_the_old_version(spark, tmp_path, monkeypatch):
    table = buckets.BucketTable(spark, str(tmp_path / "t"), ROWS, "doc_id", 4)
    make = lambda *rows: spark.createDataFrame(list(rows), ROWS)
    table.replace(make(("a", "a0", "old", 0), ("b", "b0", "old", 0)))

    def ends(_):
        raise RuntimeError("power cut")

    with monkeypatch.context() as m:
        m.setattr(table, "_commit", ends)
        with pytest.raises(RuntimeError):
            table.replace(make(("a", "a0", "new", 0)))
    assert held(table.read()) == [("a", "a0", "old", 0), ("b", "b0", "old", 0)] and table.versions() == [1]
    assert len(table.vacuum()) == 1
    table.replace(make(("a", "a0", "new", 0)))
    assert held(table.read()) == [("a", "a0", "new", 0), ("b", "b0", "old", 0)]
    gone = table.vacuum()
    assert "manifests/000000000001.json" in gone and held(table.read()) == [("a", "a0", "new", 0), ("b", "b0", "old", 0)]


def test_two_writers(spark, tmp_path, monkeypatch):
    one = buckets.BucketTable(spark, str(tmp_path / "t"), ROWS, "doc_id", 2)
    two = buckets.BucketTable(spark, str(tmp_path / "t"), ROWS, "doc_id", 2)
    make = lambda *rows: spark.createDataFrame(list(rows), ROWS)
    plain, first = one._commit, [True]

    def late(manifest):
        if first.pop() if first else False:
            two.replace(make(("b", "b0", "two", 0)))
        plain(manifest)

    monkeypatch.setattr(one, "_commit", late)
    assert one.replace(make(("a", "a0", "one", 0))) == 2
    assert held(one.read()) == [("a", "a0", "one", 0), ("b", "b0", "two", 0)]


def test_upserts(spark, tmp_path):
    table = buckets.BucketTable(spark, str(tmp_path / "t"), "id string, status string, at double", "id", 4)
    make = lambda *rows: spark.createDataFrame(list(rows), "id string, status string, at double")
    table.upsert(make(("a", "queued", 1.0), ("b", "queued", 1.0), ("a", "running", 2.0)), order="at")
    assert held(table.read()) == [("a", "running", 2.0), ("b", "queued", 1.0)]
    table.upsert(make(("a", "queued", 1.5), ("c", "queued", 3.0), (None, "queued", 1.0)), order="at")
    assert held(table.read().where("id is not null")) == [("a", "running", 2.0), ("b", "queued", 1.0), ("c", "queued", 3.0)]
    table.upsert(make(("a", "failed", 0.0)))
    assert held(table.of("a")) == [("a", "failed", 0.0)]
    with pytest.raises(ValueError):
        table.upsert(make(), key=["status"])
