"""Embedding near-duplicates by PCA-ordered tiles.

Unit vectors are rotated onto the principal axes of the whole table, so that the
leading dimensions carry most of every product, and ordered by bands of the first
``CELLS`` axes into tiles.  A cosine of at least t means a distance of at most
sqrt(2 - 2 t), so only tiles whose boxes on the first ``BOX`` axes come that close
are compared; they meet in an equi-join on cells of that width.  A tile is sent
once for every ``PARTNERS`` tiles that it is compared with.

A pair of tiles accumulates products over the leading dimensions first.  What
the other dimensions can add is at most the product of the vectors' suffix
norms; pairs whose sum with that bound stays under the threshold are dropped,
and a block of pairs stops as soon as none is left.  Pairs that last to the end
are decided in double precision.

Equal vectors are one class with a count (known by a 64-bit hash, and a second one
proves that no class holds different vectors), so that copies are never compared with
each other.  A tile pair reports, per class with links, their number and one edge
to the smallest member of its piece; links are not listed pair by pair.

Defined cases: vectors that are null, empty or zero, or hold null or non-finite
components, link with nothing, and so do vectors of different lengths; rows that
repeat an id are vectors of their own; rows of a null id are never kept, and
their component is the smallest id of the others in it, if any.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, components

THRESHOLD = 0.95
TILE = 4096
#: Leading axes whose bands order the vectors, and those on which tiles have boxes.
CELLS, BOX = 3, 8
#: Tiles that one tile is compared with in a group.
PARTNERS = 8
#: Rows of a tile that are multiplied at a time.
ROWS = 512
#: Single precision may be off by this much before double precision decides.
SLACK = 1e-4


def _units(cells: list) -> np.ndarray:
    a = np.array(cells, np.float64)
    a /= np.abs(a).max(axis=1, keepdims=True)
    return a / np.sqrt((a * a).sum(axis=1, keepdims=True))


def _by_size(batch: pa.RecordBatch, column: int):
    """(dimension, rows, unit vectors) of the batch."""
    lengths = np.asarray(batch.column(column).value_lengths())
    for d in np.unique(lengths):
        rows = np.flatnonzero(lengths == d)
        yield int(d), rows, _units(batch.column(column).take(pa.array(rows)).to_pylist())


def _axes(classes: DataFrame) -> dict[int, np.ndarray]:
    """Principal axes by dimension, the leading one first, from the second moments of all classes."""

    def run(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for d, _, u in _by_size(batch, 0):
                total[d] = total.get(d, 0) + u.T @ u
        for d, m in total.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(d * d, d)), pa.array(np.arange(d * d)), pa.array(m.ravel())], names=["d", "k", "x"])

    rows = classes.select("v").mapInArrow(run, "d long, k long, x double").groupBy("d", "k").agg(F.sum("x").alias("x")).toArrow()
    d, k, x = (rows.column(i).to_numpy() for i in range(3))
    out = {}
    for n in np.unique(d).tolist():
        m = np.zeros(n * n)
        m[k[d == n]] = x[d == n]
        out[n] = np.linalg.eigh(m.reshape(n, n))[1][:, ::-1]
    return out


def _spread(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """The smallest node of each node's piece, for edges between nodes below n."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, i, label[j])
        np.minimum.at(new, j, label[i])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def compare(a: np.ndarray, b: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (i, j) of rotated unit vectors whose cosine is at least the threshold."""
    d = a.shape[1]
    steps = [k for k in (max(4, d // 4), max(8, d // 2)) if k < d] + [d]
    a32, b32 = a.astype(np.float32), b.astype(np.float32)
    rest_a, rest_b = ([np.sqrt(np.maximum((x[:, k:] ** 2).sum(axis=1), 0)).astype(np.float32) for k in steps] for x in (a32, b32))
    least, found_i, found_j = np.float32(threshold - SLACK), [], []
    for start in range(0, len(a), ROWS):
        rows = slice(start, start + ROWS)
        part = np.zeros((len(a32[rows]), len(b)), np.float32)
        before, i, j = 0, None, None
        for n, k in enumerate(steps):
            if i is None:
                part += a32[rows, before:k] @ b32[:, before:k].T
                alive = part + rest_a[n][rows, None] * rest_b[n][None] >= least
                count = int(np.count_nonzero(alive))
                if count == 0:
                    break
                if count < alive.size // 50:
                    i, j = np.nonzero(alive)
                    some = part[i, j]
            else:
                some = some + np.einsum("ij,ij->i", a32[i + start, before:k], b32[j, before:k])
                keep = some + rest_a[n][i + start] * rest_b[n][j] >= least
                i, j, some = i[keep], j[keep], some[keep]
                if len(i) == 0:
                    break
            before = k
        else:
            if i is None:
                i, j = np.nonzero(alive & (a[rows] @ b.T >= threshold))
            else:
                keep = np.einsum("ij,ij->i", a[i + start], b[j]) >= threshold
                i, j = i[keep], j[keep]
            found_i.append(i + start)
            found_j.append(j)
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *found_i]), np.concatenate([none, *found_j])


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, tile: int = TILE, scratch: Scratch | None = None) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row."""
    spark = vectors.sparkSession
    scratch = scratch or Scratch(spark)
    v = F.col("v")
    sound = F.coalesce(v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    rows = rows.withColumns({"h": F.when(sound, F.xxhash64("v")), "proof": F.xxhash64(F.lit(1), "v")})
    proved = F.when(F.min("proof") == F.max("proof"), F.lit(True)).otherwise(F.raise_error(F.lit("two different vectors have one hash")).cast("boolean"))
    classes = rows.where("h is not null").groupBy("h").agg(F.any_value("v").alias("v"), F.count("*").alias("m"), F.min("vec_id").alias("low"), proved.alias("proved"))
    classes = scratch.keep(classes.where("proved").drop("proved"))
    width = math.sqrt(2 - 2 * threshold) + 1e-6
    axes = spark.sparkContext.broadcast(_axes(classes))

    def rotate(batches):
        for batch in batches:
            for d, which, u in _by_size(batch, 2):
                r = u @ axes.value[d]
                part, lead = batch.take(pa.array(which)), np.zeros((len(r), CELLS))
                lead[:, : min(d, CELLS)] = r[:, :CELLS]
                bands = np.floor(lead / width).astype(np.int64).T
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(np.full(len(r), d)), *map(pa.array, bands), pa.array(r[:, 0]), pa.array([x.tobytes() for x in r], pa.binary())],
                    names=["h", "m", "d", *(f"b{k}" for k in range(CELLS)), "x", "r"],
                )

    def pack(batches):
        from pyspark import TaskContext

        held: list[tuple] = []
        made = TaskContext.get().partitionId() << 24

        def row():
            h, m, d, r = zip(*held, strict=True)
            box = np.zeros((2, BOX))
            lead = np.frombuffer(b"".join(r)).reshape(len(r), -1)[:, :BOX]
            box[:, : lead.shape[1]] = lead.min(axis=0), lead.max(axis=0)
            return pa.RecordBatch.from_arrays(
                [pa.array([made]), pa.array([d[0]]), *(pa.array([x.tolist()], pa.list_(pa.float64())) for x in box), pa.array([np.array(h, np.int64).tobytes()]), pa.array([np.array(m, np.int64).tobytes()]), pa.array([b"".join(r)], pa.binary())],
                names=["t", "d", "lo", "hi", "hs", "ms", "rs"],
            )

        for batch in batches:
            for cells in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and (len(held) >= tile or cells[2] != held[0][2]):
                    yield row()
                    made += 1
                    held = []
                held.append(cells)
        if held:
            yield row()

    lead = [f"b{k}" for k in range(CELLS)]
    rotated = classes.select("h", "m", "v").mapInArrow(rotate, "h long, m long, d long, " + ", ".join(f"{c} long" for c in lead) + ", x double, r binary")
    rotated = scratch.keep(rotated)
    n = rotated.count()
    ordered = rotated.repartitionByRange(max(1, -(-n // tile)), "d", *lead, "x").sortWithinPartitions("d", *lead, "x").select("h", "m", "d", "r")
    tiles = scratch.keep(ordered.mapInArrow(pack, "t long, d long, lo array<double>, hi array<double>, hs binary, ms binary, rs binary"))

    spans = tiles.select("t", "d", "lo", "hi")

    def cells(name: str, more: float) -> DataFrame:
        """A row for each cell that the tile's box, widened by this, has a part in."""
        out = spans.select(F.col("t").alias(name), "d", F.col("lo").alias(f"lo_{name}"), F.col("hi").alias(f"hi_{name}"))
        for k in range(CELLS):
            band = lambda c: F.floor(c / width)
            out = out.withColumn(f"c{k}", F.explode(F.sequence(band(F.col(f"lo_{name}")[k] - more), band(F.col(f"hi_{name}")[k] + more))))
        return out

    gap = F.zip_with(F.zip_with("lo_a", "hi_b", lambda x, y: x - y), F.zip_with("lo_b", "hi_a", lambda x, y: x - y), lambda x, y: F.greatest(x, y, F.lit(0.0)))
    apart = F.aggregate(gap, F.lit(0.0), lambda s, x: s + x * x)
    pairs = cells("a", 0.0).join(cells("b", width), ["d", *(f"c{k}" for k in range(CELLS))]).where("a <= b").where(apart <= width * width).select("a", "b").distinct()
    # A tile meets its partners in groups of about PARTNERS, so that no group has too many and the tile is sent once for each.
    groups = F.ceil(F.count("*").over(Window.partitionBy("a")) / PARTNERS)
    pairs = scratch.keep(pairs.withColumn("part", F.pmod(F.xxhash64("b"), groups)))
    stored = tiles.select("t", "d", "hs", "ms", "rs")
    left = pairs.select("a", "part").distinct().join(stored, F.col("a") == F.col("t")).drop("t")
    right = pairs.join(stored, F.col("b") == F.col("t")).select("a", "part", "b", "hs", "ms", "rs")

    found_schema = pa.schema([("h", pa.int64()), ("root", pa.int64()), ("links", pa.int64())])

    def met(a: np.ndarray, h1: np.ndarray, m1: np.ndarray, b: np.ndarray, h2: np.ndarray, m2: np.ndarray, same: bool) -> pa.RecordBatch:
        """Of each class with links in these two tiles: their number, and the first class of its piece."""
        i, j = compare(a, b, threshold)
        if same:
            i, j = i[i < j], j[i < j]
            keys, weight = h1, m1
        else:
            j = j + len(a)
            keys, weight = np.concatenate([h1, h2]), np.concatenate([m1, m2])
        counts = np.zeros(len(keys), np.int64)
        np.add.at(counts, i, weight[j])
        np.add.at(counts, j, weight[i])
        root = _spread(i, j, len(keys)) if len(i) else np.arange(len(keys))
        some = np.flatnonzero(counts > 0)
        return pa.RecordBatch.from_arrays([pa.array(keys[some]), pa.array(keys[root[some]]), pa.array(counts[some])], schema=found_schema)

    def multiply(one: pa.Table, others: pa.Table) -> pa.Table:
        d, tile_a = one.column("d")[0].as_py(), one.column("a")[0].as_py()

        def read(t: pa.Table, k: int, mark: str = ""):
            h, m, r = (t.column(mark + c)[k].as_py() for c in ("hs", "ms", "rs"))
            return np.frombuffer(r).reshape(-1, d), np.frombuffer(h, np.int64), np.frombuffer(m, np.int64)

        a = read(one, 0)
        return pa.Table.from_batches([met(*a, *read(others, k, "_"), others.column("b")[k].as_py() == tile_a) for k in range(others.num_rows)], schema=found_schema)

    right = right.toDF("_a", "_part", "b", "_hs", "_ms", "_rs")
    both = left.toDF("a", "part", "d", "hs", "ms", "rs").groupBy("a", "part").cogroup(right.groupBy("_a", "_part"))
    found = scratch.keep(both.applyInArrow(multiply, "h long, root long, links long"))
    links = found.groupBy("h").agg(F.sum("links").alias("links"))
    roots = components(found.select("h", "root"), scratch).toDF("h", "root")
    of = classes.select("h", "m", "low").join(links, "h", "left").join(roots, "h", "left").withColumn("root", F.coalesce("root", "h"))
    least = of.groupBy("root").agg(F.min("low").alias("least"))
    of = of.join(least, "root").select("h", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links"), "least")
    out = rows.select("vec_id", "h").join(of, "h", "left")
    component = F.when(F.col("h").isNull(), F.col("vec_id")).otherwise(F.col("least"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
