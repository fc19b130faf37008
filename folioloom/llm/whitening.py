"""Embedding whitening with leading principal components found by LOBPCG.

Entries become whole numbers ``x = floor(256 * c)``.  The fit list is every
distinct x vector once; its mean and covariance (divisor n) are what whitening is
relative to.  The covariance is never formed: an iteration needs its product with
a block of a few vectors, which tasks sum over their centred rows, ``C'(C W)``,
and Spark adds up by dimension.

Locally optimal block preconditioned conjugate gradients, without a
preconditioner: the next iterate is the best one in the span of the current
block, its residuals and the last search directions, by a Rayleigh-Ritz step on
an orthonormal basis of all three.  Products of iterate and directions follow
from the basis, so only residuals go through the rows, one job a round.  The
block has ``GUARD`` vectors more than are asked for, which separates the last
component from those that follow.  Rounds end when the residuals of the wanted
vectors, taken from a product of their own, are certified: at most ``RESIDUAL``
of the largest eigenvalue, or no longer falling at the limit of double precision.
With as many block vectors as dimensions, the first step is already exact.

``whiten`` then projects every row, ``(x - S/n) . v / sqrt(e)``, and the largest
entry by which the fit list's covariance of that differs from the identity goes
along with each row.

Defined cases: rows are left out whose vector is null, empty or holds null or
non-finite entries, or has another length than most (of equally frequent lengths
the largest holds); entries past +-2**40 / 256 count as these bounds.  Components
without variance are left out, so vectors of fewer dimensions than components, one
distinct vector or none give fewer rows or none.  Repeated rows each get a row,
a null id too.  A deviation that no long can hold is null.  Other columns are
not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch

#: Vectors in the block beside those wanted; residuals, relative to the largest eigenvalue, that are small enough; most rounds.
GUARD, RESIDUAL, ROUNDS = 8, 1e-13, 400
#: Rounds without a better residual after which none is expected, and the residual that must have been reached by then.
PATIENCE, ENOUGH = 5, 1e-10
#: Share of a unit vector that must be new for it to widen a basis.
LEAST_NEW = 1e-6
#: Largest whole number that an entry becomes, and the most rows multiplied at a time.
LARGEST, ROWS = 1 << 40, 4096


def whole(vectors: DataFrame, id_column: str, column: str) -> DataFrame:
    """(id, x) of the usable rows of the commonest length."""
    c = F.transform(F.col(column), lambda e: e.cast("double"))
    sound = F.col(column).isNotNull() & (F.size(column) > 0) & F.forall(c, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    rows = vectors.where(sound)
    lengths = rows.groupBy(F.size(column).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    x = F.transform(c, lambda e: F.floor(F.greatest(F.least(e * 256, F.lit(float(LARGEST))), F.lit(-float(LARGEST)))).cast("long"))
    return rows.where(F.size(column) == (lengths.d if lengths else 0)).select(F.col(id_column).alias("id"), x.alias("x"))


def _matrix(column) -> np.ndarray:
    """The rows of a list column of one length."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _runs(batches, k: int = 0):
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS), _matrix(batch.slice(at, ROWS).column(k))


def sums(fit: DataFrame) -> tuple[int, list[int]]:
    """(n, per-dimension sums), exactly."""

    def run(batches):
        n, total = 0, None
        for _, x in _runs(batches):
            n += len(x)
            part = [sum(map(int, c)) if np.abs(c).max() > 1 << 40 else int(c.sum()) for c in x.T]
            total = part if total is None else [a + b for a, b in zip(total, part, strict=True)]
        if n:
            d = len(total)
            yield pa.RecordBatch.from_pydict({"i": np.arange(d), "n": np.full(d, n), "s": pa.array(map(str, total))})

    rows = fit.select("x").mapInArrow(run, "i long, n long, s string").groupBy("i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).orderBy("i").collect()
    return (rows[0].n if rows else 0), [int(r.s) for r in rows]


class Rows:
    """The fit list, centred, as far as products with a few vectors need it."""

    def __init__(self, fit: DataFrame, n: int, mean: np.ndarray) -> None:
        self.fit, self.n, self.mean, self.products = fit, n, mean, 0

    def times(self, block: np.ndarray) -> np.ndarray:
        """Covariance times block: partial products by task, added up by dimension."""
        mean, d, m = self.mean, *block.shape
        block = np.ascontiguousarray(block)

        def run(batches):
            total = np.zeros((d, m))
            for _, x in _runs(batches):
                c = x - mean
                total += c.T @ (c @ block)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(d)), *(pa.array(total[:, j]) for j in range(m))], names=["i", *(f"v{j}" for j in range(m))])

        names = [f"v{j}" for j in range(m)]
        parts = self.fit.select("x").mapInArrow(run, "i long, " + ", ".join(f"{v} double" for v in names))
        rows = parts.groupBy("i").agg(*(F.sum(v).alias(v) for v in names)).orderBy("i").toArrow()
        self.products += 1
        return np.column_stack([rows.column(v).to_numpy() for v in names]) / self.n

    def trace(self) -> float:
        mean = self.mean

        def run(batches):
            yield pa.RecordBatch.from_pydict({"t": [sum((float(((x - mean) ** 2).sum()) for _, x in _runs(batches)), 0.0)]})

        return self.fit.select("x").mapInArrow(run, "t double").agg(F.sum("t").alias("t")).first().t / self.n


def _basis(blocks: list[np.ndarray], images: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """An orthonormal basis of the blocks' span, block by block, and its image; directions that add nothing are left out."""
    q, image = blocks[0], images[0]
    for b, w in zip(blocks[1:], images[1:], strict=True):
        # First what is new in each vector, then what is new together; the second pass clears what rounding has left.
        for least in (LEAST_NEW, LEAST_NEW, 0.5):
            size = np.linalg.norm(b, axis=0)
            some = size > 0
            b, w = b[:, some] / size[some], w[:, some] / size[some]
            along = q.T @ b
            b, w = b - q @ along, w - image @ along
            some = np.linalg.norm(b, axis=0) > least
            b, w = b[:, some], w[:, some]
            if not b.shape[1]:
                break
            u, s, vt = np.linalg.svd(b, full_matrices=False)
            turn = vt[s > least * s[0]].T / s[s > least * s[0]]
            b, w = b @ turn, w @ turn
        q, image = np.hstack([q, b]), np.hstack([image, w])
    return q, image


def lobpcg(rows, d: int, wanted: int, guard: int = GUARD, seed: int = 7) -> tuple[np.ndarray, np.ndarray, float]:
    """(eigenvalues, unit eigenvectors as columns, certified residual relative to the largest eigenvalue), the largest first.

    ``rows.times(block)`` gives the matrix's product with a block.
    """
    m = min(d, wanted + guard)
    x = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, m)))[0] if m < d else np.eye(d)
    image = rows.times(x)
    directions = moved = None
    best, waited = (np.inf, None, None), 0
    for _ in range(ROUNDS):
        value, turn = np.linalg.eigh((x.T @ image + image.T @ x) / 2)
        turn = turn[:, ::-1]
        x, image, value = x @ turn, image @ turn, value[::-1]
        top = max(value[0], 0.0)
        residual = image - x * value
        size = np.linalg.norm(residual[:, :wanted], axis=0).max() / top if top else 0.0
        if size <= RESIDUAL or waited >= PATIENCE and best[0] <= ENOUGH or m == d:
            # Certified on a product of the vectors themselves, not on what the steps have carried along.
            x = np.linalg.qr(x)[0]
            image = rows.times(x)
            value, turn = np.linalg.eigh((x.T @ image + image.T @ x) / 2)
            x, image, value = x @ turn[:, ::-1], image @ turn[:, ::-1], value[::-1]
            residual = image - x * value
            size = np.linalg.norm(residual[:, :wanted], axis=0).max() / top if top else 0.0
            if size < best[0]:
                best = size, value, x
            if size <= 10 * RESIDUAL or waited >= PATIENCE or m == d:
                return best[1][:wanted], best[2][:, :wanted], best[0]
            directions = None
        if size < best[0]:
            best, waited = (size, value, x), 0
        else:
            waited += 1
        # The residuals' images cost one job; those of iterate and directions are known.
        residual = residual - x @ (x.T @ residual)
        norms = np.linalg.norm(residual, axis=0)
        residual = residual[:, norms > 0] / norms[norms > 0]
        if not residual.shape[1]:
            return value[:wanted], x[:, :wanted], size
        residual = np.linalg.svd(residual, full_matrices=False)[0]
        blocks, images = [x, residual], [image, rows.times(residual)]
        if directions is not None:
            blocks, images = [*blocks, directions], [*images, moved]
        q, product = _basis(blocks, images)
        value, turn = np.linalg.eigh((q.T @ product + product.T @ q) / 2)
        turn = turn[:, ::-1][:, :m]
        step = turn.copy()
        step[:m] = 0  # what the step adds to the iterate
        directions, moved = q @ step, product @ step
        x, image = q @ turn, product @ turn
    raise RuntimeError(f"eigenvectors are not certain after {ROUNDS} rounds: residual {best[0]:.1e}")


def whiten(vectors: DataFrame, components: int = 4, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) of each usable row and component from 1."""
    scratch = Scratch(vectors.sparkSession)
    id_type = vectors.schema[id_column].dataType
    schema = T.StructType([T.StructField(id_column, id_type), *(T.StructField(c, k()) for c, k in (("component", T.IntegerType), ("n", T.LongType), ("deviation", T.LongType), ("whitened", T.DoubleType), ("explained", T.DoubleType), ("identity_error", T.DoubleType)))])
    rows = scratch.keep(whole(vectors, id_column, column))
    fit = scratch.keep(rows.select("x").distinct())
    n, total = sums(fit)
    d = len(total)
    mean = np.array([s / n for s in total])
    centred = Rows(fit, n, mean)
    trace = centred.trace() if n else 0.0
    if not trace:
        return vectors.sparkSession.createDataFrame([], schema)
    value, axes, _ = lobpcg(centred, d, min(components, d))
    some = value > 1e-12 * value[0]
    value, axes = value[some], axes[:, some]
    scale = axes / np.sqrt(value)
    m = len(value)

    def products(batches):
        """Sums of products of whitened coordinates."""
        second = np.zeros((m, m))
        for _, x in _runs(batches):
            y = (x - mean) @ scale
            second += y.T @ y
        yield pa.RecordBatch.from_pydict({"i": np.arange(m * m), "v": second.ravel()})

    second = fit.select("x").mapInArrow(products, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").toArrow().column("v").to_numpy().reshape(m, m) / n
    error = float(np.abs(second - np.eye(m)).max())
    explained = value / trace
    exact = np.array(total)
    # Deviations fit into 64 bits if the largest possible one does.
    most = max(map(abs, total))

    def run(batches):
        for batch, x in _runs(batches, 1):
            if d * (n * int(np.abs(x).max()) + most) ** 2 < 1 << 63:
                off = n * x - exact.astype(np.int64)
                deviation = (off * off).sum(axis=1).tolist()
            else:
                deviation = [sum((n * int(v) - s) ** 2 for v, s in zip(row, total, strict=True)) for row in x]
                deviation = [v if v < 1 << 63 else None for v in deviation]
            y, k = (x - mean) @ scale, len(x)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(np.repeat(np.arange(k), m))),
                    pa.array(np.tile(np.arange(1, m + 1), k), pa.int32()),
                    pa.array(np.full(k * m, n)),
                    pa.array(deviation, pa.int64()).take(pa.array(np.repeat(np.arange(k), m))),
                    pa.array(y.ravel()),
                    pa.array(np.tile(explained, k)),
                    pa.array(np.full(k * m, error)),
                ],
                names=schema.names,
            )

    return rows.mapInArrow(run, schema)
