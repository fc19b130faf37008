"""Whitening against a dense eigenvalue decomposition."""

import math

import numpy as np
import pytest

from folioloom.llm import whitening


class Dense:
    def __init__(self, matrix):
        self.matrix, self.n = matrix, 0

    def times(self, block):
        self.n += 1
        return self.matrix @ block


@pytest.mark.parametrize("d", [1, 2, 5, 12, 13, 64, 200])
@pytest.mark.parametrize("kind", ["even", "steep", "equal", "few"])
def test_lobpcg(d, kind):
    rng = np.random.default_rng(d)
    q = np.linalg.qr(rng.standard_normal((d, d)))[0]
    values = {"even": np.linspace(1, 2, d), "steep": 10.0 ** -np.arange(d).clip(0, 12), "equal": np.r_[[5, 5, 5, 5], rng.random(d)][:d], "few": np.r_[[3, 2], np.zeros(d)][:d]}[kind]
    dense = Dense((q * values) @ q.T)
    e, v, residual = whitening.lobpcg(dense, d, min(4, d))
    assert residual < 1e-12
    assert np.allclose(e, np.sort(values)[::-1][:4], atol=1e-12)
    assert np.allclose(v.T @ v, np.eye(len(e)), atol=1e-13)
    assert np.abs(dense.matrix @ v - v * e).max() < 1e-11


def check(rows, got, components=4):
    """Against whole matrices; ``rows`` are (id, vector) of the usable rows."""
    x = np.array([[math.floor(256 * float(c)) for c in v] for _, v in rows])
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    centred = fit - s / n
    e, axes = np.linalg.eigh(centred.T @ centred / n)
    e, axes = e[::-1], axes[:, ::-1]
    m = min(components, len(e), int((e > 1e-9 * e[0]).sum()))
    assert len(got) == m * len(rows)
    assert {r.n for r in got} == {n}
    assert all(r.identity_error < 1e-10 for r in got)
    by = {}
    for r in got:
        by.setdefault((r.vec_id, r.component), []).append(r)
    for k in range(m):
        want = (x - s / n) @ axes[:, k] / math.sqrt(e[k])
        sign = None
        for (i, _), w, row in zip(rows, want, x, strict=True):
            r = by[i, k + 1][0]
            sign = sign or (1 if r.whitened * w > 0 else -1)
            assert abs(r.whitened * sign - w) < 1e-8
            assert r.deviation == sum((n * int(a) - int(b)) ** 2 for a, b in zip(row, s, strict=True))
            assert abs(r.explained - e[k] / e.sum()) < 1e-12


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "mine", 5) for i, v in rows], "vec_id long, embedding array<float>, whitened string, n int")


def test_random_vectors_and_unusable_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(k, [float(np.float32(c)) for c in rng.standard_normal(20) * np.linspace(0.1, 1, 20)]) for k in range(150)]
    rows += [(200 + k, rows[0][1]) for k in range(40)]
    bad = [(300, None), (301, []), (302, [float("nan")] * 20), (303, [float("inf")] + [0.0] * 19), (304, [None] + [0.0] * 19), (305, [1.0, 2.0])]
    got = whitening.whiten(vectors(spark, rows + bad)).collect()
    assert list(got[0].asDict()) == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    check(rows, got)


def test_few_dimensions_and_little_variance(spark):
    check([(1, [0.0, 1.0]), (2, [2.0, -1.0]), (2, [2.0, -1.0]), (3, [0.5, 0.25])], whitening.whiten(vectors(spark, [(1, [0.0, 1.0]), (2, [2.0, -1.0]), (2, [2.0, -1.0]), (3, [0.5, 0.25])])).collect())
    line = [(k, [float(k), 2.0 * k, 0.0, 0.0, 1.0, 3.0]) for k in range(9)]
    got = whitening.whiten(vectors(spark, line)).collect()
    assert {r.component for r in got} == {1}
    check(line, got, 1)


def test_none_one_and_null_ids(spark):
    assert whitening.whiten(vectors(spark, [])).collect() == []
    assert whitening.whiten(vectors(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect() == []
    rows = vectors(spark, [(None, [1.0, 2.0]), (None, [1.0, 2.0]), (3, [0.0, 0.0])])
    assert sorted(str(r.vec_id) for r in whitening.whiten(rows).collect()) == ["3", "None", "None"]


def test_deviations_that_are_large(spark):
    rows = [(k, [float(1 << 29) * (-1) ** k, float(k), 3e38 if k == 7 else 0.0]) for k in range(8)]
    got = whitening.whiten(vectors(spark, rows)).collect()
    assert {r.deviation for r in got if r.vec_id == 7} == {None}
    small = [(k, [float(1 << 14) * (-1) ** k, float(k)]) for k in range(200)]
    check(small, whitening.whiten(vectors(spark, small)).collect())
