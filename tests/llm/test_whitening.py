"""Contour integration against a full decomposition, and the whole operator against numpy on one array."""

import math

import numpy as np
import pytest

from pitpanel.llm import whitening


def symmetric(values, seed=0):
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(values), len(values))))[0]
    m = q @ np.diag(values) @ q.T
    return (m + m.T) / 2


@pytest.mark.parametrize("values", [[5, 4, 3, 2, 1, 0.5], [9, 9 - 1e-3, 1, 1, 1, 1, 0, 0], [1e6, 1, 1e-6, 0, 0], list(np.linspace(1, 2, 64)), list(np.linspace(1, 1.01, 200)), [7] * 9, [2, 2, 2, 2, 2, 1, 1, 1, 1, 1, 1, 1, 1], [0, 0, 0], [3]])
def test_components(values):
    m = symmetric(values)
    got, vectors = whitening.components(m, 4)
    full = np.linalg.eigvalsh(m)[::-1]
    wanted = [v for v in full[:4] if v > max(values) * len(values) * 1e-13]
    assert len(got) == len(wanted)
    if wanted:
        assert np.allclose(got, wanted, rtol=1e-10, atol=1e-10 * max(wanted))
        assert np.abs(m @ vectors - vectors * got).max() < 1e-11 * max(wanted)
        assert np.abs(vectors.T @ vectors - np.eye(len(got))).max() < 1e-11


def test_inertia():
    shifts = np.array([-2.5, -0.5, 0.5, 2.5])
    for seed in range(30):
        m = symmetric(np.random.default_rng(seed).integers(-3, 4, 1 + seed % 9).astype(float), seed)
        wanted = [(np.linalg.eigvalsh(m) > s).sum() for s in shifts]
        assert whitening.inertia_above(whitening.tridiagonal(m), shifts).tolist() == wanted
    for m in (np.array([[0.0, 1.0], [1.0, 0.0]]), np.zeros((3, 3)), np.diag([1.0, 0.0, -1.0])):
        assert whitening.inertia_above(whitening.tridiagonal(m), np.array([1e-9]))[0] == (np.linalg.eigvalsh(m) > 1e-9).sum()


def brute(rows, most=4):
    keep = [(i, [math.floor(256 * c) for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(v) for _, v in keep})
    n, s = len(fit), [sum(c) for c in zip(*fit)]
    x = np.array(fit, float) - np.array(s) / n
    e, v = np.linalg.eigh(x.T @ x / n)
    e, v = e[::-1][:most], v[:, ::-1][:, :most]
    out = {}
    for k, (i, row) in enumerate(keep):
        for c in range(len(e)):
            out[k, c + 1] = (i, n, sum((n * a - b) ** 2 for a, b in zip(row, s)), (np.array(row) - np.array(s) / n) @ v[:, c] / math.sqrt(e[c]), e[c] / (x * x).sum() * n)
    return keep, out


def test_whole_operator(spark):
    rng = np.random.default_rng(3)
    base = (rng.standard_normal((300, 6)) * [3, 2, 1.5, 1, 0.5, 0.2]).astype("float32")
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(base)]
    rows += [(1000 + i, rows[0][1]) for i in range(150)] + [(5, None), (6, []), (7, [None] * 6), (8, [float("nan")] * 6), (9, [float("inf")] * 6), (None, rows[1][1]), (10, [1.0])]
    df = spark.createDataFrame([(i, v, "clash", 0) for i, v in rows], "vec_id int, embedding array<float>, x string, n int").repartition(5)
    got = whitening.whiten(df).collect()
    keep, wanted = brute([r for r in rows if r[1] is None or len(r[1]) != 1])
    assert len(got) == len(wanted) == 4 * len(keep)
    signs = {}
    key = lambda i, c, d, w: (i is None, i, c, d, round(abs(w), 6))
    a = sorted(got, key=lambda r: key(r.vec_id, r.component, r.deviation, r.whitened))
    b = sorted(((i, c, n, d, w, x) for (_, c), (i, n, d, w, x) in wanted.items()), key=lambda r: key(r[0], r[1], r[3], r[4]))
    for r, (i, c, n, d, w, x) in zip(a, b):
        assert (r.vec_id, r.component, r.n, r.deviation) == (i, c, n, d)
        sign = signs.setdefault(c, np.sign(r.whitened * w) or 1)
        assert abs(r.whitened - sign * w) < 1e-9 and abs(r.explained - x) < 1e-12 and r.identity_error < 1e-9


def test_odd_tables(spark):
    schema = "vec_id int, embedding array<double>"
    assert whitening.whiten(spark.createDataFrame([], schema)).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, None), (2, [])], schema)).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], schema)).collect() == []
    two = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 2.0]), (None, [3.0, 2.0])], schema)).collect()
    assert sorted((r.vec_id or 0, r.component, r.n, round(abs(r.whitened), 9)) for r in two) == [(0, 1, 2, 1.0), (1, 1, 2, 1.0), (2, 1, 2, 1.0)]
    huge = whitening.whiten(spark.createDataFrame([(1, [1e300, 0.0]), (2, [-1e300, 0.0]), (3, [0.0, 1.0])], schema)).collect()
    assert {r.deviation is None for r in huge} == {True, False}
