"""Whitening of embeddings, with the components by contour integration.

Spark forms the list of distinct vectors, their sums and the covariance from sums per task; what leaves
the tasks is a matrix of the vectors' length, whatever the number of rows. Its largest eigenpairs come
from a FEAST iteration: a quadrature of complex shifted solves around an interval projects a subspace
onto the eigenvectors of that interval, Rayleigh-Ritz takes them out, and inertia counts of shifted
factorisations say how many there have to be.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column_view, materialize, prepare

SCALE = 256
_LOW, _HIGH = -(1 << 31), (1 << 31) - 1


# ---------------------------------------------------------------- eigenpairs
def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Diagonal and off-diagonal of an orthogonally similar matrix, by Householder reflections."""
    a = np.array(matrix, float)
    n = len(a)
    for k in range(n - 2):
        v = a[k + 1:, k].copy()
        size = np.linalg.norm(v)
        if size == 0:
            continue
        v[0] += math.copysign(size, v[0])
        v /= np.linalg.norm(v)
        p = a[k + 1:, k + 1:] @ v
        w = p - (v @ p) * v
        a[k + 1:, k + 1:] -= 2 * (np.outer(v, w) + np.outer(w, v))
        a[k + 1:, k] = a[k, k + 1:] = 0
        a[k + 1, k] = a[k, k + 1] = -math.copysign(size, v[0])
    return a.diagonal().copy(), a.diagonal(1).copy()


def inertia_above(bands: tuple[np.ndarray, np.ndarray], shifts: np.ndarray) -> np.ndarray:
    """Number of eigenvalues above each shift: the positive pivots of the shifted factorisation (law of inertia)."""
    main, off = bands
    tiny = np.finfo(float).tiny ** 0.5
    pivot = main[0] - shifts
    above = (pivot > 0).astype(int)
    for d, e in zip(main[1:], off):
        pivot = d - shifts - e * e / np.where(pivot == 0, -tiny, pivot)
        above += pivot > 0
    return above


def feast(matrix: np.ndarray, low: float, high: float, count: int, points: int = 8, rounds: int = 40,
          seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` eigenvalues in (low, high), falling, and their unit eigenvectors as columns.

    Gauss-Legendre points on the upper half of the circle through the ends; the lower half is their
    conjugate. The subspace grows until the residuals are those of rounding; a whole space always is enough.
    """
    n, size = len(matrix), 2 * count + 4
    while True:
        found = _subspace(matrix, low, high, count, min(n, size), points, rounds, seed)
        if found is not None:
            return found
        if size >= n:
            raise ArithmeticError(f"{count} eigenvalues lie in ({low}, {high}), which the contour did not resolve")
        size *= 2


def _subspace(matrix: np.ndarray, low: float, high: float, count: int, size: int, points: int, rounds: int,
              seed: int) -> tuple[np.ndarray, np.ndarray] | None:
    n = len(matrix)
    y = np.random.default_rng(seed).standard_normal((n, size))
    nodes, weights = np.polynomial.legendre.leggauss(points)
    angle = math.pi * (1 - nodes) / 2
    middle, radius = (high + low) / 2, (high - low) / 2
    scale = max(np.abs(matrix).max(), np.finfo(float).tiny)
    best = None
    for _ in range(rounds):
        projected = np.zeros((n, size))
        for t, w in zip(angle, weights):
            z = np.exp(1j * t)
            projected += w / 2 * (radius * z * np.linalg.solve((middle + radius * z) * np.eye(n) - matrix, y)).real
        basis = np.linalg.qr(projected)[0]
        # Rayleigh-Ritz in the projected subspace
        small = basis.T @ matrix @ basis
        values, vectors = np.linalg.eigh((small + small.T) / 2)
        y = basis @ vectors
        inside = np.flatnonzero((values > low) & (values < high))[::-1]
        if len(inside) == count:
            found = y[:, inside]
            off = np.abs(matrix @ found - found * values[inside]).max() / scale
            if best is not None and off >= best[0] / 2 and best[0] < 1e-10:
                break  # as near as doubles allow
            if best is None or off < best[0]:
                best = off, values[inside], found / np.linalg.norm(found, axis=0)
    return None if best is None or best[0] > 1e-10 else best[1:]


def components(matrix: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``most`` largest eigenvalues, falling, and unit eigenvectors; only those above rounding noise.

    The interval is found by inertia counts alone: its lower end is put into a wide gap below the
    wanted eigenvalues, and the count at that end is the number FEAST has to return.
    """
    n, trace = len(matrix), float(np.trace(matrix))
    if not trace > 0:
        return np.zeros(0), np.zeros((n, 0))
    bands, noise = tridiagonal(matrix), trace * n * 1e-14
    total = int(inertia_above(bands, np.array([noise]))[0])
    most = min(most, total)
    # halving by counts: the largest eigenvalue, and those around the end of the wanted ones
    ranks = np.array([1, *range(most, min(3 * most + 4, total) + 1)])
    a, b = np.full(len(ranks), noise), np.full(len(ranks), np.abs(matrix).sum(axis=1).max() * 1.01)
    for _ in range(40):
        c = (a + b) / 2
        beyond = inertia_above(bands, c) >= ranks
        a, b = np.where(beyond, c, a), np.where(beyond, b, c)
    lower = np.append(a[2:], noise if ranks[-1] == total else a[-1])
    best = int(((a[1:] - lower) / a[1:]).argmax())
    low = (a[1 + best] + lower[best]) / 2
    if a[1 + best] - lower[best] <= 1e-9 * a[1 + best]:
        low = noise  # no gap to be seen: all of them
    count = int(inertia_above(bands, np.array([low]))[0])
    values, vectors = feast(matrix, low, b[0] + (b[0] - low) * 0.05, count)
    return values[:most], vectors[:, :most]


# ---------------------------------------------------------------- vectors
def _blocks(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        if batch.num_rows:
            yield batch, batch.column("x").flatten().to_numpy().reshape(-1, dims)


def vectors(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, x: entries as whole 256ths, at most 32 bits each; unusable rows are left out."""
    view = column_view(table, vec_id=id_col, v=vector_col)
    usable = F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    whole = F.transform("v", lambda c: F.floor(F.greatest(F.least(c.cast("double") * SCALE, F.lit(float(_HIGH))), F.lit(float(_LOW)))).cast("int"))
    return view.where(F.coalesce(usable, F.lit(False))).select("vec_id", whole.alias("x"))


def sums(fit: DataFrame, dims: int) -> tuple[int, list[int]]:
    """Number of vectors and exact sums per dimension: a row per task and dimension is shuffled."""
    def add(batches):
        n, s = 0, np.zeros(dims, np.int64)
        for _, x in _blocks(batches, dims):
            n, s = n + len(x), s + x.sum(axis=0, dtype=np.int64)
        if n:
            yield pa.RecordBatch.from_pydict({"i": pa.array(range(dims), pa.int32()), "n": pa.array([n] * dims, pa.int64()), "s": pa.array(s)})
    rows = fit.mapInArrow(add, "i int, n long, s long").groupBy("i").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect()
    return (rows[0]["n"] if rows else 0), [r["s"] for r in sorted(rows, key=lambda r: r["i"])]


def second_moments(fit: DataFrame, dims: int, centre: list[int], n: int, project: np.ndarray | None = None) -> np.ndarray:
    """Mean outer product of the centred vectors, or of their projections on the columns of ``project``.

    Each task adds up its own rows; a row per task and matrix row is shuffled, and the matrix is returned.
    """
    mean = np.array([s / n for s in centre])

    def add(batches):
        total = None
        for _, x in _blocks(batches, dims):
            c = x - mean
            c = c if project is None else c @ project
            total = c.T @ c + (0 if total is None else total)
        if total is not None:
            yield pa.RecordBatch.from_pydict({"i": pa.array(range(len(total)), pa.int32()), "v": pa.array(total.tolist(), pa.list_(pa.float64()))})
    each = fit.mapInArrow(add, "i int, v array<double>").select("i", F.posexplode("v").alias("j", "v"))
    cells = each.groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    size = dims if project is None else project.shape[1]
    out = np.zeros((size, size))
    for r in cells:
        out[r["i"], r["j"]] = r["v"] / n
    return (out + out.T) / 2


def _deviations(x: np.ndarray, n: int, s: list[int]) -> list[int | None]:
    """Exact sums of (n * x - s) ** 2; None beyond 64 bits."""
    wide = x.astype(float) * n - np.array([float(v) for v in s])
    fits = (wide * wide).sum(axis=1) < 9.2e18
    if fits.all() and max(map(abs, s), default=0) < 2**62 and n * float(np.abs(x).max(initial=0)) < 2.0**62:
        d = x.astype(np.int64) * n - np.array(s, np.int64)
        return (d * d).sum(axis=1).tolist()
    exact = [sum((n * int(c) - t) ** 2 for c, t in zip(row, s)) for row in x]
    return [v if v < 2**63 else None for v in exact]


def whiten(table: DataFrame, most: int = 4, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error; a row per usable row and component.

    Rows whose vector is null, empty or holds a null or non-finite entry are left out, and so are those
    whose length isn't the most frequent one (the longest of several). Entries beyond 32 bits are
    clipped. Repeated vectors count once in the fit; repeated or null ids are rows of their own. There are
    fewer components where fewer eigenvalues are above rounding noise, so none for a table with a single
    distinct vector; an empty table gives no row. A deviation beyond 64 bits is null.
    """
    spark = prepare(table.sparkSession)
    schema = "vec_id string, component int, n long, deviation long, whitened double, explained double, identity_error double"
    schema = schema.replace("vec_id string", f"vec_id {table.schema[id_col].dataType.simpleString()}")
    usable = vectors(table, id_col, vector_col)
    # one row per length, which a table has few of
    lengths = usable.groupBy(F.size("x").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).limit(1).collect()
    if not lengths:
        return spark.createDataFrame([], schema)
    dims = lengths[0]["dims"]
    usable = usable.where(F.size("x") == dims)
    fit = materialize(usable.select("x").distinct())
    n, s = sums(fit, dims)
    matrix = second_moments(fit, dims, s, n)
    values, found = components(matrix, most)
    if not len(values):
        return spark.createDataFrame([], schema)
    scaled = found / np.sqrt(values)
    error = float(np.abs(second_moments(fit, dims, s, n, scaled) - np.eye(len(values))).max())
    explained = (values / np.trace(matrix)).tolist()
    mean, k = np.array([v / n for v in s]), len(values)

    def project(batches):
        for batch, x in _blocks(batches, dims):
            w = (x - mean) @ scaled
            ids = batch.column("vec_id").take(pa.array(np.repeat(np.arange(len(x)), k)))
            yield pa.RecordBatch.from_arrays([
                ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(x) * k, n)),
                pa.array([d for d in _deviations(x, n, s) for _ in range(k)], pa.int64()), pa.array(w.ravel()),
                pa.array(explained * len(x), pa.float64()), pa.array(np.full(len(x) * k, error))],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])
    return usable.mapInArrow(project, schema)
