"""Embedding whitening by spectrum slicing of the covariance.

The fit list holds every distinct integer vector once.  Spark sums its size,
sums and centred products (integers around the rounded mean, so the sums are
exact in doubles below 2^53 and do not depend on the order of the partitions);
only the d x d matrix reaches the driver.  There each leading eigenvalue is
isolated by counting: the number of positive pivots of the LDL' factorisation
of ``V - s I`` is the number of eigenvalues above ``s``, so bisection on the
shift closes in on the k-th one.  Rayleigh quotient iteration then converges
cubically, and two more counts, just below and just above the result, certify
that it is number k.
"""

from __future__ import annotations

from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opslake.llm import vectors
from opslake.sources.sinks import materialize

_ALPHA = (1 + 17 ** 0.5) / 8
_EPS = np.finfo(float).eps


def count_above(v: np.ndarray, shift: float) -> int:
    """Number of eigenvalues of the symmetric ``v`` above ``shift``: positive pivots of LDL' of v - shift I.

    Symmetric pivoting with 1 x 1 and 2 x 2 pivots keeps the factors bounded.
    """
    b = v - shift * np.eye(len(v))
    n, k, above = len(b), 0, 0

    def swap(i, j):
        if i != j:
            b[[i, j]] = b[[j, i]]
            b[:, [i, j]] = b[:, [j, i]]

    while k < n:
        below = np.abs(b[k + 1:, k])
        if not below.size or not below.max():
            above += b[k, k] > 0
            k += 1
            continue
        r = k + 1 + int(below.argmax())
        most = below.max()
        two = False
        if abs(b[k, k]) < _ALPHA * most:
            other = np.abs(b[k:, r])
            other[r - k] = 0
            if abs(b[k, k]) * other.max() < _ALPHA * most ** 2:
                if abs(b[r, r]) >= _ALPHA * other.max():
                    swap(k, r)
                else:
                    swap(k + 1, r)
                    two = True
        if two:  # such a block has one positive and one negative eigenvalue
            u = b[k + 2:, k:k + 2].copy()
            b[k + 2:, k + 2:] -= u @ np.linalg.solve(b[k:k + 2, k:k + 2], u.T)
            above += 1
            k += 2
        else:
            u = b[k + 1:, k].copy()
            b[k + 1:, k + 1:] -= np.outer(u, u / b[k, k])
            above += b[k, k] > 0
            k += 1
    return int(above)


def leading(v: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` largest eigenvalues above the rounding level, falling, and unit eigenvectors as columns.

    Equal eigenvalues get orthonormal vectors of their common space.
    """
    d = len(v)
    reach = float(np.abs(v).sum(axis=1).max()) if d else 0.0
    if not reach:
        return np.empty(0), np.empty((d, 0))
    fine = 8 * _EPS * reach
    values, vecs = [], np.empty((d, 0))
    for k in range(1, min(count, d) + 1):
        low, high = -2 * fine, reach + 2 * fine  # more than k - 1 eigenvalues above low, fewer than k above high
        n_low, n_high = d, 0
        x, shift, near = np.cos(np.arange(1.0, d + 1) * k), None, False
        while True:
            while not near and (n_low != k or n_high != k - 1) and high - low > fine:
                mid = (low + high) / 2
                n = count_above(v, mid)
                low, high, n_low, n_high = (mid, high, n, n_high) if n >= k else (low, mid, n_low, n)
            x, e = _iterate(v, vecs, x, (low + high) / 2, fine)
            if low - fine <= e <= high + fine:
                break
            if high - low <= fine:  # the interval is as narrow as rounding allows
                break
            mid = (low + high) / 2  # another eigenvalue took over: halve and try again
            n = count_above(v, mid)
            low, high, n_low, n_high = (mid, high, n, n_high) if n >= k else (low, mid, n_low, n)
            x = np.cos(np.arange(1.0, d + 1) * k)
        slack = 16 * fine
        if count_above(v, e - slack) < k or count_above(v, e + slack) > k - 1:
            raise ArithmeticError(f"eigenvalue {k} is not certified by the counts")
        if e <= 2 * d * fine:
            break  # no variance left beyond rounding
        values.append(e)
        vecs = np.column_stack([vecs, x])
    return np.array(values), vecs


def _iterate(v, vecs, x, shift, fine):
    """Two steps of inverse iteration, then Rayleigh quotient iteration, orthogonal to the vectors found."""
    def step(x, s):
        for nudge in (0.0, fine, 7 * fine):
            try:
                y = np.linalg.solve(v - (s + nudge) * np.eye(len(v)), x)
                break
            except np.linalg.LinAlgError:
                continue
        else:
            return x
        if not np.isfinite(y).all() or not np.any(y):
            return x
        y = y / np.abs(y).max()
        for _ in range(2):
            y = y - vecs @ (vecs.T @ y)
        return y / np.linalg.norm(y)

    x = x - vecs @ (vecs.T @ x)
    x = step(step(x / np.linalg.norm(x), shift), shift)
    best = None
    for _ in range(12):
        e = float(x @ (v @ x))
        rest = float(np.linalg.norm(v @ x - e * x))
        if best is None or rest < best[0]:
            best = (rest, x, e)
        elif rest >= best[0]:
            break
        x = step(x, e)
    return best[1], best[2]


@dataclass
class Whitening:
    """A fitted model: all of it is of the size of the dimension, not of the data."""
    dim: int
    n: int
    sums: list[int]
    values: np.ndarray
    vecs: np.ndarray
    trace: float
    identity_error: float | None = None

    def centred(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(x - c as longs, rest): x - S / n = x - c - rest with c the rounded mean."""
        c, rest = centre(self.sums, self.n)
        return x - c, rest

    def project(self, x: np.ndarray) -> np.ndarray:
        y, rest = self.centred(x)
        return ((y - rest) @ self.vecs) / np.sqrt(self.values)

    def deviation(self, x: np.ndarray) -> list[int]:
        """Sum over dimensions of (n x - S)^2, exact: n x - S = n y - s with y = x - c and s = S - n c."""
        c, _ = centre(self.sums, self.n)
        y = x - c
        s = np.array([a - self.n * int(b) for a, b in zip(self.sums, c, strict=True)], dtype=object)
        top = int(np.abs(y).max(initial=0))
        small = top * max(top, max((abs(int(a)) for a in s), default=0)) * max(self.dim, 1) < 1 << 62
        if small:
            yy, ys = (y * y).sum(axis=1), y @ s.astype(np.int64)
        else:
            y = y.astype(object)
            yy, ys = (y * y).sum(axis=1), y @ s
        ss = int((s * s).sum()) if len(s) else 0
        return [self.n * (self.n * int(a) - 2 * int(b)) + ss for a, b in zip(yy, ys, strict=True)]


def centre(sums: list[int], n: int) -> tuple[np.ndarray, np.ndarray]:
    """The mean as whole numbers and the rest in doubles."""
    c = [(2 * s + n) // (2 * n) for s in sums]
    return np.array(c, np.int64), np.array([float(Fraction(s - n * k, n)) for s, k in zip(sums, c, strict=True)])


def _sum_cells(rows: DataFrame, kernel, dim: int) -> dict[tuple[int, int], float]:
    """``kernel(x) -> list of (i, j, value)`` of every Arrow batch, summed per task and then by Spark."""
    def run(batches):
        total = {}
        for b in batches:
            for i, j, value in kernel(vectors.unpack(b.column(0), dim)):
                total[i, j] = total.get((i, j), 0) + value
        for k in sorted({i for i, _ in total}):
            cells = [(j, a) for (i, j), a in total.items() if i == k]
            yield pa.RecordBatch.from_arrays([pa.array([k] * len(cells), pa.int32()), pa.array([j for j, _ in cells], pa.int32()),
                                              pa.array([float(a) for _, a in cells], pa.float64())], ["i", "j", "v"])
    got = rows.mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    return {(r["i"], r["j"]): r["v"] for r in got}


def _size_and_sums(rows: DataFrame, dim: int) -> tuple[int, list[int]]:
    """Rows and exact sums by dimension; high and low halves are summed apart, so no sum passes 64 bits."""
    def run(batches):
        n, hi, lo = 0, np.zeros(dim, np.int64), np.zeros(dim, np.int64)
        for b in batches:
            x = vectors.unpack(b.column(0), dim)
            n += len(x)
            hi += (x >> 32).sum(axis=0)
            lo += (x & 0xFFFFFFFF).sum(axis=0)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim), pa.int32()), pa.array([n] * dim, pa.int64()),
                                              pa.array(hi), pa.array(lo)], ["i", "n", "hi", "lo"])
    got = (rows.mapInArrow(run, "i int, n long, hi long, lo long").groupBy("i")
           .agg(F.sum("n").alias("n"), F.sum("hi").alias("hi"), F.sum("lo").alias("lo")).orderBy("i").collect())
    return (got[0]["n"] if got else 0), [(r["hi"] << 32) + r["lo"] for r in got]


def fit(df: DataFrame, components: int = 4, scale: int = 256, vector: str = "embedding", id_col: str = "vec_id") -> Whitening:
    """Whitening fitted on every distinct integer vector of ``df`` (see ``vectors.usable`` for the rows that take part)."""
    rows, dim, _ = vectors.usable(df, vector, id_col)
    if not dim:
        return Whitening(0, 0, [], np.empty(0), np.empty((0, 0)), 0.0)
    # equal vectors fall together before the shuffle; the list is read three times, so it is written once
    once = materialize(vectors.packed(rows, dim, scale).select("x").distinct(), "whitening-fit")
    n, sums = _size_and_sums(once, dim)
    c, rest = centre(sums, n)

    def products(x):
        y = (x - c).astype(float)
        g = y.T @ y
        return [(i, j, g[i, j]) for i in range(dim) for j in range(i, dim)]

    cells = _sum_cells(once, products, dim)
    v = np.empty((dim, dim))
    for (i, j), a in cells.items():
        # G / n - (s / n)(s / n)' with |s / n| at most a half, in rationals
        v[i, j] = v[j, i] = float(Fraction(a) / n - Fraction(sums[i] - n * int(c[i]), n) * Fraction(sums[j] - n * int(c[j]), n))
    values, vecs = leading(v, components)
    model = Whitening(dim, n, sums, values, vecs, float(np.trace(v)))
    if len(values):
        m = len(values)

        def spread(x):
            z = model.project(x)
            g, s = z.T @ z, z.sum(axis=0)
            return [(i, j, g[i, j]) for i in range(m) for j in range(i, m)] + [(i, m, s[i]) for i in range(m)]

        cells = _sum_cells(once, spread, dim)
        model.identity_error = max(abs(cells[i, j] / n - cells[i, m] / n * cells[j, m] / n - (i == j))
                                   for i in range(m) for j in range(i, m))
    return model


def whiten(df: DataFrame, model: Whitening, scale: int = 256, vector: str = "embedding", id_col: str = "vec_id") -> DataFrame:
    """One row per usable row of ``df`` and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    Null vectors, vectors with null or non-finite entries and vectors of
    another length than the model's give no rows; null and repeated vec_id are
    kept as they are, and equal rows give equal results.  ``deviation`` is
    exact; where it would pass 63 bits it is null.  Components without
    variance (beyond rounding) cannot be whitened and have no rows, so an empty
    table, a single vector or equal vectors give none.  Other columns of ``df``
    are not read.
    """
    dim, m = model.dim, len(model.values)
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v")).where(
        (F.size("v") == max(dim, 1)) & F.forall("v", lambda e: e.isNotNull() & (F.abs(e) < F.lit(float("inf")))))
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"

    def run(batches):
        for b in batches:
            if not m or not b.num_rows:
                continue
            x = vectors.floored(b.column(1), dim, scale)
            z = model.project(x)
            dev = pa.array([a if a < 1 << 63 else None for a in model.deviation(x)], pa.int64())
            each = pa.array(np.repeat(np.arange(len(x)), m))
            size = len(x) * m
            yield pa.RecordBatch.from_arrays([
                b.column(0).take(each), pa.array(np.tile(np.arange(1, m + 1, dtype=np.int32), len(x))),
                pa.array(np.full(size, model.n, np.int64)), dev.take(each), pa.array(z.ravel()),
                pa.array(np.tile(model.values / model.trace, len(x))), pa.array(np.full(size, model.identity_error))],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])
    return rows.mapInArrow(run, schema)
