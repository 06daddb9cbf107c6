"""Small dense linear algebra and optimisation on the driver, and tall decompositions over a DataFrame."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.operators.likelihood import matrix


class Singular(ValueError):
    """The matrix has no inverse (or isn't positive definite)."""


def cholesky(a) -> np.ndarray:
    """Lower factor of a symmetric positive definite matrix."""
    try:
        return np.linalg.cholesky(np.asarray(a, float))
    except np.linalg.LinAlgError as e:
        raise Singular(str(e)) from None


@dataclass
class Lu:
    """lu: unit lower and upper factor in one; piv: row order; sign of that order."""

    lu: np.ndarray
    piv: np.ndarray
    sign: float


def lu_factor(a) -> Lu:
    """Gauss elimination with partial pivots."""
    lu, n, sign = np.array(a, float), len(a), 1.0
    piv = np.arange(n)
    for j in range(n):
        p = j + int(np.argmax(np.abs(lu[j:, j])))
        if p != j:
            lu[[j, p]], piv[[j, p]], sign = lu[[p, j]], piv[[p, j]], -sign
        if lu[j, j]:
            lu[j + 1 :, j] /= lu[j, j]
            lu[j + 1 :, j + 1 :] -= np.outer(lu[j + 1 :, j], lu[j, j + 1 :])
    return Lu(lu, piv, sign)


def qr(a) -> tuple[np.ndarray, np.ndarray]:
    return np.linalg.qr(np.asarray(a, float))


def svd(a) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Thin U, singular values in falling order, V transposed."""
    return np.linalg.svd(np.asarray(a, float), full_matrices=False)


def eigh(a) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues in rising order and vectors of a symmetric matrix."""
    return np.linalg.eigh(np.asarray(a, float))


def solve(a, b) -> np.ndarray:
    try:
        return np.linalg.solve(np.asarray(a, float), np.asarray(b, float))
    except np.linalg.LinAlgError as e:
        raise Singular(str(e)) from None


solve_matrix = solve


def inv(a) -> np.ndarray:
    return solve(a, np.eye(len(a)))


def det(a) -> float:
    f = lu_factor(a)
    return f.sign * float(np.prod(np.diag(f.lu)))


def pinv(a, rcond: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Moore-Penrose inverse and singular values."""
    u, s, vt = svd(a)
    cut = (rcond if rcond is not None else max(np.shape(a)) * np.finfo(float).eps) * (s.max() if len(s) else 0.0)
    return vt.T @ (np.where(s > cut, 1 / np.where(s > cut, s, 1), 0)[:, None] * u.T), s


def matrix_rank(a) -> int:
    s = svd(a)[1]
    return int((s > (s.max() if len(s) else 0) * max(np.shape(a)) * np.finfo(float).eps).sum())


def lstsq(a, b) -> np.ndarray:
    """Least squares of least length."""
    return pinv(a)[0] @ np.asarray(b, float)


def lstsq_qr(a, b) -> tuple[np.ndarray, np.ndarray] | None:
    """Coefficients and inverse of a'a for full rank; None where the diagonal of R all but vanishes somewhere."""
    q, r = qr(a)
    return _back(r, q.T @ np.asarray(b, float))


def _back(r: np.ndarray, qty: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    d = np.abs(np.diag(r))
    if not len(d) or d.min() <= 1e-8 * d.max():
        return None
    ri = np.linalg.inv(r)
    return ri @ qty, ri @ ri.T


def cholesky_solve(a, b) -> np.ndarray:
    low = cholesky(a)
    return np.linalg.solve(low.T, np.linalg.solve(low, np.asarray(b, float)))


def tall_r(df: DataFrame, columns: list[str]) -> np.ndarray:
    """R of the QR decomposition of a DataFrame's columns, with a diagonal that isn't negative: every partition keeps its own
    triangle, and the triangles are merged in a second round of tasks before a last one on the driver."""
    k = len(columns)
    given = df.select(*(F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(columns))).na.drop("any")

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, k))
        for batch in batches:
            r = np.linalg.qr(np.vstack([r, matrix(batch, [f"x{i}" for i in range(k)])]), mode="r")
        yield pa.RecordBatch.from_arrays([pa.array([r.ravel().tolist()], pa.list_(pa.float64()))], ["r"])

    def merge(table: pa.Table) -> pa.Table:
        rows = [np.array(v.as_py(), float).reshape(-1, k) for v in table.column("r")]
        r = np.zeros((0, k))
        for a in rows:
            r = np.linalg.qr(np.vstack([r, a]), mode="r")
        return pa.table({"r": pa.array([r.ravel().tolist()], pa.list_(pa.float64()))})

    parts = given.mapInArrow(first, "r array<double>").select(F.pmod(F.spark_partition_id(), F.lit(64)).alias("g"), "r")
    r = np.vstack([np.array(x["r"], float).reshape(-1, k) for x in parts.groupBy("g").applyInArrow(merge, "r array<double>").collect()] or [np.zeros((0, k))])
    r = np.linalg.qr(r, mode="r") if len(r) else np.zeros((k, k))
    r = np.vstack([r, np.zeros((max(0, k - len(r)), k))])
    return r * np.where(np.diag(r) < 0, -1.0, 1.0)[:, None]


def tall_svd(df: DataFrame, columns: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Singular values and V transposed of a DataFrame's columns."""
    _, s, vt = svd(tall_r(df, columns))
    return s, vt


def tall_lstsq(df: DataFrame, response: str, columns: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients and inverse Gram matrix by QR, without squaring the condition number; of least length where columns depend on each other."""
    k = len(columns)
    r = tall_r(df, [*columns, response])
    found = _back(r[:k, :k], r[:k, k])
    if found is None:
        p, _ = pinv(r[:k, :k])
        return p @ r[:k, k], p @ p.T
    return found


def ensure_all_finite(df: DataFrame, *columns: str) -> DataFrame:
    """df, if no value of the columns is null, NaN or infinite; else a ValueError that names the first such column."""
    bad = df.agg(*(F.count_if(F.col(c).isNull() | F.isnan(F.col(c).cast("double")) | (F.abs(F.col(c).cast("double")) == float("inf"))).alias(c) for c in columns)).first()
    for c in columns:
        if bad[c]:
            raise ValueError(f"{c} has {bad[c]} values that aren't finite")
    return df


def add_constant(df: DataFrame, columns: list[str], name: str = "const", prepend: bool = True, has_constant: str = "skip") -> DataFrame:
    """The columns with one of ones. has_constant says what to do where one of them is constant already: skip, add or raise."""
    ends = df.agg(*(x for c in columns for x in (F.min(c), F.max(c)))).first() if columns else []
    constant = [c for i, c in enumerate(columns) if ends[2 * i] is not None and ends[2 * i] == ends[2 * i + 1]]
    if constant and has_constant == "raise":
        raise ValueError(f"{constant[0]} is constant")
    if constant and has_constant == "skip":
        return df.select(*columns)
    one = F.lit(1.0).alias(name)
    return df.select(one, *columns) if prepend else df.select(*columns, one)


@dataclass
class Optimum:
    x: np.ndarray
    fval: float
    iters: int
    converged: bool
    grad_norm: float


def approx_fprime(x, f: Callable) -> np.ndarray:
    """Gradient by central differences."""
    x = np.asarray(x, float)
    h = 1e-6 * (1 + np.abs(x))
    return np.array([(f(x + h[i] * e) - f(x - h[i] * e)) / (2 * h[i]) for i, e in enumerate(np.eye(len(x)))])


def approx_hess(x, f: Callable) -> np.ndarray:
    """Hessian by central differences."""
    x = np.asarray(x, float)
    h, e, k = 1e-4 * (1 + np.abs(x)), np.eye(len(x)), len(x)
    out = np.zeros((k, k))
    for i in range(k):
        for j in range(i + 1):
            a, b = h[i] * e[i], h[j] * e[j]
            out[i, j] = out[j, i] = (f(x + a + b) - f(x + a - b) - f(x - a + b) + f(x - a - b)) / (4 * h[i] * h[j])
    return out


def newton_stationary(start, fgh: Callable, rounds: int = 100, gtol: float = 1e-8) -> Optimum:
    """Point where the gradient vanishes; steps are halved until the gradient's length falls."""
    x = np.array(start, float)
    f, g, h = fgh(x)
    for i in range(rounds):
        size = float(np.linalg.norm(g))
        if size < gtol:
            return Optimum(x, f, i, True, size)
        step = -np.linalg.lstsq(h, g, rcond=None)[0]
        t = 1.0
        for _ in range(40):
            got = fgh(x + t * step)
            if np.linalg.norm(got[1]) < size:
                break
            t /= 2
        x = x + t * step
        f, g, h = got
        if np.abs(t * step).max() <= 1e-12 * (1 + np.abs(x).max()):
            return Optimum(x, f, i + 1, True, float(np.linalg.norm(g)))
    return Optimum(x, f, rounds, False, float(np.linalg.norm(g)))


def minimize_bfgs(start, f: Callable, grad: Callable | None = None, rounds: int = 500, gtol: float = 1e-6) -> Optimum:
    """Quasi-Newton descent with backtracking; the gradient is numerical where none is given."""
    grad = grad or (lambda x: approx_fprime(x, f))
    x = np.array(start, float)
    value, g, h = f(x), grad(x), np.eye(len(x))
    for i in range(rounds):
        size = float(np.abs(g).max()) if len(g) else 0.0
        if size < gtol:
            return Optimum(x, value, i, True, size)
        step = -h @ g
        if step @ g >= 0:
            h, step = np.eye(len(x)), -g
        t, then = 1.0, value
        for _ in range(50):
            then = f(x + t * step)
            if np.isfinite(then) and then <= value + 1e-4 * t * (step @ g):
                break
            t /= 2
        else:
            return Optimum(x, value, i, size < 1e3 * gtol, size)
        new = grad(x + t * step)
        s, y = t * step, new - g
        if s @ y > 1e-12:
            if i == 0:
                h = np.eye(len(x)) * (s @ y) / (y @ y)
            r = 1 / (s @ y)
            left = np.eye(len(x)) - r * np.outer(s, y)
            h = left @ h @ left.T + r * np.outer(s, s)
        x, value, g = x + s, then, new
    return Optimum(x, value, rounds, False, float(np.abs(g).max()))
