"""Maximum likelihood over a DataFrame: Newton's method whose every step is one pass in Arrow batches.

A model is a log-likelihood of a row as a function of a few local values: linear predictors, each of some columns of the
design, and shape parameters. Each batch returns the sums of the log-likelihood, its gradient and its Hessian; the driver
adds them up and solves a small system. The derivatives by local values are taken numerically (central differences), those
by coefficients follow from the columns.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tallyforge.functions import distributions as dist

#: Log-likelihood of rows: y, matrix of local values (row by local) -> vector.
LogLike = Callable[[np.ndarray, np.ndarray], np.ndarray]


@dataclass
class Estimate:
    """Coefficients with names, covariance, log-likelihood and whether Newton's method came to rest."""

    names: list[str]
    params: np.ndarray
    cov: np.ndarray
    llf: float
    nobs: int
    converged: bool
    iterations: int
    df: DataFrame | None = None
    stats: dict[str, float] = field(default_factory=dict)

    @property
    def bse(self) -> np.ndarray:
        return np.sqrt(np.maximum(np.diag(self.cov), 0))

    @property
    def tvalues(self) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            return self.params / self.bse

    @property
    def pvalues(self) -> np.ndarray:
        return np.array([2 * dist.norm_sf(abs(z)) if math.isfinite(z) else math.nan for z in self.tvalues])

    @property
    def aic(self) -> float:
        return 2 * len(self.params) - 2 * self.llf

    @property
    def bic(self) -> float:
        return math.log(max(self.nobs, 1)) * len(self.params) - 2 * self.llf

    def conf_int(self, alpha: float = 0.05) -> np.ndarray:
        half = dist.norm_ppf(1 - alpha / 2) * self.bse
        return np.column_stack([self.params - half, self.params + half])

    @property
    def coef(self) -> DataFrame:
        """(term, coef, std_err, stat, pvalue, ci_low, ci_high)."""
        rows = [tuple(map(float, r)) for r in zip(self.params, self.bse, self.tvalues, self.pvalues, *self.conf_int().T)]
        return self.df.sparkSession.createDataFrame([(n, *r) for n, r in zip(self.names, rows)], "term string, coef double, std_err double, stat double, pvalue double, ci_low double, ci_high double")


def matrix(batch: pa.RecordBatch, names: list[str]) -> np.ndarray:
    return np.column_stack([batch.column(n).to_numpy(zero_copy_only=False).astype(float) for n in names]) if names else np.zeros((batch.num_rows, 0))


def totals(frame: DataFrame, f: Callable[[pa.RecordBatch], np.ndarray], size: int) -> np.ndarray:
    """Sum over all batches of the vectors that f returns: one row per partition comes to the driver, whatever the data's size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                total += f(batch)
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], ["v"])

    rows = frame.mapInArrow(run, "v array<double>").selectExpr("posexplode(v) as (i, x)").groupBy("i").agg({"x": "sum"}).collect()
    out = np.zeros(size)
    for i, x in rows:
        out[i] = x
    return out


def locals_of(x: np.ndarray, params: np.ndarray, parts: list[list[int] | None]) -> np.ndarray:
    """Local values of rows: a linear predictor for each list of columns, a shape parameter for None."""
    out, at = [], 0
    for part in parts:
        k = 1 if part is None else len(part)
        out.append(np.full(len(x), params[at]) if part is None else x[:, part] @ params[at : at + k])
        at += k
    return np.column_stack(out)


def derivatives(loglike: LogLike, y: np.ndarray, v: np.ndarray, hessian: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Value, gradient and Hessian of the log-likelihood of each row by its local values."""
    m = v.shape[1]
    f = loglike(y, v)
    grad, hess = np.empty((len(y), m)), np.empty((len(y), m, m)) if hessian else None
    h1, h2 = 1e-5 * (1 + np.abs(v)), 2e-4 * (1 + np.abs(v))
    for i in range(m):
        up, down = v.copy(), v.copy()
        up[:, i] += h1[:, i]
        down[:, i] -= h1[:, i]
        grad[:, i] = (loglike(y, up) - loglike(y, down)) / (up[:, i] - down[:, i])
        if not hessian:
            continue
        one, two = v.copy(), v.copy()
        one[:, i] += h2[:, i]
        two[:, i] -= h2[:, i]
        hess[:, i, i] = (loglike(y, one) - 2 * f + loglike(y, two)) / h2[:, i] ** 2
        for j in range(i):
            total = 0.0
            for a in (1, -1):
                for b in (1, -1):
                    w = v.copy()
                    w[:, i] += a * h2[:, i]
                    w[:, j] += b * h2[:, j]
                    total = total + a * b * loglike(y, w)
            hess[:, i, j] = hess[:, j, i] = total / (4 * h2[:, i] * h2[:, j])
    return f, grad, hess


def sums(loglike: LogLike, y: np.ndarray, x: np.ndarray, params: np.ndarray, parts: list[list[int] | None], weight: np.ndarray | None = None) -> np.ndarray:
    """Log-likelihood, gradient and Hessian by the coefficients, in one vector."""
    f, grad, hess = derivatives(loglike, y, locals_of(x, params, parts))
    if weight is not None:
        f, grad, hess = f * weight, grad * weight[:, None], hess * weight[:, None, None]
    blocks = [np.ones((len(y), 1)) if part is None else x[:, part] for part in parts]
    g = np.concatenate([b.T @ grad[:, i] for i, b in enumerate(blocks)])
    h = np.block([[a.T @ (b * hess[:, i, j, None]) for j, b in enumerate(blocks)] for i, a in enumerate(blocks)])
    return np.concatenate([[f.sum()], g, h.ravel()])


def newton(f: Callable[[np.ndarray], np.ndarray], start: np.ndarray, rounds: int = 100, tolerance: float = 1e-9) -> tuple[np.ndarray, float, np.ndarray, bool, int]:
    """Climbs f, which returns value, gradient and Hessian in one vector: full steps, halved as long as the value falls;
    where the Hessian isn't negative definite its eigenvalues are turned."""
    k, x = len(start), np.array(start, float)
    now = f(x)
    for i in range(rounds):
        g, h = now[1 : k + 1], now[k + 1 :].reshape(k, k)
        h = (h + h.T) / 2
        values, vectors = np.linalg.eigh(-h)
        scale = np.maximum(np.abs(values), 1e-10 * max(np.abs(values).max(), 1e-300))
        step = vectors @ ((vectors.T @ g) / scale)
        if abs(g @ step) <= tolerance**2 * (1 + abs(now[0])) * 1e4 or np.abs(step).max() <= tolerance * (1 + np.abs(x).max()):
            return x + step if np.isfinite(step).all() else x, now[0], h, True, i
        size, better = 1.0, False
        for _ in range(40):
            then = f(x + size * step)
            if np.isfinite(then).all() and then[0] >= now[0] - 1e-12 * (1 + abs(now[0])):
                better = True
                break
            size /= 2
        if not better:
            return x, now[0], h, bool(np.abs(g).max() < 1e-4 * (1 + abs(now[0]))), i
        x, now = x + size * step, then
    h = now[k + 1 :].reshape(k, k)
    return x, now[0], (h + h.T) / 2, False, rounds


def fit(frame: DataFrame, loglike: LogLike, parts: list[list[int] | None], start: np.ndarray, names: list[str], nobs: int, y: str = "y", weight: str | None = None, rounds: int = 100) -> Estimate:
    """Maximum likelihood estimate over frame (y, x0, x1, ...). parts: for each local value the columns of its linear
    predictor, or None for a shape parameter. converged tells whether it came to rest in as many rounds."""
    used = sorted({c for p in parts if p for c in p})
    place = {c: i for i, c in enumerate(used)}
    local = [None if p is None else [place[c] for c in p] for p in parts]
    columns = [y, *(f"x{c}" for c in used), *([weight] if weight else [])]
    narrow = frame.select(*columns).persist()
    k = len(start)
    try:

        def at(params: np.ndarray) -> np.ndarray:
            def one(batch: pa.RecordBatch) -> np.ndarray:
                w = matrix(batch, [weight])[:, 0] if weight else None
                with np.errstate(all="ignore"):
                    return sums(loglike, matrix(batch, [y])[:, 0], matrix(batch, [f"x{c}" for c in used]), params, local, w)

            return totals(narrow, one, 1 + k + k * k)

        params, llf, hess, converged, n = newton(at, start, rounds)
    finally:
        narrow.unpersist()
    return Estimate(names, params, np.linalg.pinv(-hess, hermitian=True), float(llf), nobs, converged, n, frame)
