"""Principal components, factors with rotations, canonical correlation, multivariate tests, and correlation matrices."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.functions import distributions as dist
from tallyforge.operators.formula import design
from tallyforge.operators.likelihood import matrix, totals
from tallyforge.operators.linalg import minimize_bfgs


def covariance(df: DataFrame, columns: list[str]) -> tuple[np.ndarray, np.ndarray, int]:
    """Covariance (divided by n), means and number of rows without a null: two passes, the second about the means."""
    names = [f"x{i}" for i in range(len(columns))]
    x = df.select(*(F.col(c).cast("double").alias(n) for c, n in zip(columns, names))).na.drop("any")
    n, *mean = x.agg(F.count("*"), *(F.avg(c) for c in names)).first()
    if not n:
        raise ValueError("no complete row")
    k, centre = len(names), np.array(mean)

    def step(batch: pa.RecordBatch) -> np.ndarray:
        z = matrix(batch, names) - centre
        return (z.T @ z).ravel()

    return totals(x, step, k * k).reshape(k, k) / n, centre, n


def cov2corr(cov) -> tuple[np.ndarray, np.ndarray]:
    """Correlation matrix and standard deviations."""
    s = np.sqrt(np.diag(cov))
    return np.asarray(cov) / np.outer(s, s), s


def corr2cov(corr, std) -> np.ndarray:
    return np.asarray(corr) * np.outer(std, std)


def clipped(a: np.ndarray, least: float) -> np.ndarray:
    values, vectors = np.linalg.eigh(a)
    return (vectors * np.maximum(values, least)) @ vectors.T


def corr_clipped(corr, threshold: float = 1e-15) -> np.ndarray:
    """Nearest-like correlation matrix: eigenvalues raised to threshold, diagonal scaled back to one."""
    if np.linalg.eigvalsh(corr).min() >= threshold:
        return np.array(corr, float)
    return cov2corr(clipped(np.asarray(corr, float), threshold))[0]


def corr_nearest(corr, threshold: float = 1e-15, rounds: int = 100) -> np.ndarray:
    """Nearest correlation matrix by alternating projections with Dykstra's correction."""
    x, d = np.array(corr, float), np.zeros_like(np.asarray(corr, float))
    for _ in range(rounds * len(x)):
        r = x - d
        y = clipped(r, threshold)
        d = y - r
        new = y.copy()
        np.fill_diagonal(new, 1.0)
        if np.abs(new - x).max() < 1e-12 and np.linalg.eigvalsh(new).min() >= -1e-12:
            break
        x = new
    return corr_clipped(x, threshold)


def cov_nearest(cov, method: str = "clipped", threshold: float = 1e-15) -> np.ndarray:
    corr, s = cov2corr(cov)
    return corr2cov((corr_clipped if method == "clipped" else corr_nearest)(corr, threshold), s)


@dataclass
class Pca:
    columns: list[str]
    mean: np.ndarray
    scale: np.ndarray
    eigenvalues: np.ndarray
    loadings: np.ndarray  # column by component
    nobs: int

    def project(self, df: DataFrame, components: int | None = None) -> DataFrame:
        """df with comp_1, comp_2, ...: a column expression each."""
        z = [(F.col(c) - F.lit(float(m))) / F.lit(float(s)) for c, m, s in zip(self.columns, self.mean, self.scale)]
        k = components or self.loadings.shape[1]
        return df.select("*", *(sum((F.lit(float(w)) * x for w, x in zip(self.loadings[:, i], z)), F.lit(0.0)).alias(f"comp_{i + 1}") for i in range(k)))


def pca(df: DataFrame, columns: list[str], ncomp: int | None = None, standardize: bool = True, demean: bool = True) -> Pca:
    """Components by the eigenvectors of the covariance of all rows, largest first; the largest loading of each is positive. Eigenvalues are
    those of the sums of squares."""
    cov, mean, n = covariance(df, columns)
    if not demean and not standardize:
        cov, mean = cov + np.outer(mean, mean), np.zeros(len(mean))
    s = np.sqrt(np.diag(cov)) if standardize else np.ones(len(cov))
    values, vectors = np.linalg.eigh(cov / np.outer(s, s))
    order = np.argsort(-values)[: ncomp or len(values)]
    v = vectors[:, order]
    v = v * np.sign(v[np.abs(v).argmax(0), range(v.shape[1])])
    return Pca(columns, mean, s, values[order] * n, v, n)


def factor(corr: np.ndarray, n_factor: int, method: str = "pa", rounds: int = 50, tolerance: float = 1e-8) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Loadings, communalities and eigenvalues of a correlation matrix: principal axes ("pa", by turns) or maximum likelihood ("ml")."""
    corr = np.asarray(corr, float)
    k = len(corr)
    if method == "ml":

        def split(psi):
            s = 1 / np.sqrt(psi)
            values, vectors = np.linalg.eigh(corr * np.outer(s, s))
            return values[::-1], vectors[:, ::-1]

        def loss(u):
            values, _ = split(np.exp(np.clip(u, -12, 2)))
            rest = np.maximum(values[n_factor:], 1e-12)
            return float(np.sum(rest - np.log(rest) - 1))

        start = np.log(np.clip(1 / np.diag(np.linalg.pinv(corr)), 0.05, 1) * (1 - 0.5 * n_factor / k))
        psi = np.exp(np.clip(minimize_bfgs(start, loss, gtol=1e-9).x, -12, 2))
        values, vectors = split(psi)
        load = np.sqrt(psi)[:, None] * vectors[:, :n_factor] * np.sqrt(np.maximum(values[:n_factor] - 1, 0))
    else:
        c = 1 - 1 / np.diag(np.linalg.pinv(corr))
        for _ in range(rounds):
            r = corr.copy()
            np.fill_diagonal(r, c)
            values, vectors = np.linalg.eigh(r)
            order = np.argsort(-values)[:n_factor]
            load = vectors[:, order] * np.sqrt(np.maximum(values[order], 0))
            new = (load**2).sum(1)
            done = np.abs(new - c).max() < tolerance
            c = new
            if done:
                break
        values = np.sort(values)[::-1]
    load = load * np.where(load.sum(0) < 0, -1.0, 1.0)
    return load, (load**2).sum(1), values


ROTATIONS = ("varimax", "quartimax", "equamax", "parsimax", "oblimin", "quartimin", "promax")


def rotate_factors(load: np.ndarray, method: str = "varimax", gamma: float | None = None, rounds: int = 1000, tolerance: float = 1e-10) -> tuple[np.ndarray, np.ndarray]:
    """Rotated loadings and the rotation (load @ rotation; for oblique methods load @ inv(rotation).T) by gradient projection; promax
    by powers of a varimax solution."""
    a = np.asarray(load, float)
    p, k = a.shape
    if method not in ROTATIONS:
        raise ValueError(f"{method} isn't one of {', '.join(ROTATIONS)}")
    if method == "promax":
        v, t = rotate_factors(a, "varimax")
        u = np.linalg.lstsq(v, v * np.abs(v) ** 3, rcond=None)[0]
        u = u * np.sqrt(np.diag(np.linalg.inv(u.T @ u)))
        r = t @ u
        return a @ r, np.linalg.inv(r).T
    kappa = {"quartimax": 0.0, "varimax": 1 / p, "equamax": k / (2 * p), "parsimax": (k - 1) / (p + k - 2)}.get(method)
    oblique = method in ("oblimin", "quartimin")
    g = gamma or 0.0

    def criterion(m):
        sq = m * m
        if oblique:
            x = sq @ (np.ones((k, k)) - np.eye(k))
            x = x - g / p * np.ones((p, p)) @ x
            return (sq * x).sum() / 4, m * x
        rows, cols = sq.sum(1, keepdims=True) - sq, sq.sum(0, keepdims=True) - sq
        return (1 - kappa) * (sq * rows).sum() / 4 + kappa * (sq * cols).sum() / 4, (1 - kappa) * m * rows + kappa * m * cols

    t, step = np.eye(k), 1.0
    make = (lambda t: a @ np.linalg.inv(t).T) if oblique else (lambda t: a @ t)
    m = make(t)
    f, gq = criterion(m)
    for _ in range(rounds):
        grad = -(m.T @ gq @ np.linalg.inv(t)).T if oblique else a.T @ gq
        proj = grad - t * (t * grad).sum(0) if oblique else grad - t @ (t.T @ grad + grad.T @ t) / 2
        s = np.linalg.norm(proj)
        if s < tolerance:
            break
        step *= 2
        for _ in range(20):
            x = t - step * proj
            new = x / np.sqrt((x * x).sum(0)) if oblique else (lambda uv: uv[0] @ uv[2])(np.linalg.svd(x))
            mm = make(new)
            ff, gg = criterion(mm)
            if ff < f - 0.5 * s * s * step:
                break
            step /= 2
        t, m, f, gq = new, mm, ff, gg
    return m, t


@dataclass
class CanCorr:
    correlations: np.ndarray
    x_coef: np.ndarray
    y_coef: np.ndarray
    nobs: int
    k: tuple[int, int]

    def corr_test(self) -> list[dict[str, float]]:
        """Wilks' lambda with F and p-value for the canonical correlations from the i-th on."""
        kx, ky = self.k
        out = []
        for i in range(len(self.correlations)):
            lam = float(np.prod(1 - self.correlations[i:] ** 2))
            p, q = kx - i, ky - i
            w = self.nobs - i - 1 - (p + q + 1) / 2
            t = math.sqrt((p * p * q * q - 4) / (p * p + q * q - 5)) if p * p + q * q > 5 else 1.0
            d1, d2 = p * q, w * t - p * q / 2 + 1
            root = lam ** (1 / t)
            f = (1 - root) / root * d2 / d1
            out.append({"correlation": float(self.correlations[i]), "wilks": lam, "df_num": d1, "df_denom": d2, "f": f, "pvalue": dist.f_sf(f, d1, d2)})
        return out


def cancorr(df: DataFrame, y: list[str], x: list[str]) -> CanCorr:
    cov, _, n = covariance(df, [*x, *y])
    k = len(x)
    a, b = np.linalg.inv(np.linalg.cholesky(cov[:k, :k])), np.linalg.inv(np.linalg.cholesky(cov[k:, k:]))
    u, s, vt = np.linalg.svd(a @ cov[:k, k:] @ b.T, full_matrices=False)
    return CanCorr(np.clip(s, 0, 1), a.T @ u, b.T @ vt.T, n, (k, len(y)))


def multivariate_stats(eigenvalues: np.ndarray, p: int, q: int, dof: float) -> dict[str, dict[str, float]]:
    """Wilks' lambda, Pillai's trace, Hotelling and Lawley's trace and Roy's root with their F approximations; eigenvalues are those of
    the error's inverse by the hypothesis, p responses, q degrees of freedom of the hypothesis, dof of the error."""
    lam = np.maximum(np.asarray(eigenvalues, float), 0)
    s, m, n = min(p, q), (abs(p - q) - 1) / 2, (dof - p - 1) / 2
    out = {}

    def add(name: str, value: float, f: float, d1: float, d2: float) -> None:
        out[name] = {"value": float(value), "f": float(f), "df_num": float(d1), "df_denom": float(d2), "pvalue": dist.f_sf(f, d1, d2) if d2 > 0 and math.isfinite(f) else math.nan}

    w = float(np.prod(1 / (1 + lam)))
    t = math.sqrt((p * p * q * q - 4) / (p * p + q * q - 5)) if p * p + q * q > 5 else 1.0
    d1, d2 = p * q, (dof - (p - q + 1) / 2) * t - (p * q - 2) / 2
    add("wilks", w, (1 - w ** (1 / t)) / w ** (1 / t) * d2 / d1, d1, d2)
    v = float((lam / (1 + lam)).sum())
    add("pillai", v, (2 * n + s + 1) / (2 * m + s + 1) * v / (s - v), s * (2 * m + s + 1), s * (2 * n + s + 1))
    u = float(lam.sum())
    if n > 0:
        b = (p + 2 * n) * (q + 2 * n) / (2 * (2 * n + 1) * (n - 1)) if n != 1 else math.inf
        d1, d2 = p * q, 4 + (p * q + 2) / (b - 1)
        add("hotelling", u, d2 / d1 * u / ((d2 - 2) / (2 * n)), d1, d2)
    else:
        d1, d2 = s * (2 * m + s + 1), s * (s * n + 1)
        add("hotelling", u, d2 / (s * d1) * u, d1, d2)
    r = max(p, q)
    top = float(lam.max(initial=0.0))
    add("roy", top, (dof - r + q) / r * top, r, dof - r + q)
    return out


def manova(df: DataFrame, responses: list[str], formula: str) -> dict[str, dict[str, dict[str, float]]]:
    """The four statistics for every term of a formula without response, from one matrix of products."""
    plan = design(df, formula)
    names = [*(f"x{i}" for i in range(len(plan.names))), *(f"y{i}" for i in range(len(responses)))]
    frame = df.select(*(c.cast("double").alias(n) for c, n in zip([*plan.columns, *map(F.col, responses)], names))).na.drop("any")
    size = len(names)
    got = totals(frame, lambda b: np.append((lambda z: (z.T @ z).ravel())(matrix(b, names)), b.num_rows), size * size + 1)
    g, n, k = got[:-1].reshape(size, size), int(got[-1]), len(plan.names)
    inv = np.linalg.pinv(g[:k, :k], hermitian=True)
    b = inv @ g[:k, k:]
    error = g[k:, k:] - b.T @ g[:k, k:]
    out, groups = {}, {}
    for i, name in enumerate(plan.names):
        groups.setdefault(name.split("[")[0], []).append(i)
    for name, rows in groups.items():
        h = b[rows].T @ np.linalg.pinv(inv[np.ix_(rows, rows)]) @ b[rows]
        values = np.real(np.linalg.eigvals(np.linalg.solve(error, h)))
        out[name] = multivariate_stats(values, len(responses), len(rows), n - np.linalg.matrix_rank(g[:k, :k]))
    return out
