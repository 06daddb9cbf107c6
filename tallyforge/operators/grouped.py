"""Models of grouped rows: linear mixed models, estimating equations, additive models with splines, variational mixed models."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.functions import distributions as dist
from tallyforge.operators.formula import design
from tallyforge.operators.glm import Family, Link
from tallyforge.operators.likelihood import Estimate, matrix, totals
from tallyforge.operators.linalg import approx_hess, minimize_bfgs
from tallyforge.operators.regression import Fit, inverse, rank_of


@dataclass
class MixedFit(Estimate):
    random_cov: np.ndarray | None = None
    scale: float = math.nan


def mixed(df: DataFrame, formula: str, group: str, random: str = "1", reml: bool = True) -> MixedFit:
    """Linear mixed model with random effects of a formula's terms by group, by (restricted) maximum likelihood.

    A group enters by its products X'X, Z'X, Z'Z, X'y, Z'y, y'y alone: they are summed in one aggregate, and every step of the
    search goes over this table of small rows, in Arrow batches, never over the data again.
    """
    plan, other = design(df, formula), design(df, f"{formula.partition('~')[0]} ~ {random}")
    k, q = len(plan.names), len(other.names)
    plan.columns, names = plan.columns + other.columns, plan.names
    frame = plan.frame(df, F.col(group).alias("g_"))
    cols = [*(f"x{i}" for i in range(k + q)), "y"]
    size = len(cols)
    upper = [(i, j) for i in range(size) for j in range(i, size)]
    cells = [F.sum(F.col(cols[i]) * F.col(cols[j])).alias(f"p{i}_{j}") for i, j in upper]
    groups = frame.groupBy("g_").agg(F.count("*").alias("n"), *cells).drop("g_").persist()
    try:
        n, g = groups.agg(F.sum("n"), F.count("*")).first()
        if not n:
            raise ValueError("no complete row")
        low = np.tril_indices(q)

        def root(u: np.ndarray) -> np.ndarray:
            m = np.zeros((q, q))
            m[low] = u
            return m

        def collected(u: np.ndarray) -> np.ndarray:
            """Sums over groups of X'V X, X'V y, y'V y and log determinants, for V = (I + Z psi Z')^-1."""
            chol = root(u)

            def step(batch: pa.RecordBatch) -> np.ndarray:
                v = matrix(batch, [f"p{i}_{j}" for i, j in upper])
                p = np.zeros((len(v), size, size))
                for c, (i, j) in enumerate(upper):
                    p[:, i, j] = p[:, j, i] = v[:, c]
                keep = [*range(k), size - 1]
                a, b, zz = p[:, keep][:, :, keep], p[:, k : k + q][:, :, keep], p[:, k : k + q, k : k + q]
                inner = np.eye(q) + np.einsum("ji,njk,kl->nil", chol, zz, chol)
                lb = np.einsum("ji,njk->nik", chol, b)
                s = a - np.einsum("nji,njk->nik", lb, np.linalg.solve(inner, lb))
                return np.append(s.sum(0).ravel(), np.linalg.slogdet(inner)[1].sum())

            return totals(groups, step, (k + 1) ** 2 + 1)

        def parts(u: np.ndarray):
            got = collected(u)
            s, logdet = got[:-1].reshape(k + 1, k + 1), got[-1]
            xx = s[:k, :k]
            beta = inverse(xx) @ s[:k, k]
            return xx, beta, max(float(s[k, k] - beta @ s[:k, k]), 1e-300), logdet

        def deviance(u: np.ndarray) -> float:
            xx, _, rss, logdet = parts(u)
            m = n - k if reml else n
            return m * math.log(rss / m) + logdet + (np.linalg.slogdet(xx)[1] if reml else 0.0) + m * (1 + math.log(2 * math.pi))

        found = minimize_bfgs(np.eye(q)[low], lambda u: deviance(u) / n, gtol=1e-7)
        xx, beta, rss, _ = parts(found.x)
        m = n - k if reml else n
        scale = rss / m
        psi = root(found.x) @ root(found.x).T * scale
    finally:
        groups.unpersist()
    return MixedFit(names, beta, inverse(xx) * scale, -found.fval * n / 2, int(n), found.converged, found.iters, frame, {"groups": float(g), "scale": scale}, psi, scale)


def gee(df: DataFrame, formula: str, group: str, family: str | Family = "gaussian", link: str | None = None, dependence: str = "exchangeable", rounds: int = 60, tolerance: float = 1e-8) -> tuple[Fit, float]:
    """Marginal model by estimating equations with independence or exchangeable working correlation and robust covariance; returns
    the fit and the correlation. Groups are packed once; each round goes over them in Arrow batches. A group's rows meet in one task."""
    family = Family(family) if isinstance(family, str) else family
    link = Link(link) if link else family.default_link
    plan = design(df, formula)
    k = len(plan.names)
    columns = [f"x{i}" for i in range(k)]
    frame = plan.frame(df, F.col(group).alias("g_"))
    packed = frame.groupBy("g_").agg(F.collect_list(F.array("y", *columns)).alias("rows")).select("rows").persist()
    try:
        n, mean = frame.agg(F.count("*"), F.avg("y")).first()
        if not n:
            raise ValueError("no complete row")
        beta, rho, scale, done, i = np.zeros(k), 0.0, 1.0, False, 0
        start = float(link.link(family.starting_mu(mean, mean)))
        if plan.names[:1] == ["Intercept"]:
            beta[0] = start

        def sums(batch: pa.RecordBatch) -> np.ndarray:
            b, u, meat, extra = np.zeros((k, k)), np.zeros(k), np.zeros((k, k)), np.zeros(4)
            for cell in batch.column("rows"):
                z = np.array(cell.as_py(), float)
                y, x = z[:, 0], z[:, 1:]
                eta = x @ beta
                mu = link.inverse(eta)
                s = np.sqrt(family.variance(mu))
                d = x / link.deriv(mu)[:, None] / s[:, None]
                r = (y - mu) / s
                m = len(y)
                # (I (1 - rho) + rho J)^-1 v = (v - rho sum(v) / (1 + (m - 1) rho)) / (1 - rho)
                w = lambda v: (v - rho / (1 + (m - 1) * rho) * v.sum(0)) / (1 - rho)  # noqa: B023, E731
                wd = w(d)
                b += d.T @ wd
                g = wd.T @ r
                u += g
                meat += np.outer(g, g)
                extra += [(r * r).sum(), (r.sum() ** 2 - (r * r).sum()) / 2, m * (m - 1) / 2, 1]
            return np.concatenate([b.ravel(), u, meat.ravel(), extra])

        size = 2 * k * k + k + 4
        for i in range(1, rounds + 1):
            got = totals(packed, sums, size)
            b, u = got[: k * k].reshape(k, k), got[k * k : k * k + k]
            step = inverse(b) @ u
            beta = beta + step
            done = np.abs(step).max() <= tolerance * (1 + np.abs(beta).max())
            extra = got[-4:]
            scale = extra[0] / (n - k)
            if dependence == "exchangeable" and extra[2] > k:
                rho = float(np.clip(extra[1] / (extra[2] - k) / scale, -0.9, 0.99))
            if done:
                break
        got = totals(packed, sums, size)
        inv = inverse(got[: k * k].reshape(k, k))
        cov = inv @ got[k * k + k : 2 * k * k + k].reshape(k, k) @ inv
    finally:
        packed.unpersist()
    fit = Fit(frame, plan, beta, cov, n - rank_of(b), {"nobs": n, "df_resid": n - k, "scale": scale, "iterations": i, "converged": float(done)}, True)
    fit.kind = f"GEE {family.name}"
    return fit, rho


def bspline_basis(x: np.ndarray, df: int, degree: int = 3, knots: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """B-spline columns at x (all but the first, so that a constant can stand beside them) with inner knots at quantiles, and the knots."""
    x = np.asarray(x, float)
    if knots is None:
        inner = np.quantile(x, np.linspace(0, 1, df - degree + 2)[1:-1]) if df > degree else np.zeros(0)
        knots = np.concatenate([np.full(degree + 1, x.min()), inner, np.full(degree + 1, x.max())])
    z = np.clip(x, knots[0], knots[-1])
    last = np.flatnonzero(knots < knots[-1])[-1]
    at = np.clip(np.searchsorted(knots, z, "right") - 1, degree, last)
    b = np.zeros((len(x), len(knots) - 1))
    b[np.arange(len(x)), at] = 1.0
    for d in range(1, degree + 1):
        new = np.zeros((len(x), len(knots) - 1 - d))
        for j in range(new.shape[1]):
            left, right = knots[j + d] - knots[j], knots[j + d + 1] - knots[j + 1]
            new[:, j] = (z - knots[j]) / left * b[:, j] if left else 0.0
            new[:, j] += (knots[j + d + 1] - z) / right * b[:, j + 1] if right else 0.0
        b = new
    return b[:, 1:], knots


def curvature_penalty(knots: np.ndarray, degree: int = 3) -> np.ndarray:
    """Integral of the products of second derivatives, by Gauss points between knots."""
    z, w = np.polynomial.legendre.leggauss(8)
    ends = np.unique(knots)
    total = 0.0
    for a, b in zip(ends, ends[1:]):
        p = (b - a) / 2 * z + (a + b) / 2
        h = (b - a) * 1e-3
        second = (bspline_basis(np.clip(p + h, ends[0], ends[-1]), 0, degree, knots)[0] - 2 * bspline_basis(p, 0, degree, knots)[0] + bspline_basis(np.clip(p - h, ends[0], ends[-1]), 0, degree, knots)[0]) / h**2
        total = total + (b - a) / 2 * (second.T * w) @ second
    return total


def gam(df: DataFrame, formula: str, smooth: dict[str, int], alpha: float = 1.0, family: str | Family = "gaussian", link: str | None = None, rounds: int = 100, tolerance: float = 1e-9) -> dict:
    """Additive model: a formula's terms and a penalised cubic spline of each column of smooth (name to number of columns), by penalised
    iteratively reweighted least squares. Knots are exact quantiles of all rows. Returns names, params, cov, edf, deviance, knots."""
    family = Family(family) if isinstance(family, str) else family
    link = Link(link) if link else family.default_link
    plan = design(df, formula)
    k, extra = len(plan.names), list(smooth)
    frame = plan.frame(df, *(F.col(c).cast("double").alias(f"s{i}") for i, c in enumerate(extra))).persist()
    try:
        names, knots, penalties = list(plan.names), [], [np.zeros((k, k))]
        for i, c in enumerate(extra):
            m = smooth[c]
            shares = np.linspace(0, 1, m - 3 + 2)[1:-1]
            low, high, q = frame.agg(F.min(f"s{i}"), F.max(f"s{i}"), F.percentile(f"s{i}", F.array(*(F.lit(float(p)) for p in shares)))).first()
            knots.append(np.concatenate([np.full(4, low), q or [], np.full(4, high)]))
            names += [f"{c}_s{j}" for j in range(m)]
            penalties.append(alpha * curvature_penalty(knots[-1]))
        size = len(names)
        penalty, at = np.zeros((size, size)), 0
        for p in penalties:
            penalty[at : at + len(p), at : at + len(p)] = p
            at += len(p)
        beta, before, done = None, math.inf, False
        mean = frame.agg(F.avg("y")).first()[0]
        for i in range(rounds):

            def step(batch: pa.RecordBatch) -> np.ndarray:
                y = matrix(batch, ["y"])[:, 0]
                x = np.column_stack([matrix(batch, [f"x{j}" for j in range(k)]), *(bspline_basis(matrix(batch, [f"s{j}"])[:, 0], 0, 3, t)[0] for j, t in enumerate(knots))])
                mu = family.starting_mu(y, mean) if beta is None else link.inverse(x @ beta)
                eta = link.link(mu) if beta is None else x @ beta
                g = link.deriv(mu)
                w = 1 / (g * g * family.variance(mu))
                xw = x * w[:, None]
                return np.concatenate([(x.T @ xw).ravel(), xw.T @ (eta + (y - mu) * g), [family.deviance(y, mu), len(y)]])

            got = totals(frame, step, size * size + size + 2)
            xx, xz, dev, n = got[: size * size].reshape(size, size), got[size * size : -2], got[-2], got[-1]
            if beta is not None and abs(dev - before) <= tolerance * (abs(dev) + 1e-3):
                done = True
                break
            before, beta = dev, np.linalg.solve(xx + penalty + 1e-12 * np.eye(size), xz)
        inv = np.linalg.inv(xx + penalty + 1e-12 * np.eye(size))
        edf = float(np.trace(inv @ xx))
        scale = 1.0 if family.fixed_scale else dev / (n - edf)
    finally:
        frame.unpersist()
    return {"names": names, "params": beta, "cov": inv * scale, "edf": edf, "deviance": float(dev), "scale": scale, "knots": knots, "converged": done}


def bayes_mixed(df: DataFrame, formula: str, groups: list[str], family: str = "binomial", sd_prior: float = 1.0, fixed_sd: float = 2.0, method: str = "map") -> Estimate:
    """Binomial or Poisson mixed model with a random level of each group column's values: normal priors of the coefficients, of the
    levels and of the logarithms of their deviations; the posterior's mode ("map") with its curvature. The number of levels must
    suit the driver; the likelihood is summed in Arrow batches over counts of equal rows."""
    if method != "map":
        raise ValueError("only the posterior's mode is built")
    plan = design(df, formula)
    k = len(plan.names)
    maps = []
    for c in groups:
        levels = sorted(r[0] for r in df.select(c).where(F.col(c).isNotNull()).distinct().collect())
        maps.append({v: i for i, v in enumerate(levels)})
    code = [F.element_at(F.create_map(*(x for v, i in m.items() for x in (F.lit(v), F.lit(i)))), F.col(c)).alias(f"g{j}") for j, (c, m) in enumerate(zip(groups, maps))]
    frame = plan.frame(df, *code).groupBy("y", *(f"x{i}" for i in range(k)), *(f"g{j}" for j in range(len(groups)))).agg(F.count("*").cast("double").alias("w")).persist()
    sizes = [len(m) for m in maps]
    ends = np.cumsum([k, *sizes])
    nv = len(groups)

    def likelihood(b: np.ndarray, us: list[np.ndarray]) -> np.ndarray:
        def step(batch: pa.RecordBatch) -> np.ndarray:
            y, w = matrix(batch, ["y", "w"]).T
            x, g = matrix(batch, [f"x{i}" for i in range(k)]), matrix(batch, [f"g{j}" for j in range(nv)]).astype(int)
            eta = x @ b + sum(us[j][g[:, j]] for j in range(nv))
            mu = 1 / (1 + np.exp(-eta)) if family == "binomial" else np.exp(np.minimum(eta, 50))
            f = y * eta - (np.logaddexp(0, eta) if family == "binomial" else mu)
            r = w * (y - mu)
            return np.concatenate([[np.sum(w * f)], x.T @ r, *(np.bincount(g[:, j], r, sizes[j]) for j in range(nv))])

        return totals(frame, step, 1 + ends[-1])

    def negative(p: np.ndarray) -> tuple[float, np.ndarray]:
        b, us, logs = p[:k], [p[a:e] for a, e in zip(ends, ends[1:])], p[ends[-1] :]
        got = likelihood(b, us)
        value, grad = got[0] - b @ b / (2 * fixed_sd**2) - logs @ logs / (2 * sd_prior**2), np.concatenate([got[1:], -logs / sd_prior**2])
        grad[:k] -= b / fixed_sd**2
        for j, u in enumerate(us):
            prec = math.exp(-2 * logs[j])
            value -= u @ u * prec / 2 + len(u) * logs[j]
            grad[ends[j] : ends[j + 1]] -= u * prec
            grad[ends[-1] + j] += u @ u * prec - len(u)
        return -value, -grad

    try:
        cache: dict[bytes, tuple[float, np.ndarray]] = {}

        def at(p):
            key = p.tobytes()
            if key not in cache:
                cache.clear()
                cache[key] = negative(p)
            return cache[key]

        n = frame.agg(F.sum("w")).first()[0]
        found = minimize_bfgs(np.zeros(ends[-1] + nv), lambda p: at(p)[0], lambda p: at(p)[1], gtol=1e-4)
        small = np.r_[0:k, ends[-1] : ends[-1] + nv]
        curve = lambda s: at(np.concatenate([s[:k], found.x[k : ends[-1]], s[k:]]))[0]
        cov = np.linalg.pinv(approx_hess(found.x[small], curve))
    finally:
        frame.unpersist()
    return Estimate([*plan.names, *(f"log_sd[{c}]" for c in groups)], found.x[small], cov, -found.fval, int(n or 0), found.converged, found.iters, frame, {f"levels[{c}]": float(s) for c, s in zip(groups, sizes)})


def wald(fit: Fit, contrast: np.ndarray) -> tuple[float, int, float]:
    """Chi-square of contrast @ params = 0 with degrees of freedom and p-value."""
    c = np.atleast_2d(contrast)
    v = c @ fit.params
    stat = float(v @ np.linalg.pinv(c @ fit.cov @ c.T) @ v)
    return stat, len(c), dist.chi2_sf(stat, len(c))
