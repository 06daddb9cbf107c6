"""Robust regression (M-estimators), robust scales and empirical likelihood of a mean or variance."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions import distributions as dist
from tallyforge.operators.formula import design
from tallyforge.operators.likelihood import matrix, totals
from tallyforge.operators.regression import Fit, gram, inverse, rank_of

#: Median absolute deviation of a standard normal.
MAD_C = dist.norm_ppf(0.75)


@dataclass(frozen=True)
class Norm:
    """A loss of standardised residuals: rho, psi (its slope), weights (psi(z) / z) and psi_deriv."""

    name: str
    rho: Callable
    psi: Callable
    psi_deriv: Callable

    def weights(self, z):
        z = np.asarray(z, float)
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(np.abs(z) < 1e-12, self.psi_deriv(np.zeros_like(z)), self.psi(z) / z)


def least_squares() -> Norm:
    return Norm("least squares", lambda z: 0.5 * z * z, lambda z: z, lambda z: np.ones_like(z))


def huber_t(t: float = 1.345) -> Norm:
    return Norm("Huber", lambda z: np.where(np.abs(z) <= t, 0.5 * z * z, t * np.abs(z) - 0.5 * t * t), lambda z: np.clip(z, -t, t), lambda z: (np.abs(z) <= t).astype(float))


def ramsay_e(a: float = 0.3) -> Norm:
    e = lambda z: np.exp(-a * np.abs(z))
    return Norm("Ramsay", lambda z: (1 - e(z) * (1 + a * np.abs(z))) / (a * a), lambda z: z * e(z), lambda z: e(z) * (1 - a * np.abs(z)))


def andrew_wave(a: float = 1.339) -> Norm:
    inside = lambda z: np.abs(z) <= a * math.pi
    return Norm("Andrews", lambda z: np.where(inside(z), a * a * (1 - np.cos(z / a)), 2 * a * a), lambda z: np.where(inside(z), a * np.sin(z / a), 0.0), lambda z: np.where(inside(z), np.cos(z / a), 0.0))


def tukey_biweight(c: float = 4.685) -> Norm:
    inside = lambda z: np.abs(z) <= c
    u = lambda z: 1 - np.minimum((z / c) ** 2, 1)
    return Norm("Tukey", lambda z: c * c / 6 * (1 - u(z) ** 3), lambda z: np.where(inside(z), z * u(z) ** 2, 0.0), lambda z: np.where(inside(z), u(z) * (1 - 5 * (z / c) ** 2), 0.0))


def hampel(a: float = 2.0, b: float = 4.0, c: float = 8.0) -> Norm:
    def psi(z):
        s, x = np.sign(z), np.abs(z)
        return s * np.where(x <= a, x, np.where(x <= b, a, np.where(x <= c, a * (c - x) / (c - b), 0.0)))

    def rho(z):
        x = np.abs(z)
        top = a * (b + c - a) / 2
        return np.where(x <= a, 0.5 * x * x, np.where(x <= b, a * x - a * a / 2, np.where(x <= c, top - a * (c - x) ** 2 / (2 * (c - b)), top)))

    return Norm("Hampel", rho, psi, lambda z: np.where(np.abs(z) <= a, 1.0, np.where((np.abs(z) > b) & (np.abs(z) <= c), -a / (c - b), 0.0)))


def trimmed_mean(c: float = 2.0) -> Norm:
    inside = lambda z: np.abs(z) <= c
    return Norm("trimmed mean", lambda z: np.where(inside(z), 0.5 * z * z, 0.5 * c * c), lambda z: np.where(inside(z), z, 0.0), lambda z: inside(z).astype(float))


NORMS = {"huber": huber_t, "ramsay": ramsay_e, "andrews": andrew_wave, "tukey": tukey_biweight, "hampel": hampel, "trimmed": trimmed_mean, "ls": least_squares}


def median(df: DataFrame, x: Column | str) -> float:
    return df.agg(F.percentile(x, 0.5)).first()[0]


def mad(df: DataFrame, x: Column | str, centre: float | None = None, c: float = MAD_C) -> float:
    """Median absolute deviation from the median (or centre), so scaled that it is a normal's standard deviation. NaN without rows."""
    x = F.col(x) if isinstance(x, str) else x
    m = median(df, x) if centre is None else centre
    return math.nan if m is None else median(df, F.abs(x - F.lit(m))) / c


def huber_location_scale(df: DataFrame, x: str, c: float = 1.5, rounds: int = 30, tolerance: float = 1e-8) -> tuple[float, float]:
    """Joint estimate of location and scale by Huber's second proposal: one aggregate a round."""
    gamma = dist.norm_cdf(c) * 2 - 1
    gamma = gamma + c * c * (1 - gamma) - 2 * c * dist.norm_pdf(c)
    v = F.col(x).cast("double")
    mu, s = median(df, v), mad(df, v)
    if mu is None or not s:
        return (math.nan, math.nan) if mu is None else (mu, s)
    for _ in range(rounds):
        low, high = mu - c * s, mu + c * s
        clipped = F.least(F.greatest(v, F.lit(low)), F.lit(high))
        n, new, sq = df.where(v.isNotNull()).agg(F.count(v), F.avg(clipped), F.avg(F.pow(clipped - F.lit(mu), 2))).first()
        scale = math.sqrt(n / (n - 1) * sq / gamma) if n > 1 else s
        done = abs(new - mu) <= tolerance * s and abs(scale - s) <= tolerance * s
        mu, s = new, scale
        if done:
            break
    return mu, s


def rlm(df: DataFrame, formula: str, norm: str | Norm = "huber", rounds: int = 50, tolerance: float = 1e-8, update_scale: bool = True) -> Fit:
    """M-estimate by iteratively reweighted least squares with the residuals' median absolute deviation from zero as scale.
    Covariance of Huber's first kind. stats has scale, iterations and converged."""
    norm = NORMS[norm]() if isinstance(norm, str) else norm
    plan = design(df, formula)
    k = len(plan.names)
    columns = [f"x{i}" for i in range(k)]
    frame = plan.frame(df).persist()
    try:
        x, xy, (n,) = gram(frame, k, more=[F.count("*")])
        if not n:
            raise ValueError("no complete row")
        inv, rank = inverse(x), rank_of(x)
        beta = inv @ xy
        resid = lambda: F.col("y") - sum((F.lit(float(b)) * F.col(c) for b, c in zip(beta, columns)), F.lit(0.0))
        scale, done, i = mad(frame, resid(), 0.0), False, 0
        for i in range(1, rounds + 1):
            if not scale:
                done = True
                break

            def step(batch: pa.RecordBatch) -> np.ndarray:
                z, y = matrix(batch, columns), matrix(batch, ["y"])[:, 0]
                w = norm.weights((y - z @ beta) / scale)
                zw = z * w[:, None]
                return np.concatenate([(z.T @ zw).ravel(), zw.T @ y])

            got = totals(frame, step, k * k + k)
            new = inverse(got[: k * k].reshape(k, k)) @ got[k * k :]
            done = np.abs(new - beta).max() <= tolerance * (1 + np.abs(beta).max())
            beta = new
            if update_scale:
                scale = mad(frame, resid(), 0.0)
            if done:
                break

        def last(batch: pa.RecordBatch) -> np.ndarray:
            z = (matrix(batch, ["y"])[:, 0] - matrix(batch, columns) @ beta) / scale
            d = norm.psi_deriv(z)
            return np.array([np.sum(norm.psi(z) ** 2), d.sum(), np.sum(d * d)])

        cov = inv * 0.0
        if scale:
            psi2, m1, m2 = totals(frame, last, 3)
            m = m1 / n
            var = m2 / n - m * m
            correction = 1 + rank / n * var / m**2
            cov = correction**2 * psi2 / (n - rank) * scale**2 / m**2 * inv
    finally:
        frame.unpersist()
    fit = Fit(frame, plan, beta, cov, n - rank, {"nobs": n, "df_resid": n - rank, "scale": scale, "iterations": i, "converged": float(done)}, True)
    fit.kind = f"RLM {norm.name}"
    return fit


def brentq(f: Callable[[float], float], a: float, b: float, tolerance: float = 2e-12, rounds: int = 200) -> float:
    """Root of f between a and b, at which it has different signs: inverse quadratic steps, halving where those don't help."""
    fa, fb = f(a), f(b)
    if fa == 0 or fb == 0:
        return a if fa == 0 else b
    if fa * fb > 0:
        raise ValueError("f has the same sign at both ends")
    c, fc, d, e = a, fa, b - a, b - a
    for _ in range(rounds):
        if fb * fc > 0:
            c, fc, d = a, fa, b - a
            e = d
        if abs(fc) < abs(fb):
            a, b, c, fa, fb, fc = b, c, b, fb, fc, fb
        least, half = 2e-16 * abs(b) + tolerance / 2, (c - b) / 2
        if abs(half) <= least or fb == 0:
            return b
        if abs(e) >= least and abs(fa) > abs(fb):
            s = fb / fa
            if a == c:
                p, q = 2 * half * s, 1 - s
            else:
                q, r = fa / fc, fb / fc
                p, q = s * (2 * half * q * (q - r) - (b - a) * (r - 1)), (q - 1) * (r - 1) * (s - 1)
            q = -q if p > 0 else q
            p = abs(p)
            if 2 * p < min(3 * half * q - abs(least * q), abs(e * q)):
                e, d = d, p / q
            else:
                d = e = half
        else:
            d = e = half
        a, fa = b, fb
        b += d if abs(d) > least else math.copysign(least, half)
        fb = f(b)
    return b


def fminbound(f: Callable[[float], float], a: float, b: float, tolerance: float = 1e-8, rounds: int = 500) -> float:
    """Least point of f between a and b by golden sections."""
    g = (math.sqrt(5) - 1) / 2
    x, y = b - g * (b - a), a + g * (b - a)
    fx, fy = f(x), f(y)
    for _ in range(rounds):
        if b - a <= tolerance * (1 + abs(x)):
            break
        if fx < fy:
            b, y, fy = y, x, fx
            x = b - g * (b - a)
            fx = f(x)
        else:
            a, x, fx = x, y, fy
            y = a + g * (b - a)
            fy = f(y)
    return (a + b) / 2


def el_test_mean(df: DataFrame, x: str, mean: float) -> tuple[float, float]:
    """-2 log empirical likelihood ratio of a mean and its p-value. The multiplier comes from Newton steps kept within its bounds, one
    aggregate each. A mean outside the data's range has an infinite statistic."""
    v = F.col(x).cast("double") - F.lit(float(mean))
    known = df.where(F.col(x).isNotNull())
    n, low, high = known.agg(F.count("*"), F.min(v), F.max(v)).first()
    if not n or low >= 0 or high <= 0:
        same = n and low == high == 0
        return (0.0, 1.0) if same else (math.inf, 0.0) if n else (math.nan, math.nan)
    a, b = (1 / n - 1) / high, (1 / n - 1) / low  # the multiplier's bounds: all weights lie in (0, 1]
    lam = 0.0
    for _ in range(100):
        g, h = known.agg(F.sum(v / (1 + F.lit(lam) * v)), F.sum(F.pow(v / (1 + F.lit(lam) * v), 2))).first()
        a, b = (lam, b) if g > 0 else (a, lam)
        new = lam + g / h
        if not a < new < b:
            new = (a + b) / 2
        if abs(new - lam) <= 1e-13 * (1 + abs(lam)):
            break
        lam = new
    stat = 2 * known.agg(F.sum(F.log1p(F.lit(lam) * v))).first()[0]
    return stat, dist.chi2_sf(max(stat, 0.0), 1)


def el_ci_mean(df: DataFrame, x: str, level: float = 0.95) -> tuple[float, float]:
    """Ends of the means whose empirical likelihood isn't rejected at 1 - level."""
    cut = dist.chi2_ppf(level, 1)
    n, low, high, mean = df.agg(F.count(x), F.min(x), F.max(x), F.avg(x)).first()
    if not n or low == high:
        return (low, high) if n else (math.nan, math.nan)
    g = lambda m: min(el_test_mean(df, x, m)[0], 1e6) - cut
    step = 1e-9 * (high - low)
    return brentq(g, low + step, mean, 1e-7 * (high - low)), brentq(g, mean, high - step, 1e-7 * (high - low))


def el_test_var(df: DataFrame, x: str, variance: float) -> tuple[float, float]:
    """-2 log empirical likelihood ratio of a variance, the mean being whatever suits it best, and its p-value."""
    n, low, high, mean = df.agg(F.count(x), F.min(x), F.max(x), F.avg(x)).first()
    if not n:
        return math.nan, math.nan

    def at(m: float) -> float:
        """Two conditions, on mean and variance: Newton's method on the dual for two multipliers."""
        v = (F.col(x).cast("double") - F.lit(m)).alias("v")
        frame, lam = df.where(F.col(x).isNotNull()).select(v), np.zeros(2)

        def value(l: np.ndarray) -> np.ndarray:  # noqa: E741
            def step(batch: pa.RecordBatch) -> np.ndarray:
                z = matrix(batch, ["v"])[:, 0]
                g = np.column_stack([z, z * z - variance])
                w = 1 + g @ l
                near = w > 1 / n
                u = np.where(near, w, 1.0)
                f = np.where(near, np.log(u), math.log(1 / n) - 1.5 + 2 * n * w - 0.5 * (n * w) ** 2)
                d = np.where(near, 1 / u, 2 * n - n * n * w)
                e = np.where(near, -1 / u**2, -float(n * n))
                return np.concatenate([[f.sum()], d @ g, ((g.T * e) @ g).ravel()])

            return totals(frame, step, 7)

        for _ in range(50):
            got = value(lam)
            step = -np.linalg.lstsq(got[3:].reshape(2, 2), got[1:3], rcond=None)[0]
            size = 1.0
            while size > 1e-6 and value(lam + size * step)[0] < got[0] - 1e-12:
                size /= 2
            lam = lam + size * step
            if np.abs(step).max() < 1e-10 * (1 + np.abs(lam).max()):
                break
        return 2 * value(lam)[0]

    spread = 3 * math.sqrt(max(variance, 1e-300) / n)
    best = fminbound(at, max(low, mean - spread), min(high, mean + spread), 1e-6)
    stat = at(best)
    return stat, dist.chi2_sf(max(stat, 0.0), 1)
