"""Generalised linear models: families, links and iteratively reweighted least squares, one Arrow pass over the data a round."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions import distributions as dist
from tallyforge.functions import special as sp
from tallyforge.operators.formula import design
from tallyforge.operators.likelihood import matrix, totals
from tallyforge.operators.regression import Fit, inverse, rank_of

TINY = np.finfo(float).tiny
EPS = np.finfo(float).eps


def _xlogy(x, y):
    return np.where(x > 0, x * np.log(np.where(x > 0, y, 1.0)), 0.0)


class Link:
    """link: eta of a mean; inverse: mean of eta; deriv: d eta / d mean. power holds for the power family of links."""

    NAMES = ("identity", "log", "logit", "probit", "cloglog", "inverse", "inverse_squared", "sqrt")

    def __init__(self, name: str):
        if name not in self.NAMES:
            raise ValueError(f"{name} isn't one of {', '.join(self.NAMES)}")
        self.name = name

    def link(self, mu):
        mu = np.asarray(mu, float)
        p = np.clip(mu, EPS, 1 - EPS)
        return {
            "identity": lambda: mu, "log": lambda: np.log(np.maximum(mu, TINY)), "logit": lambda: np.log(p / (1 - p)), "probit": lambda: np.asarray(dist.norm_ppf(p)),
            "cloglog": lambda: np.log(-np.log1p(-p)), "inverse": lambda: 1 / mu, "inverse_squared": lambda: 1 / mu**2, "sqrt": lambda: np.sqrt(mu),
        }[self.name]()

    def inverse(self, eta):
        eta = np.asarray(eta, float)
        return {
            "identity": lambda: eta, "log": lambda: np.exp(eta), "logit": lambda: 1 / (1 + np.exp(-eta)), "probit": lambda: np.asarray(dist.norm_cdf(eta)),
            "cloglog": lambda: -np.expm1(-np.exp(eta)), "inverse": lambda: 1 / eta, "inverse_squared": lambda: 1 / np.sqrt(eta), "sqrt": lambda: eta**2,
        }[self.name]()

    def deriv(self, mu):
        mu = np.asarray(mu, float)
        p = np.clip(mu, EPS, 1 - EPS)
        return {
            "identity": lambda: np.ones_like(mu), "log": lambda: 1 / mu, "logit": lambda: 1 / (p * (1 - p)), "probit": lambda: 1 / np.asarray(dist.norm_pdf(dist.norm_ppf(p))),
            "cloglog": lambda: -1 / ((1 - p) * np.log1p(-p)), "inverse": lambda: -1 / mu**2, "inverse_squared": lambda: -2 / mu**3, "sqrt": lambda: 0.5 / np.sqrt(mu),
        }[self.name]()


@dataclass(frozen=True)
class Family:
    """name: gaussian, binomial, poisson, gamma, inverse_gaussian, negative_binomial (alpha) or tweedie (power between 1 and 2)."""

    name: str
    alpha: float = 1.0
    power: float = 1.5

    DEFAULTS = {"gaussian": "identity", "binomial": "logit", "poisson": "log", "gamma": "inverse", "inverse_gaussian": "inverse_squared", "negative_binomial": "log", "tweedie": "log"}  # noqa: RUF012

    def __post_init__(self):
        if self.name not in self.DEFAULTS:
            raise ValueError(f"{self.name} isn't one of {', '.join(self.DEFAULTS)}")

    @property
    def default_link(self) -> Link:
        return Link(self.DEFAULTS[self.name])

    @property
    def fixed_scale(self) -> bool:
        return self.name in ("binomial", "poisson", "negative_binomial")

    def variance(self, mu):
        return {"gaussian": lambda: np.ones_like(mu), "binomial": lambda: mu * (1 - mu), "poisson": lambda: mu, "gamma": lambda: mu**2, "inverse_gaussian": lambda: mu**3, "negative_binomial": lambda: mu + self.alpha * mu**2, "tweedie": lambda: mu**self.power}[self.name]()

    def starting_mu(self, y, mean):
        return (y + 0.5) / 2 if self.name == "binomial" else (y + mean) / 2

    def unit_deviance(self, y, mu):
        a, p = self.alpha, self.power
        with np.errstate(all="ignore"):
            return {
                "gaussian": lambda: (y - mu) ** 2,
                "binomial": lambda: 2 * (_xlogy(y, y / mu) + _xlogy(1 - y, (1 - y) / (1 - mu))),
                "poisson": lambda: 2 * (_xlogy(y, y / mu) - (y - mu)),
                "gamma": lambda: 2 * (-np.log(y / mu) + (y - mu) / mu),
                "inverse_gaussian": lambda: (y - mu) ** 2 / (y * mu**2),
                "negative_binomial": lambda: 2 * (_xlogy(y, y / mu) - (y + 1 / a) * np.log((1 + a * y) / (1 + a * mu))),
                "tweedie": lambda: 2 * (y ** (2 - p) / ((1 - p) * (2 - p)) - y * mu ** (1 - p) / (1 - p) + mu ** (2 - p) / (2 - p)),
            }[self.name]()

    def deviance(self, y, mu) -> float:
        return float(np.sum(self.unit_deviance(y, mu)))

    def loglike_obs(self, y, mu, scale: float = 1.0):
        a = self.alpha
        with np.errstate(all="ignore"):
            return {
                "gaussian": lambda: -0.5 * ((y - mu) ** 2 / scale + math.log(2 * math.pi * scale)),
                "binomial": lambda: _xlogy(y, mu) + _xlogy(1 - y, 1 - mu),
                "poisson": lambda: _xlogy(y, mu) - mu - sp.lgamma(y + 1),
                "gamma": lambda: (-y / mu - np.log(mu)) / scale + (1 / scale - 1) * np.log(y) - math.log(scale) / scale - math.lgamma(1 / scale),
                "inverse_gaussian": lambda: -0.5 * ((y - mu) ** 2 / (y * mu**2 * scale) + np.log(2 * math.pi * scale * y**3)),
                "negative_binomial": lambda: _xlogy(y, a * mu / (1 + a * mu)) - np.log1p(a * mu) / a + sp.lgamma(y + 1 / a) - sp.lgamma(y + 1) - math.lgamma(1 / a),
                "tweedie": lambda: tweedie_logpdf(y, mu, scale, self.power),
            }[self.name]()

    def loglike(self, y, mu, scale: float = 1.0) -> float:
        return float(np.sum(self.loglike_obs(y, mu, scale)))


def tweedie_logpdf(y, mu, phi: float, p: float):
    """Log-density of the compound Poisson-gamma (1 < p < 2): a point mass at zero, a series of gammas elsewhere, summed
    around its largest term until what is left doesn't count."""
    y, mu = np.broadcast_arrays(np.asarray(y, float), np.asarray(mu, float))
    rate = mu ** (2 - p) / (phi * (2 - p))
    alpha = (2 - p) / (p - 1)
    out = -rate.astype(float)
    some = y > 0
    if some.any():
        v, m = y[some], mu[some]
        lead = alpha * np.log(v) - alpha * math.log(p - 1) - (1 + alpha) * math.log(phi) - math.log(2 - p)
        peak = np.maximum(1, v ** (2 - p) / (phi * (2 - p)))
        width = int(12 * math.sqrt(peak.max() / max(alpha, 1e-6)) + 30)
        low = np.maximum(1, np.floor(peak) - width)
        j = low[:, None] + np.arange(2 * width + 1)
        terms = j * lead[:, None] - sp.lgamma(j + 1) - sp.lgamma(alpha * j)
        top = terms.max(1)
        series = top + np.log(np.exp(terms - top[:, None]).sum(1))
        out[some] = (v * m ** (1 - p) / (1 - p) - m ** (2 - p) / (2 - p)) / phi - np.log(v) + series
    return out


def glm(df: DataFrame, formula: str, family: str | Family, link: str | None = None, rounds: int = 300, tolerance: float = 1e-10, offset: str | None = None, weights: str | None = None) -> Fit:
    """Generalised linear model. stats has nobs, deviance, null_deviance, pearson_chi2, scale, llf, llf_null, aic, bic,
    pseudo_rsquared (of deviances), pseudo_rsquared_cs, iterations and converged (1 or 0: at rest within rounds)."""
    family = Family(family) if isinstance(family, str) else family
    link = Link(link) if link else family.default_link
    plan = design(df, formula)
    k = len(plan.names)
    cells: list[Column] = [(F.col(offset).cast("double") if offset else F.lit(0.0)).alias("o"), (F.col(weights).cast("double") if weights else F.lit(1.0)).alias("w")]
    frame = plan.frame(df, *cells).persist()
    columns = [f"x{i}" for i in range(k)]
    try:
        n, total, ysum = frame.agg(F.count("*"), F.sum("w"), F.sum(F.col("w") * F.col("y"))).first()
        if not n:
            raise ValueError("no complete row")
        mean = ysum / total
        beta = None

        def step(batch: pa.RecordBatch) -> np.ndarray:
            x, (y, o, w) = matrix(batch, columns), matrix(batch, ["y", "o", "w"]).T
            with np.errstate(all="ignore"):
                if beta is None:
                    mu = family.starting_mu(y, mean)
                    eta = link.link(mu)
                else:
                    eta = x @ beta + o
                    mu = link.inverse(eta)
                if family.name == "binomial":
                    mu = np.clip(mu, EPS, 1 - EPS)
                elif family.name != "gaussian":
                    mu = np.maximum(mu, TINY)
                g = link.deriv(mu)
                v = family.variance(mu)
                s = w / (g * g * v)
                z = eta - o + (y - mu) * g
                xs = x * s[:, None]
                return np.concatenate([(x.T @ xs).ravel(), xs.T @ z, [np.sum(w * family.unit_deviance(y, mu)), np.sum(w * (y - mu) ** 2 / v)]])

        before, done, i = math.inf, False, 0
        for i in range(1, rounds + 2):
            got = totals(frame, step, k * k + k + 2)
            x, xz, (dev, pearson) = got[: k * k].reshape(k, k), got[k * k : k * k + k], got[-2:]
            if beta is not None and abs(dev - before) <= tolerance * (abs(dev) + 1e-3):
                done = True
                break
            if i > rounds:
                break
            before, beta = dev, inverse(x) @ xz
        rank = rank_of(x)
        scale = 1.0 if family.fixed_scale else pearson / (n - rank) if n > rank else math.nan
        llf_scale = dev / n if family.name == "gaussian" else scale

        def last(batch: pa.RecordBatch) -> np.ndarray:
            y, o, w = matrix(batch, ["y", "o", "w"]).T
            mu = link.inverse(matrix(batch, columns) @ beta + o)
            flat = np.full_like(y, mean)
            return np.array([np.sum(w * family.loglike_obs(y, mu, llf_scale)), np.sum(w * family.unit_deviance(y, flat)), np.sum(w * family.loglike_obs(y, flat, 1.0 if family.fixed_scale else llf_scale))])

        llf, null, llf_null = totals(frame, last, 3)
        if family.name == "gaussian":
            llf_null = -n / 2 * (math.log(2 * math.pi * null / n) + 1) if null > 0 else math.inf
    finally:
        frame.unpersist()
    stats = {
        "nobs": n, "df_model": rank - 1, "df_resid": n - rank, "deviance": dev, "null_deviance": null, "pearson_chi2": pearson, "scale": scale, "llf": llf, "llf_null": llf_null, "aic": 2 * rank - 2 * llf, "bic": math.log(n) * rank - 2 * llf,
        "pseudo_rsquared": 1 - dev / null if null else math.nan, "pseudo_rsquared_cs": 1 - math.exp(min(2 / n * (llf_null - llf), 700.0)), "iterations": i - 1, "converged": float(done),
    }
    fit = Fit(frame, plan, beta, inverse(x) * scale, n - rank, {a: float(b) for a, b in stats.items()}, True)
    fit.mean = lambda eta: inverse_column(link, eta)
    fit.kind = f"GLM {family.name} {link.name}"
    return fit


def inverse_column(link: Link, eta: Column) -> Column:
    """Mean as a column of a linear predictor."""
    return {
        "identity": lambda: eta, "log": lambda: F.exp(eta), "logit": lambda: 1 / (1 + F.exp(-eta)), "probit": lambda: dist.column(dist.Normal(), "cdf", eta),
        "cloglog": lambda: -F.expm1(-F.exp(eta)), "inverse": lambda: 1 / eta, "inverse_squared": lambda: 1 / F.sqrt(eta), "sqrt": lambda: eta * eta,
    }[link.name]()
