"""Probability distributions: density, distribution function, tails, quantiles and moments, on numpy arrays or scalars,
and as column functions over Spark DataFrames.

Every distribution has pdf (pmf for counts), cdf, sf, ppf, isf, mean and var. Tails are computed as tails, not as one less
the other side, so that small ones keep their digits. Parameters out of range raise a ValueError.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyforge.functions import special as sp

SQRT2 = math.sqrt(2)


def _positive(**values: float) -> None:
    for name, v in values.items():
        if not v > 0:
            raise ValueError(f"{name} must be positive")


class Distribution:
    """lower, upper: the ends of the support; whole: values are integers."""

    lower, upper, whole = -math.inf, math.inf, False

    def sf(self, x):
        return 1 - self.cdf(x)

    def logpdf(self, x):
        with np.errstate(divide="ignore"):
            return np.log(self.pdf(x))

    def std(self) -> float:
        return math.sqrt(self.var())

    def ppf(self, p):
        """Smallest x with cdf(x) >= p."""
        return self._quantile(p, self.cdf, True)

    def isf(self, p):
        """Smallest x with sf(x) <= p."""
        return self._quantile(p, self.sf, False)

    def _quantile(self, p, f, rising):
        given = np.asarray(p, float)
        p = np.atleast_1d(given)
        ok = (p > 0) & (p < 1)
        t = np.where(ok, p, 0.5)
        centre = self.mean() if math.isfinite(self.mean()) else 0.0
        centre = min(max(centre, self.lower), self.upper)
        up = sp.bracket(lambda d: f(np.minimum(centre + d, self.upper)), t, np.full_like(t, 1.0), rising)
        high = np.minimum(centre + up, self.upper)
        if math.isfinite(self.lower):
            low = np.full_like(t, self.lower - (1.0 if self.whole else 0.0))
        else:
            low = centre - sp.bracket(lambda d: f(centre - d), t, np.full_like(t, 1.0), not rising)
        if self.whole:
            low, high = np.floor(low), np.ceil(high)
            while np.any(high - low > 1):
                middle = np.floor((low + high) / 2)
                enough = f(middle) >= t * (1 - 1e-14) if rising else f(middle) <= t * (1 + 1e-14)
                low, high = np.where(enough, low, middle), np.where(enough, middle, high)
            x = high
        else:
            x = sp.invert(f, t, low, high, rising)
        ends = (self.lower, self.upper) if rising else (self.upper, self.lower)
        if self.whole and rising:
            ends = (self.lower - 1, self.upper)
        x = np.where(p == 0, ends[0], np.where(p == 1, ends[1], np.where(ok, x, np.nan)))
        return float(x[0]) if given.ndim == 0 else x


def _out(x, value):
    return float(value) if np.ndim(x) == 0 else value


@dataclass(frozen=True)
class Normal(Distribution):
    loc: float = 0.0
    scale: float = 1.0

    def __post_init__(self):
        _positive(scale=self.scale)

    def _z(self, x):
        return (np.asarray(x, float) - self.loc) / self.scale

    def pdf(self, x):
        return _out(x, np.exp(-0.5 * self._z(x) ** 2) / (self.scale * math.sqrt(2 * math.pi)))

    def cdf(self, x):
        return 0.5 * sp.erfc(-self._z(x) / SQRT2)

    def sf(self, x):
        return 0.5 * sp.erfc(self._z(x) / SQRT2)

    def mean(self):
        return self.loc

    def var(self):
        return self.scale**2


@dataclass(frozen=True)
class StudentT(Distribution):
    df: float

    def __post_init__(self):
        _positive(df=self.df)

    def pdf(self, x):
        x = np.asarray(x, float)
        return _out(x, np.exp(-sp.lbeta(0.5, self.df / 2) - 0.5 * math.log(self.df) - (self.df + 1) / 2 * np.log1p(x * x / self.df)))

    def sf(self, x):
        x = np.asarray(x, float)
        half = 0.5 * np.asarray(sp.betainc(self.df / 2, 0.5, self.df / (self.df + x * x)))
        return _out(x, np.where(np.isposinf(x), 0.0, np.where(np.isneginf(x), 1.0, np.where(x >= 0, half, 1 - half))))

    def cdf(self, x):
        return self.sf(-np.asarray(x, float)) if np.ndim(x) else self.sf(-x)

    def mean(self):
        return 0.0 if self.df > 1 else math.nan

    def var(self):
        return self.df / (self.df - 2) if self.df > 2 else math.inf


@dataclass(frozen=True)
class ChiSquared(Distribution):
    df: float
    lower = 0.0

    def __post_init__(self):
        _positive(df=self.df)

    def pdf(self, x):
        return Gamma(self.df / 2, 2.0).pdf(x)

    def cdf(self, x):
        return Gamma(self.df / 2, 2.0).cdf(x)

    def sf(self, x):
        return Gamma(self.df / 2, 2.0).sf(x)

    def mean(self):
        return self.df

    def var(self):
        return 2 * self.df


@dataclass(frozen=True)
class FDist(Distribution):
    d1: float
    d2: float
    lower = 0.0

    def __post_init__(self):
        _positive(d1=self.d1, d2=self.d2)

    def pdf(self, x):
        a, b, z = self.d1 / 2, self.d2 / 2, np.asarray(x, float)
        ok = z > 0
        s = np.where(ok, z, 1.0)
        y = np.exp(a * math.log(self.d1) + b * math.log(self.d2) + (a - 1) * np.log(s) - (a + b) * np.log(self.d2 + self.d1 * s) - sp.lbeta(a, b))
        return _out(x, np.where(ok, y, 0.0))

    def cdf(self, x):
        z = np.maximum(np.asarray(x, float), 0)
        return _out(x, np.where(np.isposinf(z), 1.0, sp.betainc(self.d1 / 2, self.d2 / 2, np.where(np.isposinf(z), 1.0, self.d1 * z / (self.d1 * z + self.d2)))))

    def sf(self, x):
        z = np.maximum(np.asarray(x, float), 0)
        return _out(x, sp.betainc(self.d2 / 2, self.d1 / 2, self.d2 / (self.d1 * z + self.d2)))

    def mean(self):
        return self.d2 / (self.d2 - 2) if self.d2 > 2 else math.inf

    def var(self):
        d1, d2 = self.d1, self.d2
        return 2 * d2 * d2 * (d1 + d2 - 2) / (d1 * (d2 - 2) ** 2 * (d2 - 4)) if d2 > 4 else math.inf


@dataclass(frozen=True)
class Gamma(Distribution):
    shape: float
    scale: float = 1.0
    lower = 0.0

    def __post_init__(self):
        _positive(shape=self.shape, scale=self.scale)

    def pdf(self, x):
        z = np.asarray(x, float) / self.scale
        ok = z > 0
        s = np.where(ok, z, 1.0)
        at0 = 0.0 if self.shape > 1 else 1 / self.scale if self.shape == 1 else math.inf
        return _out(x, np.where(ok, np.exp((self.shape - 1) * np.log(s) - s - sp.lgamma(self.shape)) / self.scale, np.where(z == 0, at0, 0.0)))

    def cdf(self, x):
        return sp.gammainc(self.shape, np.maximum(np.asarray(x, float), 0) / self.scale)

    def sf(self, x):
        return sp.gammaincc(self.shape, np.maximum(np.asarray(x, float), 0) / self.scale)

    def mean(self):
        return self.shape * self.scale

    def var(self):
        return self.shape * self.scale**2


@dataclass(frozen=True)
class Beta(Distribution):
    a: float
    b: float
    lower, upper = 0.0, 1.0

    def __post_init__(self):
        _positive(a=self.a, b=self.b)

    def pdf(self, x):
        z = np.asarray(x, float)
        ok = (z > 0) & (z < 1)
        s = np.where(ok, z, 0.5)
        return _out(x, np.where(ok, np.exp((self.a - 1) * np.log(s) + (self.b - 1) * np.log1p(-s) - sp.lbeta(self.a, self.b)), 0.0))

    def cdf(self, x):
        return sp.betainc(self.a, self.b, np.asarray(x, float))

    def sf(self, x):
        return sp.betainc(self.b, self.a, 1 - np.asarray(x, float))

    def mean(self):
        return self.a / (self.a + self.b)

    def var(self):
        t = self.a + self.b
        return self.a * self.b / (t * t * (t + 1))


@dataclass(frozen=True)
class Exponential(Distribution):
    rate: float = 1.0
    lower = 0.0

    def __post_init__(self):
        _positive(rate=self.rate)

    def pdf(self, x):
        z = np.asarray(x, float)
        return _out(x, np.where(z >= 0, self.rate * np.exp(-self.rate * np.maximum(z, 0)), 0.0))

    def cdf(self, x):
        return _out(x, -np.expm1(-self.rate * np.maximum(np.asarray(x, float), 0)))

    def sf(self, x):
        return _out(x, np.exp(-self.rate * np.maximum(np.asarray(x, float), 0)))

    def mean(self):
        return 1 / self.rate

    def var(self):
        return 1 / self.rate**2


@dataclass(frozen=True)
class LogNormal(Distribution):
    mu: float = 0.0
    sigma: float = 1.0
    lower = 0.0

    def __post_init__(self):
        _positive(sigma=self.sigma)

    def _log(self, x):
        z = np.asarray(x, float)
        return np.where(z > 0, np.log(np.where(z > 0, z, 1.0)), -math.inf)

    def pdf(self, x):
        z = np.asarray(x, float)
        return _out(x, np.where(z > 0, Normal(self.mu, self.sigma).pdf(self._log(x)) / np.where(z > 0, z, 1.0), 0.0))

    def cdf(self, x):
        return Normal(self.mu, self.sigma).cdf(self._log(x))

    def sf(self, x):
        return Normal(self.mu, self.sigma).sf(self._log(x))

    def mean(self):
        return math.exp(self.mu + self.sigma**2 / 2)

    def var(self):
        return math.expm1(self.sigma**2) * math.exp(2 * self.mu + self.sigma**2)


@dataclass(frozen=True)
class Uniform(Distribution):
    low: float = 0.0
    high: float = 1.0

    def __post_init__(self):
        _positive(width=self.high - self.low)
        object.__setattr__(self, "lower", self.low)
        object.__setattr__(self, "upper", self.high)

    def pdf(self, x):
        z = np.asarray(x, float)
        return _out(x, np.where((z >= self.low) & (z <= self.high), 1 / (self.high - self.low), 0.0))

    def cdf(self, x):
        return _out(x, np.clip((np.asarray(x, float) - self.low) / (self.high - self.low), 0, 1))

    def sf(self, x):
        return _out(x, np.clip((self.high - np.asarray(x, float)) / (self.high - self.low), 0, 1))

    def mean(self):
        return (self.low + self.high) / 2

    def var(self):
        return (self.high - self.low) ** 2 / 12


@dataclass(frozen=True)
class WeibullMin(Distribution):
    shape: float
    scale: float = 1.0
    lower = 0.0

    def __post_init__(self):
        _positive(shape=self.shape, scale=self.scale)

    def pdf(self, x):
        z = np.asarray(x, float) / self.scale
        s = np.where(z > 0, z, 1.0)
        return _out(x, np.where(z > 0, self.shape / self.scale * s ** (self.shape - 1) * np.exp(-(s**self.shape)), 0.0))

    def cdf(self, x):
        return _out(x, -np.expm1(-((np.maximum(np.asarray(x, float), 0) / self.scale) ** self.shape)))

    def sf(self, x):
        return _out(x, np.exp(-((np.maximum(np.asarray(x, float), 0) / self.scale) ** self.shape)))

    def mean(self):
        return self.scale * sp.gamma(1 + 1 / self.shape)

    def var(self):
        return self.scale**2 * (sp.gamma(1 + 2 / self.shape) - sp.gamma(1 + 1 / self.shape) ** 2)


@dataclass(frozen=True)
class Laplace(Distribution):
    loc: float = 0.0
    scale: float = 1.0

    def __post_init__(self):
        _positive(scale=self.scale)

    def pdf(self, x):
        return _out(x, np.exp(-np.abs(np.asarray(x, float) - self.loc) / self.scale) / (2 * self.scale))

    def cdf(self, x):
        z = (np.asarray(x, float) - self.loc) / self.scale
        half = 0.5 * np.exp(-np.abs(z))
        return _out(x, np.where(z < 0, half, 1 - half))

    def sf(self, x):
        z = (np.asarray(x, float) - self.loc) / self.scale
        half = 0.5 * np.exp(-np.abs(z))
        return _out(x, np.where(z > 0, half, 1 - half))

    def mean(self):
        return self.loc

    def var(self):
        return 2 * self.scale**2


@dataclass(frozen=True)
class Logistic(Distribution):
    loc: float = 0.0
    scale: float = 1.0

    def __post_init__(self):
        _positive(scale=self.scale)

    def pdf(self, x):
        e = np.exp(-np.abs((np.asarray(x, float) - self.loc) / self.scale))
        return _out(x, e / (self.scale * (1 + e) ** 2))

    def cdf(self, x):
        z = (np.asarray(x, float) - self.loc) / self.scale
        e = np.exp(-np.abs(z))
        return _out(x, np.where(z >= 0, 1 / (1 + e), e / (1 + e)))

    def sf(self, x):
        return self.cdf(2 * self.loc - np.asarray(x, float)) if np.ndim(x) else self.cdf(2 * self.loc - x)

    def mean(self):
        return self.loc

    def var(self):
        return self.scale**2 * math.pi**2 / 3


@dataclass(frozen=True)
class Cauchy(Distribution):
    loc: float = 0.0
    scale: float = 1.0

    def __post_init__(self):
        _positive(scale=self.scale)

    def pdf(self, x):
        z = (np.asarray(x, float) - self.loc) / self.scale
        return _out(x, 1 / (math.pi * self.scale * (1 + z * z)))

    def sf(self, x):
        return _out(x, np.arctan2(1.0, (np.asarray(x, float) - self.loc) / self.scale) / math.pi)

    def cdf(self, x):
        return _out(x, np.arctan2(1.0, (self.loc - np.asarray(x, float)) / self.scale) / math.pi)

    def mean(self):
        return math.nan

    def var(self):
        return math.nan

    def ppf(self, p):
        q = np.asarray(p, float)
        return _out(p, np.where((q >= 0) & (q <= 1), self.loc - self.scale / np.tan(math.pi * np.where(q == 0, np.nextafter(0, 1), q)), np.nan))

    def isf(self, p):
        q = np.asarray(p, float)
        return 2 * self.loc - self.ppf(p)


@dataclass(frozen=True)
class Pareto(Distribution):
    shape: float
    scale: float = 1.0

    def __post_init__(self):
        _positive(shape=self.shape, scale=self.scale)
        object.__setattr__(self, "lower", self.scale)

    def pdf(self, x):
        z = np.asarray(x, float)
        s = np.maximum(z, self.scale)
        return _out(x, np.where(z >= self.scale, self.shape / s * (self.scale / s) ** self.shape, 0.0))

    def sf(self, x):
        return _out(x, (self.scale / np.maximum(np.asarray(x, float), self.scale)) ** self.shape)

    def cdf(self, x):
        return _out(x, -np.expm1(self.shape * np.log(self.scale / np.maximum(np.asarray(x, float), self.scale))))

    def mean(self):
        return self.shape * self.scale / (self.shape - 1) if self.shape > 1 else math.inf

    def var(self):
        a = self.shape
        return self.scale**2 * a / ((a - 1) ** 2 * (a - 2)) if a > 2 else math.inf


class Discrete(Distribution):
    whole, lower = True, 0.0

    def pdf(self, x):
        return self.pmf(x)

    def pmf(self, x):
        k = np.asarray(x, float)
        ok = (k >= self.lower) & (k <= self.upper) & (k == np.floor(k))
        with np.errstate(all="ignore"):
            return _out(x, np.where(ok, np.exp(self._logpmf(np.where(ok, k, self.lower))), 0.0))

    def logpmf(self, x):
        with np.errstate(divide="ignore"):
            return np.log(self.pmf(x))


@dataclass(frozen=True)
class Poisson(Discrete):
    mu: float

    def __post_init__(self):
        _positive(mu=self.mu)

    def _logpmf(self, k):
        return k * math.log(self.mu) - self.mu - sp.lgamma(k + 1)

    def cdf(self, x):
        k = np.floor(np.asarray(x, float))
        return _out(x, np.where(k < 0, 0.0, sp.gammaincc(np.maximum(k, 0) + 1, self.mu)))

    def sf(self, x):
        k = np.floor(np.asarray(x, float))
        return _out(x, np.where(k < 0, 1.0, sp.gammainc(np.maximum(k, 0) + 1, self.mu)))

    def mean(self):
        return self.mu

    def var(self):
        return self.mu


@dataclass(frozen=True)
class Binomial(Discrete):
    n: int
    p: float

    def __post_init__(self):
        if self.n < 0 or not 0 <= self.p <= 1:
            raise ValueError("n must not be negative and p must lie in [0, 1]")
        object.__setattr__(self, "upper", float(self.n))

    def _logpmf(self, k):
        lead = sp.lgamma(self.n + 1.0) - sp.lgamma(k + 1) - sp.lgamma(self.n - k + 1)
        left = np.where(k > 0, k * math.log(self.p) if self.p > 0 else -math.inf, 0.0)
        right = np.where(k < self.n, (self.n - k) * math.log1p(-self.p) if self.p < 1 else -math.inf, 0.0)
        return lead + left + right

    def cdf(self, x):
        k = np.floor(np.asarray(x, float))
        inner = np.clip(k, 0, max(self.n - 1, 0))
        return _out(x, np.where(k < 0, 0.0, np.where(k >= self.n, 1.0, sp.betainc(np.maximum(self.n - inner, 1), inner + 1, 1 - self.p))))

    def sf(self, x):
        k = np.floor(np.asarray(x, float))
        inner = np.clip(k, 0, max(self.n - 1, 0))
        return _out(x, np.where(k < 0, 1.0, np.where(k >= self.n, 0.0, sp.betainc(inner + 1, np.maximum(self.n - inner, 1), self.p))))

    def mean(self):
        return self.n * self.p

    def var(self):
        return self.n * self.p * (1 - self.p)


@dataclass(frozen=True)
class Geometric(Discrete):
    """Trials up to the first success: 1, 2, ..."""

    p: float
    lower = 1.0

    def __post_init__(self):
        if not 0 < self.p <= 1:
            raise ValueError("p must lie in (0, 1]")

    def _logpmf(self, k):
        return math.log(self.p) + np.where(k > 1, (k - 1) * (math.log1p(-self.p) if self.p < 1 else -math.inf), 0.0)

    def sf(self, x):
        k = np.maximum(np.floor(np.asarray(x, float)), 0)
        return _out(x, (1 - self.p) ** k)

    def cdf(self, x):
        k = np.maximum(np.floor(np.asarray(x, float)), 0)
        return _out(x, -np.expm1(k * math.log1p(-self.p)) if self.p < 1 else np.where(k >= 1, 1.0, 0.0))

    def mean(self):
        return 1 / self.p

    def var(self):
        return (1 - self.p) / self.p**2


@dataclass(frozen=True)
class NegativeBinomial(Discrete):
    """Failures before the n-th success."""

    n: float
    p: float

    def __post_init__(self):
        _positive(n=self.n)
        if not 0 < self.p <= 1:
            raise ValueError("p must lie in (0, 1]")

    def _logpmf(self, k):
        return sp.lgamma(k + self.n) - sp.lgamma(self.n) - sp.lgamma(k + 1) + self.n * math.log(self.p) + np.where(k > 0, k * (math.log1p(-self.p) if self.p < 1 else -math.inf), 0.0)

    def cdf(self, x):
        k = np.floor(np.asarray(x, float))
        return _out(x, np.where(k < 0, 0.0, sp.betainc(self.n, np.maximum(k, 0) + 1, self.p)))

    def sf(self, x):
        k = np.floor(np.asarray(x, float))
        return _out(x, np.where(k < 0, 1.0, sp.betainc(np.maximum(k, 0) + 1, self.n, 1 - self.p)))

    def mean(self):
        return self.n * (1 - self.p) / self.p

    def var(self):
        return self.n * (1 - self.p) / self.p**2


def _functions(name: str, make) -> dict:
    def one(method):
        def call(x, *parameters):
            return getattr(make(*parameters), method)(x)

        call.__name__ = f"{name}_{method}"
        return call

    return {f"{name}_{m}": one(m) for m in ("pdf", "cdf", "sf", "ppf", "isf")}


#: norm_pdf(x), t_cdf(x, df), f_sf(x, d1, d2), chi2_ppf(p, df) and so on, for arrays and scalars.
globals().update(_functions("norm", Normal) | _functions("t", StudentT) | _functions("f", FDist) | _functions("chi2", ChiSquared))
#: The incomplete functions under the names that other modules use.
gamma_q, beta_i = sp.gammaincc, sp.betainc


@dataclass
class StepFunction:
    """A right-continuous step function (or left-continuous with side "left"): start before the first of x, then y."""

    x: np.ndarray
    y: np.ndarray
    start: float = 0.0
    side: str = "right"

    def __post_init__(self):
        x, y = np.asarray(self.x, float), np.asarray(self.y, float)
        if len(x) != len(y):
            raise ValueError("x and y differ in length")
        order = np.argsort(x, kind="stable")
        self.x, self.y = x[order], np.concatenate([[self.start], y[order]])

    def __call__(self, at):
        value = self.y[np.searchsorted(self.x, np.asarray(at, float), "right" if self.side == "right" else "left")]
        return _out(at, value)


class Ecdf(StepFunction):
    """Share of a sample up to (side "right") or below (side "left") a point."""

    def __init__(self, sample, side: str = "right"):
        s = np.sort(np.asarray(sample, float))
        super().__init__(s, np.arange(1, len(s) + 1) / len(s), 0.0, side)


def column(distribution: Distribution, method: str, x: Column | str) -> Column:
    """A distribution's pdf, cdf, sf, ppf or isf of a double column. Null stays null.

    Closed forms (exponential, Weibull, Laplace, logistic, Cauchy, Pareto, uniform, normal density) are built-in
    expressions inside code generation; others run in Arrow batches.
    """
    x = (F.col(x) if isinstance(x, str) else x).cast("double")
    built = _built_in(distribution, method, x)
    if built is not None:
        return built
    import pandas as pd
    from pyspark.sql.functions import pandas_udf

    def apply(v: pd.Series) -> pd.Series:
        a = v.to_numpy(float)
        return pd.Series(np.where(np.isnan(a), np.nan, getattr(distribution, method)(np.where(np.isnan(a), 0.5, a)))).where(v.notna(), None)

    apply.__annotations__ = {"v": pd.Series, "return": pd.Series}
    return pandas_udf(apply, "double")(x)


def _built_in(d: Distribution, method: str, x: Column) -> Column | None:
    at_least = lambda low: F.greatest(x, F.lit(float(low)))
    known = lambda e: F.when(x.isNotNull(), e)  # noqa: E731  greatest() and least() skip nulls
    if isinstance(d, Normal) and method == "pdf":
        return F.exp(-0.5 * F.pow((x - d.loc) / d.scale, 2)) / (d.scale * math.sqrt(2 * math.pi))
    if isinstance(d, Exponential):
        return {"pdf": F.when(x < 0, 0.0).otherwise(d.rate * F.exp(-d.rate * x)), "cdf": known(-F.expm1(-d.rate * at_least(0))), "sf": known(F.exp(-d.rate * at_least(0))), "ppf": -F.log1p(-x) / d.rate, "isf": -F.log(x) / d.rate}[method]
    if isinstance(d, WeibullMin) and method != "pdf":
        h = F.pow(at_least(0) / d.scale, d.shape)
        return {"cdf": known(-F.expm1(-h)), "sf": known(F.exp(-h)), "ppf": d.scale * F.pow(-F.log1p(-x), 1 / d.shape), "isf": d.scale * F.pow(-F.log(x), 1 / d.shape)}[method]
    if isinstance(d, Uniform):
        w = d.high - d.low
        u = F.least(F.greatest((x - d.low) / w, F.lit(0.0)), F.lit(1.0))
        return {"pdf": F.when(x.between(d.low, d.high), 1 / w).when(x.isNotNull(), 0.0), "cdf": known(u), "sf": known(1 - u), "ppf": d.low + x * w, "isf": d.high - x * w}[method]
    z = (x - getattr(d, "loc", 0.0)) / getattr(d, "scale", 1.0)
    if isinstance(d, Logistic):
        return {"pdf": F.exp(-F.abs(z)) / (d.scale * F.pow(1 + F.exp(-F.abs(z)), 2)), "cdf": 1 / (1 + F.exp(-z)), "sf": 1 / (1 + F.exp(z)), "ppf": d.loc + d.scale * F.log(x / (1 - x)), "isf": d.loc - d.scale * F.log(x / (1 - x))}[method]
    if isinstance(d, Laplace) and method in ("pdf", "cdf", "sf"):
        half = 0.5 * F.exp(-F.abs(z))
        return {"pdf": half / d.scale, "cdf": F.when(z < 0, half).otherwise(1 - half), "sf": F.when(z > 0, half).otherwise(1 - half)}[method]
    if isinstance(d, Cauchy):
        return {"pdf": 1 / (math.pi * d.scale * (1 + z * z)), "cdf": F.atan2(F.lit(1.0), -z) / math.pi, "sf": F.atan2(F.lit(1.0), z) / math.pi, "ppf": d.loc - d.scale / F.tan(math.pi * x), "isf": d.loc + d.scale / F.tan(math.pi * x)}[method]
    if isinstance(d, Pareto) and method != "pdf":
        return {"sf": known(F.pow(d.scale / at_least(d.scale), d.shape)), "cdf": known(-F.expm1(d.shape * F.log(d.scale / at_least(d.scale)))), "ppf": d.scale * F.pow(1 - x, -1 / d.shape), "isf": d.scale * F.pow(x, -1 / d.shape)}[method]
    return None
