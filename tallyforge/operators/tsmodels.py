"""Models of one series as numpy functions: filters, ARMA theory, smoothing, state space, regimes. Operators in series.py run
them over many series, one task each."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np

from tallyforge.functions import distributions as dist
from tallyforge.operators.linalg import approx_hess, minimize_bfgs

#: Statistics at 10, 5, 2.5 and 1 percent.
KPSS_CRITICAL = {"c": [0.347, 0.463, 0.574, 0.739], "ct": [0.119, 0.146, 0.176, 0.216]}


def toeplitz(c: np.ndarray) -> np.ndarray:
    return np.asarray(c)[np.abs(np.subtract.outer(range(len(c)), range(len(c))))]


def yule_walker(gamma: np.ndarray) -> tuple[np.ndarray, float]:
    """Autoregressive coefficients and error variance from autocovariances 0 to p."""
    gamma = np.asarray(gamma, float)
    rho = np.linalg.solve(toeplitz(gamma[:-1]), gamma[1:])
    return rho, float(gamma[0] - rho @ gamma[1:])


def innovations_algo(acov: np.ndarray, nobs: int) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients theta (row n: those of step n, nearest first) and error variances of one-step predictors."""
    g = np.concatenate([np.asarray(acov, float), np.zeros(max(0, nobs + 1 - len(acov)))])
    v, theta = np.zeros(nobs), np.zeros((nobs, nobs))
    v[0] = g[0]
    for n in range(1, nobs):
        for k in range(n):
            s = sum(theta[k, k - j - 1] * theta[n, n - j - 1] * v[j] for j in range(k))
            theta[n, n - k - 1] = (g[n - k] - s) / v[k]
        v[n] = g[0] - sum(theta[n, n - j - 1] ** 2 * v[j] for j in range(n))
    return theta, v


def arma_impulse_response(ar, ma, leads: int = 100) -> np.ndarray:
    """Weights of past errors; ar and ma are lag polynomials with their leading 1 (ar = [1, -phi])."""
    psi = np.zeros(leads)
    for j in range(leads):
        psi[j] = (ma[j] if j < len(ma) else 0.0) - sum(ar[i] * psi[j - i] for i in range(1, min(j, len(ar) - 1) + 1))
        psi[j] /= ar[0]
    return psi


def arma_acovf(ar, ma, nobs: int = 10, sigma2: float = 1.0) -> np.ndarray:
    """Autocovariances 0 to nobs - 1 of a stationary ARMA."""
    ar, ma = np.asarray(ar, float) / ar[0], np.asarray(ma, float)
    p, q = len(ar) - 1, len(ma) - 1
    m = max(p, q) + 1
    psi = arma_impulse_response(ar, ma, m)
    a, b = np.zeros((m, m)), np.zeros(m)
    for k in range(m):
        for i in range(p + 1):
            a[k, abs(k - i)] += ar[i]
        b[k] = sigma2 * sum(ma[j] * psi[j - k] for j in range(k, q + 1))
    g = np.linalg.solve(a, b)
    out = list(g[:nobs])
    while len(out) < nobs:
        out.append(-sum(ar[i] * out[-i] for i in range(1, p + 1)))
    return np.array(out[:nobs])


def arma_acf(ar, ma, lags: int = 10) -> np.ndarray:
    g = arma_acovf(ar, ma, lags)
    return g / g[0]


def arma_pacf(ar, ma, lags: int = 10) -> np.ndarray:
    g = arma_acovf(ar, ma, lags + 1)
    return np.array([1.0, *(yule_walker(g[: k + 1])[0][-1] for k in range(1, lags))])


def hpfilter(x: np.ndarray, lamb: float = 1600.0) -> tuple[np.ndarray, np.ndarray]:
    """Cycle and trend; the system has five diagonals and is solved by a banded Cholesky factor, in time of the length."""
    n = len(x)
    if n < 3:
        return np.zeros(n), np.array(x, float)
    d0, d1, d2 = np.ones(n), np.zeros(n), np.zeros(n)  # diagonals of I + lamb D'D
    for k, row in enumerate(np.repeat([[1.0, -2.0, 1.0]], n - 2, 0)):
        d0[k : k + 3] += lamb * row * row
        d1[k : k + 2] += lamb * row[:2] * row[1:]
        d2[k] += lamb * row[0] * row[2]
    a, b, c, z = np.zeros(n), np.zeros(n), np.zeros(n), np.array(x, float)
    for i in range(n):
        raw = d2[i - 2] if i > 1 else 0.0
        b[i] = (d1[i - 1] - (raw * b[i - 1] if i > 1 else 0.0)) / a[i - 1] if i else 0.0
        c[i] = raw / a[i - 2] if i > 1 else 0.0
        a[i] = d0[i] - (b[i] ** 2 * a[i - 1] if i else 0.0) - (c[i] ** 2 * a[i - 2] if i > 1 else 0.0)
        z[i] -= (b[i] * z[i - 1] if i else 0.0) + (c[i] * z[i - 2] if i > 1 else 0.0)
    t = z / a
    for i in range(n - 2, -1, -1):
        t[i] -= b[i + 1] * t[i + 1] + (c[i + 2] * t[i + 2] if i + 2 < n else 0.0)
    return np.asarray(x, float) - t, t


def bkfilter(x: np.ndarray, low: float = 6, high: float = 32, k: int = 12) -> tuple[np.ndarray, np.ndarray]:
    w1, w2 = 2 * math.pi / high, 2 * math.pi / low
    j = np.arange(1, k + 1)
    side = (np.sin(w2 * j) - np.sin(w1 * j)) / (math.pi * j)
    b = np.concatenate([side[::-1], [(w2 - w1) / math.pi], side])
    b -= b.mean()
    cycle = np.full(len(x), np.nan)
    if len(x) > 2 * k:
        cycle[k : len(x) - k] = np.convolve(x, b[::-1], "valid")
    return cycle, np.asarray(x, float) - cycle


def cffilter(x: np.ndarray, low: float = 6, high: float = 32, drift: bool = True) -> tuple[np.ndarray, np.ndarray]:
    n = len(x)
    given = np.asarray(x, float)
    z = given - np.arange(n) * (given[-1] - given[0]) / (n - 1) if drift and n > 1 else given
    a, b = 2 * math.pi / high, 2 * math.pi / low
    j = np.arange(1, n + 1)
    side = np.concatenate([[(b - a) / math.pi], (np.sin(b * j) - np.sin(a * j)) / (math.pi * j)])
    cycle = np.zeros(n)
    for i in range(n):
        ahead, back = n - 1 - i, i
        end = -0.5 * side[0] - side[1:ahead].sum() if ahead else 0.0
        start = -side[0] - side[1:ahead].sum() - side[1:back].sum() - end if ahead or back else 0.0
        mid = side[0] * z[i]
        fore = side[1:ahead] @ z[i + 1 : i + ahead] + end * z[-1] if ahead else 0.0
        aft = side[1:back] @ z[i - back + 1 : i][::-1] + start * z[0] if back else 0.0
        cycle[i] = mid + fore + aft
    return cycle, given - cycle


def loess(x: np.ndarray, window: int, at: np.ndarray) -> np.ndarray:
    """Local linear fits of evenly spaced x (places 0, 1, ...) with tricube weights at the places at."""
    n = len(x)
    out = np.empty(len(at))
    q = min(window, n)
    for i, p in enumerate(at):
        left = int(min(max(math.floor(p) - (q - 1) // 2, 0), n - q)) if q < n else 0
        s = np.arange(left, left + q)
        h = max(p - s[0], s[-1] - p) + (max(window - n, 0) / 2 if window > n else 0.0)
        u = np.abs(s - p) / h if h > 0 else np.zeros(q)
        w = np.where(u <= 0.001, 1.0, np.where(u < 0.999, (1 - u**3) ** 3, 0.0))
        w /= w.sum()
        m = w @ s
        v = w @ (s - m) ** 2
        if math.sqrt(v) > 0.001 * (n - 1):
            w = w * (1 + (p - m) / v * (s - m))
        out[i] = w @ x[left : left + q]
    return out


def stl(x: np.ndarray, period: int, seasonal: int = 7, trend: int | None = None, low_pass: int | None = None, inner: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Trend and seasonal part by local regressions of degree one, without robustness weights."""
    n = len(x)
    odd = lambda v: int(v) + (int(v) % 2 == 0)
    trend = trend or odd(math.ceil(1.5 * period / (1 - 1.5 / seasonal)))
    low_pass = low_pass or odd(period + 1)
    t, s = np.zeros(n), np.zeros(n)
    mean = lambda v, k: np.convolve(v, np.ones(k) / k, "valid")
    for _ in range(inner):
        d, c = x - t, np.zeros(n + 2 * period)
        for p in range(period):
            part = d[p::period]
            c[p::period][: len(part) + 2] = loess(part, seasonal, np.arange(-1, len(part) + 1, dtype=float))
        low = mean(mean(mean(c, period), period), 3)
        low = loess(low, low_pass, np.arange(n, dtype=float))
        s = c[period : period + n] - low
        t = loess(x - s, trend, np.arange(n, dtype=float))
    return t, s


@dataclass
class Smoothed:
    """An exponential smoothing fit: parameters, fitted values, last states and their rule."""

    params: dict[str, float]
    fitted: np.ndarray
    sse: float
    level: float
    slope: float
    season: np.ndarray
    multiplicative: bool

    def forecast(self, h: int) -> np.ndarray:
        k = np.arange(1, h + 1)
        base = self.level + k * self.slope
        if not len(self.season):
            return base
        s = self.season[(k - 1) % len(self.season)]
        return base * s if self.multiplicative else base + s


def smooth(x: np.ndarray, trend: bool = False, seasonal: str | None = None, period: int = 0, fixed: dict[str, float] | None = None) -> Smoothed:
    """Exponential smoothing with optional additive trend and additive ("add") or multiplicative ("mul") season. Start values
    are heuristic: the first period's mean, the mean change over a period, and the deviations of the first period
    (without season: the first value and change). Weights make the sum of squared one-step errors least, unless fixed."""
    x, fixed = np.asarray(x, float), fixed or {}
    n = len(x)
    mul = seasonal == "mul"
    if seasonal and n < 2 * period:
        raise ValueError("a season needs two periods of data")
    if seasonal:
        level0 = x[:period].mean()
        slope0 = (x[period : 2 * period] - x[:period]).mean() / period if trend else 0.0
        season0 = x[:period] / level0 if mul else x[:period] - level0
    else:
        level0, slope0, season0 = x[0], (x[1] - x[0] if trend and n > 1 else 0.0), np.zeros(0)

    names = ["alpha", *(["beta"] if trend else []), *(["gamma"] if seasonal else [])]
    free = [m for m in names if m not in fixed]

    def run(p: dict[str, float]) -> Smoothed:
        a, b, g = p["alpha"], p.get("beta", 0.0), p.get("gamma", 0.0)
        level, slope, season, fitted = level0, slope0, season0.copy(), np.empty(n)
        for i, v in enumerate(x):
            s = season[i % period] if period and seasonal else (1.0 if mul else 0.0)
            base = level + slope
            fitted[i] = base * s if mul else base + s
            new = a * (v / s if mul else v - s) + (1 - a) * base
            if trend:
                slope = b * (new - level) + (1 - b) * slope
            if seasonal:
                season[i % period] = g * (v / base if mul else v - base) + (1 - g) * s
            level = new
        order = np.roll(season, -(n % period)) if seasonal else season
        return Smoothed(p, fitted, float(((x - fitted) ** 2).sum()), level, slope, order, mul)

    expit = lambda u: 1 / (1 + math.exp(-min(max(u, -30), 30)))
    make = lambda u: fixed | dict(zip(free, map(expit, u)))
    if not free:
        return run(dict(fixed))
    best = min((np.array(s) for s in np.ndindex(*[3] * len(free))), key=lambda s: run(make(-2.0 + 2.0 * s)).sse)
    scale = max(run(make(-2.0 + 2.0 * best)).sse, 1e-300)
    found = minimize_bfgs(-2.0 + 2.0 * best, lambda u: run(make(u)).sse / scale, gtol=1e-8)
    return run(make(found.x))


@dataclass
class StateSpace:
    """y_t = d + Z a_t + e_t, a_{t+1} = T a_t + R n_t; H and Q are the errors' covariances, a1 and P1 the start. y may have several
    columns; NaN is a missing value."""

    Z: np.ndarray
    H: np.ndarray
    T: np.ndarray
    R: np.ndarray
    Q: np.ndarray
    a1: np.ndarray
    P1: np.ndarray
    d: np.ndarray | float = 0.0

    def filter(self, y: np.ndarray, burn: int = 0) -> dict[str, np.ndarray | float]:
        y = np.asarray(y, float).reshape(len(y), -1)
        n, m = len(y), len(self.a1)
        a, p, rqr = np.array(self.a1, float), np.array(self.P1, float), self.R @ self.Q @ self.R.T
        out = {"a": np.zeros((n, m)), "P": np.zeros((n, m, m)), "filtered": np.zeros((n, m)), "filtered_P": np.zeros((n, m, m)), "v": np.full(y.shape, np.nan), "F": np.zeros((n, y.shape[1], y.shape[1])), "loglike_obs": np.zeros(n)}
        for t in range(n):
            out["a"][t], out["P"][t] = a, p
            ok = np.isfinite(y[t])
            z = np.atleast_2d(self.Z)[ok]
            if ok.any():
                v = y[t, ok] - np.broadcast_to(self.d, y.shape[1])[ok] - z @ a
                f = z @ p @ z.T + np.atleast_2d(self.H)[np.ix_(ok, ok)]
                inv = np.linalg.inv(f)
                gain = p @ z.T @ inv
                a, p = a + gain @ v, p - gain @ z @ p
                out["v"][t, ok], out["F"][t][np.ix_(ok, ok)] = v, f
                out["loglike_obs"][t] = -0.5 * (ok.sum() * math.log(2 * math.pi) + np.linalg.slogdet(f)[1] + v @ inv @ v)
            out["filtered"][t], out["filtered_P"][t] = a, p
            a, p = self.T @ a, self.T @ p @ self.T.T + rqr
            p = (p + p.T) / 2
        out["loglike"] = float(out["loglike_obs"][burn:].sum())
        out["next"], out["next_P"] = a, p
        return out

    def smooth(self, y: np.ndarray) -> np.ndarray:
        """Means of the states given all of y."""
        f = self.filter(y)
        n = len(f["a"])
        out = f["filtered"].copy()
        for t in range(n - 2, -1, -1):
            gain = f["filtered_P"][t] @ self.T.T @ np.linalg.pinv(f["P"][t + 1])
            out[t] = f["filtered"][t] + gain @ (out[t + 1] - f["a"][t + 1])
        return out

    def loglike(self, y: np.ndarray, burn: int = 0) -> float:
        return self.filter(y, burn)["loglike"]

    def forecasts(self, y: np.ndarray) -> np.ndarray:
        """Means of each row given those before it."""
        return self.filter(y)["a"] @ np.atleast_2d(self.Z).T + self.d


def stationary_cov(t: np.ndarray, rqr: np.ndarray) -> np.ndarray:
    m = len(t)
    return np.linalg.solve(np.eye(m * m) - np.kron(t, t), rqr.ravel()).reshape(m, m)


def stationary(u: np.ndarray) -> np.ndarray:
    """Coefficients of a stationary autoregression from any numbers, by way of partial autocorrelations."""
    r = u / np.sqrt(1 + u * u)
    phi = np.zeros(0)
    for k in r:
        phi = np.append(phi - k * phi[::-1], k)
    return phi


def polynomial(short: np.ndarray, long: np.ndarray, s: int, sign: float) -> np.ndarray:
    """Product of 1 + sign short(B) and 1 + sign long(B^s), without its leading one, times sign."""
    a, b = np.concatenate([[1.0], sign * short]), np.zeros(len(long) * s + 1)
    b[0] = 1.0
    if s:
        b[s::s] = sign * long
    return sign * np.convolve(a, b)[1:]


@dataclass
class SarimaxOrder:
    p: int
    d: int
    q: int
    sp: int = 0
    sd: int = 0
    sq: int = 0
    s: int = 0


@dataclass
class SeriesFit:
    params: dict[str, float]
    bse: dict[str, float]
    llf: float
    nobs: int
    converged: bool
    space: StateSpace | None = None
    extra: dict = field(default_factory=dict)

    @property
    def aic(self) -> float:
        return 2 * len(self.params) - 2 * self.llf

    @property
    def bic(self) -> float:
        return math.log(self.nobs) * len(self.params) - 2 * self.llf

    @property
    def hqic(self) -> float:
        return 2 * math.log(math.log(self.nobs)) * len(self.params) - 2 * self.llf

    def figures(self) -> dict[str, float]:
        return self.params | {f"{k}_se": v for k, v in self.bse.items()} | {"llf": self.llf, "aic": self.aic, "bic": self.bic, "converged": float(self.converged)}


def differenced(x: np.ndarray, d: int, sd: int, s: int) -> np.ndarray:
    for _ in range(sd):
        x = x[s:] - x[:-s]
    for _ in range(d):
        x = np.diff(x)
    return x


def sarima_space(order: SarimaxOrder, ar, ma, sar, sma, sigma2: float) -> StateSpace:
    """Harvey's form of a stationary seasonal ARMA."""
    phi, theta = polynomial(np.asarray(ar, float), np.asarray(sar, float), order.s, -1.0), polynomial(np.asarray(ma, float), np.asarray(sma, float), order.s, 1.0)
    m = max(len(phi), len(theta) + 1, 1)
    t = np.zeros((m, m))
    t[: len(phi), 0] = phi
    t[:-1, 1:] = np.eye(m - 1)
    r = np.zeros((m, 1))
    r[: len(theta) + 1, 0] = [1.0, *theta]
    q = np.array([[sigma2]])
    return StateSpace(np.eye(1, m), np.zeros((1, 1)), t, r, q, np.zeros(m), stationary_cov(t, r @ q @ r.T))


def errors_of(hess: np.ndarray) -> np.ndarray:
    """Standard errors from a Hessian; NaN at the edge of what is allowed, where it has none."""
    ok = np.isfinite(hess).all(0)
    out = np.full(len(hess), np.nan)
    with np.errstate(invalid="ignore"):
        out[ok] = np.sqrt(np.diag(np.linalg.pinv(-hess[np.ix_(ok, ok)])))
    return out


def maximum(loglike, start: np.ndarray, names: list[str], back, nobs: int) -> SeriesFit:
    """Maximises loglike over free numbers, which back turns into parameters; standard errors from the numeric Hessian in parameters."""
    bad = lambda f: (lambda u: f(u) if np.isfinite(f(u)) else 1e10)
    best = minimize_bfgs(start, bad(lambda u: -loglike(back(u)) / nobs), gtol=1e-7)
    params = back(best.x)
    se = errors_of(approx_hess(params, loglike))
    return SeriesFit(dict(zip(names, map(float, params))), dict(zip(names, map(float, se))), float(loglike(params)), nobs, best.converged)


def sarimax(x: np.ndarray, order: SarimaxOrder, mean: bool = False) -> SeriesFit:
    """Seasonal ARIMA by exact maximum likelihood of the differenced series; mean: with a constant mean of that."""
    y = differenced(np.asarray(x, float), order.d, order.sd, order.s)
    sizes = [order.p, order.q, order.sp, order.sq]
    ends = np.cumsum([0, *sizes])
    names = [f"ar.L{i + 1}" for i in range(order.p)] + [f"ma.L{i + 1}" for i in range(order.q)] + [f"ar.S.L{(i + 1) * order.s}" for i in range(order.sp)] + [f"ma.S.L{(i + 1) * order.s}" for i in range(order.sq)] + ["sigma2"] + (["mean"] if mean else [])
    var = max(float(np.var(y)), 1e-12)

    def split(p: np.ndarray) -> list[np.ndarray]:
        return [p[a:b] for a, b in zip(ends, ends[1:])]

    def back(u: np.ndarray) -> np.ndarray:
        ar, ma, sar, sma = split(u)
        rest = [math.exp(min(u[ends[-1]], 50.0)) * var] + ([u[-1]] if mean else [])
        return np.concatenate([stationary(ar), -stationary(ma), stationary(sar), -stationary(sma), rest])

    def loglike(p: np.ndarray) -> float:
        if p[ends[-1]] <= 0:
            return -math.inf
        ar, ma, sar, sma = split(p)
        try:
            return sarima_space(order, ar, ma, sar, sma, p[ends[-1]]).loglike(y - (p[-1] if mean else 0.0))
        except np.linalg.LinAlgError:
            return -math.inf

    start = np.concatenate([np.full(ends[-1], 0.1), [0.0], [float(np.mean(y))] if mean else []])
    out = maximum(loglike, start, names, back, len(y))
    p = np.array(list(out.params.values()))
    out.space = sarima_space(order, *split(p), p[ends[-1]])
    return out


def arma_order_select_ic(x: np.ndarray, max_ar: int = 4, max_ma: int = 2, ic: str = "bic") -> tuple[np.ndarray, tuple[int, int]]:
    """Criterion (aic, bic or hqic) of every ARMA(p, q) with mean, and the least one's order."""
    table = np.array([[getattr(sarimax(x, SarimaxOrder(p, 0, q), mean=True), ic) for q in range(max_ma + 1)] for p in range(max_ar + 1)])
    return table, tuple(int(i) for i in np.unravel_index(np.nanargmin(table), table.shape))


def unobserved_space(trend: bool, season: int, variances: np.ndarray) -> StateSpace:
    """Local level, with trend local linear trend, with season dummies that sum to noise. variances: irregular, level, (slope), (season)."""
    k = 1 + trend + max(season - 1, 0)
    z, t, r = np.zeros((1, k)), np.zeros((k, k)), np.zeros((k, 1 + trend + (season > 1)))
    z[0, 0] = t[0, 0] = r[0, 0] = 1.0
    if trend:
        t[0, 1] = t[1, 1] = r[1, 1] = 1.0
    if season > 1:
        o = 1 + trend
        z[0, o] = r[o, -1] = 1.0
        t[o, o:] = -1.0
        t[o + 1 :, o : k - 1] = np.eye(season - 2)
    return StateSpace(z, np.array([[variances[0]]]), t, r, np.diag(variances[1:]), np.zeros(k), np.eye(k) * 1e6)


def unobserved_components(x: np.ndarray, trend: bool = False, season: int = 0) -> SeriesFit:
    """Structural model by maximum likelihood from a vague start, whose first rows don't count."""
    x = np.asarray(x, float)
    names = ["irregular", "level", *(["trend"] if trend else []), *(["seasonal"] if season > 1 else [])]
    burn, scale = 1 + trend + max(season - 1, 0), max(float(np.var(np.diff(x))), 1e-12)
    loglike = lambda p: unobserved_space(trend, season, p).loglike(x, burn) if np.all(p >= 0) else -math.inf
    out = maximum(loglike, np.full(len(names), 0.5), names, lambda u: u * u * scale, len(x))
    out.space = unobserved_space(trend, season, np.array(list(out.params.values())))
    return out


def factor_space(k: int, order: int, p: np.ndarray) -> StateSpace:
    load, noise, ar = p[:k], p[k : 2 * k], p[2 * k :]
    t = np.zeros((order, order))
    t[0] = ar
    t[1:, :-1] = np.eye(order - 1)
    r = np.eye(order, 1)
    z = np.zeros((k, order))
    z[:, 0] = load
    return StateSpace(z, np.diag(noise), t, r, np.ones((1, 1)), np.zeros(order), stationary_cov(t, r @ r.T))


def dynamic_factor(y: np.ndarray, order: int = 1) -> SeriesFit:
    """One common autoregressive factor of several series (columns), of unit error variance, with noise of each its own."""
    y = np.asarray(y, float)
    k = y.shape[1]
    c = np.cov(y.T)
    values, vectors = np.linalg.eigh(c)
    load = vectors[:, -1] * math.sqrt(values[-1] / 2)
    load *= np.sign(load.sum()) or 1.0
    start = np.concatenate([load, 0.5 * np.log(np.maximum(np.diag(c) / 2, 1e-8)), np.full(order, 0.3)])
    back = lambda u: np.concatenate([u[:k], np.exp(2 * np.clip(u[k : 2 * k], -20, 20)), stationary(u[2 * k :])])

    def loglike(p: np.ndarray) -> float:
        try:
            return factor_space(k, order, p).loglike(y) if np.all(p[k : 2 * k] > 0) else -math.inf
        except np.linalg.LinAlgError:
            return -math.inf

    names = [f"loading.{i + 1}" for i in range(k)] + [f"sigma2.{i + 1}" for i in range(k)] + [f"factor.L{i + 1}" for i in range(order)]
    out = maximum(loglike, start, names, back, len(y))
    out.space = factor_space(k, order, np.array(list(out.params.values())))
    return out


def hamilton(like: np.ndarray, p: np.ndarray, start: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Log-likelihood, filtered and smoothed regime probabilities from the rows' likelihoods by regime and the transition
    matrix p[i, j] = P(i | j)."""
    n, k = like.shape
    filtered, predicted, total, now = np.zeros((n, k)), np.zeros((n, k)), 0.0, start
    for t in range(n):
        predicted[t] = now
        joint = now * like[t]
        s = joint.sum()
        if not s > 0:
            return -math.inf, filtered, filtered
        total += math.log(s)
        filtered[t] = joint / s
        now = p @ filtered[t]
    smoothed = filtered.copy()
    for t in range(n - 2, -1, -1):
        smoothed[t] = filtered[t] * (p.T @ (smoothed[t + 1] / np.maximum(predicted[t + 1], 1e-300)))
    return total, filtered, smoothed


def steady(p: np.ndarray) -> np.ndarray:
    k = len(p)
    a = np.vstack([np.eye(k) - p, np.ones(k)])
    return np.clip(np.linalg.lstsq(a, np.append(np.zeros(k), 1.0), rcond=None)[0], 0, 1)


def markov_regression(y: np.ndarray, k: int = 2, exog: np.ndarray | None = None, switching_variance: bool = False, order: int = 0, switching_ar: bool = False) -> SeriesFit:
    """Regimes with their own mean (and coefficients of exog, and variance): maximum likelihood by Hamilton's filter. With order,
    an autoregression of the deviations from the regimes' means, over all paths of order + 1 regimes. The best of several
    starts; regimes are in order of their means."""
    y = np.asarray(y, float)
    x = np.column_stack([np.ones(len(y)), *([exog] if exog is not None else [])])
    m, nv = x.shape[1], k if switching_variance else 1
    na = order * (k if switching_ar else 1)
    sizes = [k * (k - 1), k * m, nv, na]
    ends = np.cumsum([0, *sizes])
    paths = np.array(list(np.ndindex(*[k] * (order + 1))))

    def unpack(p):
        a, b, v, ar = (p[i:j] for i, j in zip(ends, ends[1:]))
        t = a.reshape(k - 1, k)
        return np.vstack([t, 1 - t.sum(0)]), b.reshape(k, m), np.broadcast_to(v, k) if nv == 1 else v, (ar.reshape(k, order) if switching_ar else np.broadcast_to(ar, (k, order)))

    def likelihood(p):
        t, b, v, ar = unpack(p)
        if np.any(t < 0) or np.any(v <= 0):
            return None
        e = y[:, None] - x @ b.T
        if not order:
            return np.exp(-0.5 * e * e / v) / np.sqrt(2 * math.pi * v), t, steady(t)
        now = paths[:, 0]
        r = np.column_stack([e[order:, s] for s in now])
        for i in range(1, order + 1):
            r = r - np.column_stack([ar[s0, i - 1] * e[order - i : len(y) - i, s] for s0, s in zip(now, paths[:, i])])
        like = np.exp(-0.5 * r * r / v[now]) / np.sqrt(2 * math.pi * v[now])
        big = np.zeros((len(paths), len(paths)))
        for j, old in enumerate(paths):
            for i, new in enumerate(paths):
                if np.array_equal(new[1:], old[:-1]):
                    big[i, j] = t[new[0], old[0]]
        first = steady(t)
        start = np.array([first[q[-1]] * np.prod([t[q[i], q[i + 1]] for i in range(order)]) for q in paths])
        return like, big, start

    def loglike(p):
        got = likelihood(p)
        return -math.inf if got is None else hamilton(*got)[0]

    def back(u):
        a = np.exp(np.clip(u[: ends[1]].reshape(k - 1, k), -15, 15))
        return np.concatenate([(a / (1 + a.sum(0))).ravel(), u[ends[1] : ends[2]], np.exp(np.clip(u[ends[2] : ends[3]], -25, 25)), u[ends[3] :]])

    best = None
    for spread in (1.0, 0.5, 1.5):
        mean = np.quantile(y, np.linspace(0, 1, 2 * k + 1)[1::2])
        b = np.zeros((k, m))
        b[:, 0] = y.mean() + (mean - y.mean()) * spread
        stay = np.zeros((k - 1, k))
        for j in range(k):
            stay[:, j] = -2.0
            if j < k - 1:
                stay[j, j] = 2.0
        u = np.concatenate([stay.ravel(), b.ravel(), np.full(nv, math.log(max(y.var() / 2, 1e-8))), np.full(na, 0.1)])
        found = minimize_bfgs(u, lambda z: -loglike(back(z)) / len(y) if math.isfinite(loglike(back(z))) else 1e10, gtol=1e-6)
        if best is None or found.fval < best.fval:
            best = found
    p = back(best.x)
    t, b, v, ar = unpack(p)
    o = np.argsort(b[:, 0], kind="stable")
    t, b, v, ar = t[np.ix_(o, o)], b[o], np.array(v)[o], np.array(ar)[o]
    p = np.concatenate([t[:-1].ravel(), b.ravel(), v if nv > 1 else v[:1], ar.ravel() if switching_ar else ar[0] if na else []])
    names = [f"p[{j}->{i}]" for i in range(k - 1) for j in range(k)] + [f"{'const' if c == 0 else f'x{c}'}[{r}]" for r in range(k) for c in range(m)] + [f"sigma2[{r}]" if nv > 1 else "sigma2" for r in range(nv)] + [f"ar.L{i + 1}" + (f"[{r}]" if switching_ar else "") for r in range(k if switching_ar else min(1, na)) for i in range(order)]
    se = errors_of(approx_hess(p, loglike))
    llf, filtered, smoothed = hamilton(*likelihood(p))
    if order:
        fold = lambda q: np.column_stack([q[:, paths[:, 0] == r].sum(1) for r in range(k)])
        filtered, smoothed = fold(filtered), fold(smoothed)
    return SeriesFit(dict(zip(names, map(float, p))), dict(zip(names, map(float, se))), llf, len(y) - order, best.converged, None, {"filtered": filtered, "smoothed": smoothed})


_TAU = {  # greatest and least statistic, where the two polynomials meet, and these
    "n": (math.inf, -19.04, -1.04, (0.6344, 1.2378, 0.032496), (0.4797, 0.93557, -0.06999, 0.033066)),
    "c": (2.74, -18.83, -1.61, (2.1659, 1.4412, 0.038269), (1.7339, 0.93202, -0.12745, -0.010368)),
    "ct": (0.7, -16.18, -2.89, (3.2512, 1.6047, 0.049588), (2.5261, 0.61654, -0.37956, -0.060285)),
    "ctt": (0.54, -17.17, -3.21, (4.0003, 1.658, 0.048288), (3.0778, 0.49529, -0.41477, -0.059359)),
}
_CUTS = {  # by level 1, 5 and 10 percent, in powers of 1 / n
    "n": ((-2.56574, -2.2358, -3.627, 0.0), (-1.941, -0.2686, -3.365, 31.223), (-1.61682, 0.2656, -2.714, 25.364)),
    "c": ((-3.43035, -6.5393, -16.786, -79.433), (-2.86154, -2.8903, -4.234, -40.04), (-2.56677, -1.5384, -2.809, 0.0)),
    "ct": ((-3.95877, -9.0531, -28.428, -134.155), (-3.41049, -4.3904, -9.036, -45.374), (-3.12705, -2.5856, -3.925, -22.38)),
    "ctt": ((-4.37113, -11.5882, -35.819, -334.047), (-3.83239, -5.9057, -12.49, -118.284), (-3.55326, -3.6596, -5.293, -63.559)),
}


def mackinnon_p(stat: float, regression: str) -> float:
    """Approximate p-value of a unit-root statistic (one series)."""
    top, low, middle, small, large = _TAU[regression]
    if stat > top or stat < low:
        return float(stat > top)
    return dist.norm_cdf(float(np.polynomial.polynomial.polyval(stat, small if stat <= middle else large)))


def mackinnon_cuts(regression: str, n: int) -> list[float]:
    return [float(np.polynomial.polynomial.polyval(1 / n, c)) for c in _CUTS[regression]]


def range_unit_root(x: np.ndarray) -> float:
    """New running extremes, in proportion to the square root of the length."""
    x = np.asarray(x, float)
    high, low = np.maximum.accumulate(x), np.minimum.accumulate(x)
    return float((np.diff(high - low) > 0).sum() / math.sqrt(len(x)))


def breakvar(resid: np.ndarray, share: float = 1 / 3, alternative: str = "two-sided") -> tuple[float, float]:
    """Ratio of the last to the first squared residuals, with p-value by the F distribution."""
    h = max(1, round(share * len(resid)))
    f = float((np.asarray(resid[-h:]) ** 2).sum() / (np.asarray(resid[:h]) ** 2).sum())
    up, down = dist.f_sf(f, h, h), dist.f_cdf(f, h, h)
    return f, {"two-sided": 2 * min(up, down), "increasing": up, "decreasing": down}[alternative]


def deterministic(steps: int, constant: bool = True, order: int = 0, period: int = 0) -> tuple[list[str], np.ndarray]:
    """Constant, powers of the time from 1, and seasonal dummies (all but one beside a constant)."""
    t = np.arange(1, steps + 1, dtype=float)
    names, cols = (["const"], [np.ones(steps)]) if constant else ([], [])
    for k in range(1, order + 1):
        names.append({1: "trend", 2: "trend_squared", 3: "trend_cubed"}.get(k, f"trend**{k}"))
        cols.append(t**k)
    for j in range(1 if constant else 0, period):
        names.append(f"s({j + 1},{period})")
        cols.append(((t - 1) % period == j).astype(float))
    return names, np.column_stack(cols) if cols else np.zeros((steps, 0))
