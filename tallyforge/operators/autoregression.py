"""Autoregressions, unit-root tests, causality and vector models: lag columns and one Gram matrix, whatever the series' length."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.functions import distributions as dist
from tallyforge.operators import regression, tsmodels
from tallyforge.operators.likelihood import matrix, totals
from tallyforge.operators.series import numbered, with_lags


def trend_columns(df: DataFrame, order_by: str, trend: str) -> tuple[DataFrame, list[str]]:
    """df with the columns of a trend (n, c, t, ct, ctt), and their names."""
    if trend not in ("n", "c", "t", "ct", "ctt"):
        raise ValueError(f"trend {trend} isn't known")
    names = [n for n, there in (("const", "c" in trend), ("trend", "t" in trend), ("trend2", trend == "ctt")) if there]
    df = numbered(df, order_by) if "t" in trend else df
    t = (F.col("pos_") + 1).cast("double")
    made = {"const": F.lit(1.0), "trend": t, "trend2": t * t}
    out = df.select("*", *(made[n].alias(n) for n in names))
    return (out.drop("pos_") if "t" in trend else out), names


def products(df: DataFrame, names: list[str]) -> tuple[np.ndarray, int]:
    """Matrix of the sums of products of columns over rows without a null, and the number of such rows."""
    k = len(names)

    def step(batch: pa.RecordBatch) -> np.ndarray:
        z = matrix(batch, names)
        return np.append((z.T @ z).ravel(), len(z))

    got = totals(df.select(*(F.col(n).cast("double").alias(n) for n in names)).na.drop("any"), step, k * k + 1)
    return got[:-1].reshape(k, k), int(got[-1])


@dataclass
class Least:
    """A regression from a Gram matrix: coefficients, inverse Gram, sum of squared residuals, rows."""

    params: np.ndarray
    inv: np.ndarray
    ssr: float
    n: int

    @property
    def scale(self) -> float:
        return self.ssr / (self.n - len(self.params)) if self.n > len(self.params) else math.nan

    @property
    def tvalues(self) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            return self.params / np.sqrt(np.diag(self.inv) * self.scale)

    @property
    def llf(self) -> float:
        return -self.n / 2 * (math.log(2 * math.pi * self.ssr / self.n) + 1) if self.ssr > 0 else math.inf

    def ic(self, name: str) -> float:
        k = len(self.params)
        return {"aic": 2 * k, "bic": math.log(self.n) * k, "hqic": 2 * math.log(math.log(self.n)) * k}[name] - 2 * self.llf


def solve(gram: np.ndarray, y: int, x: list[int], n: int) -> Least:
    inv = regression.inverse(gram[np.ix_(x, x)])
    b = inv @ gram[x, y]
    return Least(b, inv, max(float(gram[y, y] - 2 * b @ gram[x, y] + b @ gram[np.ix_(x, x)] @ b), 0.0), n)


def centred(df: DataFrame, value: str, order_by: str) -> tuple[DataFrame, float]:
    """(order_by, v): the series less its mean, and the mean."""
    x = df.where(F.col(value).isNotNull()).select(order_by, F.col(value).cast("double").alias("v"))
    mean = x.agg(F.avg("v")).first()[0]
    if mean is None:
        raise ValueError("the series is empty")
    return x.withColumn("v", F.col("v") - F.lit(mean)), mean


def autoreg(df: DataFrame, value: str, order_by: str, lags: int, trend: str = "c") -> DataFrame:
    """Conditional least squares on lags and trend: (term, coef, std_err, stat, pvalue); variances divide by the rows used. The last
    rows of the table are sigma2, llf, aic, bic and hqic."""
    x = df.where(F.col(value).isNotNull()).select(order_by, F.col(value).cast("double").alias("v"))
    x, names = trend_columns(x, order_by, trend)
    x = with_lags(x, ["v"], order_by, lags)
    columns = [*names, *(f"v_l{k}" for k in range(1, lags + 1))]
    gram, n = products(x, [*columns, "v"])
    k = len(columns)
    if n <= k:
        raise ValueError("the series is too short")
    fit = solve(gram, k, list(range(k)), n)
    sigma2 = fit.ssr / n
    rows = []
    for name, b, v in zip(columns, fit.params, np.diag(fit.inv)):
        se = math.sqrt(max(v * sigma2, 0.0))
        z = b / se if se else math.nan
        rows.append((name.replace("v_l", f"{value}.L"), float(b), se, float(z), 2 * dist.norm_sf(abs(z)) if se else math.nan))
    llf = fit.llf
    ics = {"sigma2": sigma2, "llf": llf, "aic": -2 * llf + 2 * (k + 1), "bic": -2 * llf + math.log(n) * (k + 1), "hqic": -2 * llf + 2 * math.log(math.log(n)) * (k + 1)}
    rows += [(a, float(b), None, None, None) for a, b in ics.items()]
    return df.sparkSession.createDataFrame(rows, "term string, coef double, std_err double, stat double, pvalue double")


def ar_select_order(df: DataFrame, value: str, order_by: str, maxlag: int, ic: str = "bic", trend: str = "c") -> tuple[int, dict[int, float]]:
    """Order with the least criterion, and the criterion by order, all on the rows that the longest has: one Gram matrix serves all."""
    x = df.where(F.col(value).isNotNull()).select(order_by, F.col(value).cast("double").alias("v"))
    x, names = trend_columns(x, order_by, trend)
    columns = [*names, *(f"v_l{k}" for k in range(1, maxlag + 1))]
    gram, n = products(with_lags(x, ["v"], order_by, maxlag), [*columns, "v"])
    path = {}
    for p in range(maxlag + 1):
        f = solve(gram, len(columns), list(range(len(names) + p)), n)
        k = len(names) + p + 1
        path[p] = -2 * f.llf + {"aic": 2, "bic": math.log(n), "hqic": 2 * math.log(math.log(n))}[ic] * k
    return min(path, key=path.get), path


def adfuller(df: DataFrame, value: str, order_by: str, maxlag: int | None = None, trend: str = "c", autolag: str | None = "aic") -> DataFrame:
    """Augmented Dickey-Fuller test: (statistic, pvalue, lags, nobs, crit_1, crit_5, crit_10). Lags by aic, bic, t-stat (the last
    significant at 10 percent) or, with None, maxlag itself."""
    x, _ = centred(df, value, order_by)
    n = x.count()
    ntrend = {"n": 0, "c": 1, "ct": 2, "ctt": 3}[trend]
    if maxlag is None:
        maxlag = max(0, min(math.ceil(12 * (n / 100) ** 0.25), n // 2 - ntrend - 1))
    d = with_lags(x, ["v"], order_by, 1).withColumn("d", F.col("v") - F.col("v_l1")).where("d is not null")
    d, names = trend_columns(d, order_by, trend)

    def fit(lags: int, used: int) -> tuple[np.ndarray, int, list[str]]:
        columns = [*names, "v_l1", *(f"d_l{k}" for k in range(1, lags + 1))]
        frame = with_lags(d, ["d"], order_by, lags)
        g, m = products(frame.where(F.col(f"d_l{used}").isNotNull()) if used else frame, [*columns, "d"])
        return g, m, columns

    # Centring has changed no regression with a constant; without one the series itself must be taken.
    if trend == "n":
        raw = df.where(F.col(value).isNotNull()).select(order_by, F.col(value).cast("double").alias("v"))
        d = with_lags(raw, ["v"], order_by, 1).withColumn("d", F.col("v") - F.col("v_l1")).where("d is not null")
    best = maxlag
    if autolag:
        g, m, columns = fit(maxlag, maxlag)
        fits = {p: solve(g, len(columns), list(range(len(names) + 1 + p)), m) for p in range(maxlag + 1)}
        if autolag == "t-stat":
            best = next((p for p in range(maxlag, 0, -1) if abs(fits[p].tvalues[-1]) >= 1.6448536269514722), 0)
        else:
            best = min(fits, key=lambda p: fits[p].ic(autolag))
    g, m, columns = fit(best, best)
    f = solve(g, len(columns), list(range(len(columns))), m)
    stat = float(f.tvalues[len(names)])
    cuts = tsmodels.mackinnon_cuts(trend, m)
    return df.sparkSession.createDataFrame([(stat, tsmodels.mackinnon_p(stat, trend), best, m, *cuts)], "statistic double, pvalue double, lags int, nobs int, crit_1 double, crit_5 double, crit_10 double")


def coint(df: DataFrame, a: str, b: str, order_by: str, trend: str = "c", maxlag: int | None = None, autolag: str | None = "aic") -> DataFrame:
    """Engle and Granger's test: a unit-root statistic (without constant) of the residuals of a on b and the trend. Its p-value isn't
    given: for two series the tables of one don't hold; crit_* are left out likewise."""
    x = df.select(order_by, F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b")).na.drop("any")
    x, names = trend_columns(x, order_by, trend)
    columns = [*names, "b"]
    g, n = products(x, [*columns, "a"])
    f = solve(g, len(columns), list(range(len(columns))), n)
    e = F.col("a") - sum((F.lit(float(p)) * F.col(c) for p, c in zip(f.params, columns)), F.lit(0.0))
    return adfuller(x.select(order_by, e.alias("e")), "e", order_by, maxlag, "n", autolag).select("statistic", "lags", "nobs")


def granger(df: DataFrame, effect: str, cause: str, order_by: str, maxlag: int) -> DataFrame:
    """Whether lags of cause help to predict effect, by lag: F, chi-square and likelihood-ratio tests with p-values."""
    x = df.select(order_by, F.col(effect).cast("double").alias("y"), F.col(cause).cast("double").alias("x"), F.lit(1.0).alias("const")).na.drop("any")
    lagged = with_lags(x, ["y", "x"], order_by, maxlag)
    rows = []
    for p in range(1, maxlag + 1):
        own = ["const", *(f"y_l{k}" for k in range(1, p + 1))]
        columns = [*own, *(f"x_l{k}" for k in range(1, p + 1)), "y"]
        g, n = products(lagged, columns)
        k = len(columns) - 1
        small, full = solve(g, k, list(range(len(own))), n), solve(g, k, list(range(k)), n)
        dof = n - k
        f = (small.ssr - full.ssr) / p / (full.ssr / dof) if full.ssr and dof > 0 else math.nan
        chi = n * (small.ssr - full.ssr) / full.ssr if full.ssr else math.nan
        lr = 2 * (full.llf - small.llf)
        rows.append((p, f, dist.f_sf(f, p, dof), chi, dist.chi2_sf(chi, p), lr, dist.chi2_sf(lr, p), dof))
    return df.sparkSession.createDataFrame(rows, "lag int, f double, f_pvalue double, chi2 double, chi2_pvalue double, lr double, lr_pvalue double, df_denom int")


def zivot_andrews(df: DataFrame, value: str, order_by: str, trim: float = 0.15, lags: int = 0, trend: str = "c") -> tuple[float, int]:
    """Least unit-root statistic over all break dates of the level ("c"), the slope ("t") or both ("ct"), and the place of the break,
    with a fixed number of lags. Sums up to each date give the break's products: the data are read twice, whatever the number
    of dates. Statistics of all dates are computed on the driver, from sums of each row."""
    x, _ = centred(df, value, order_by)
    d = with_lags(x, ["v"], order_by, 1).withColumn("d", F.col("v") - F.col("v_l1"))
    d = numbered(with_lags(d, ["d"], order_by, lags), order_by)
    names = ["const", "pos_", "v_l1", *(f"d_l{k}" for k in range(1, lags + 1)), "d"]
    rows = d.withColumn("const", F.lit(1.0)).na.drop("any").orderBy("pos_").select(*names).toPandas().to_numpy(float)  # one series, as all break-date scans need
    z, n = rows[:, :-1], len(rows)
    best = (math.inf, -1)
    for b in range(max(1, int(trim * n)), int((1 - trim) * n)):
        extra = [(np.arange(n) > b).astype(float)] if "c" in trend else []
        extra += [np.maximum(np.arange(n) - b, 0).astype(float)] if "t" in trend else []
        full = np.column_stack([z, *extra])
        coef, _, rank, _ = np.linalg.lstsq(full, rows[:, -1], rcond=None)
        e = rows[:, -1] - full @ coef
        se = math.sqrt(max(e @ e / (n - full.shape[1]) * np.linalg.pinv(full.T @ full)[2, 2], 1e-300))
        if coef[2] / se < best[0]:
            best = (coef[2] / se, b)
    return best


@dataclass
class VarFit:
    names: list[str]
    terms: list[str]
    params: np.ndarray  # term by equation
    bse: np.ndarray
    sigma_u: np.ndarray
    sigma_ml: np.ndarray
    llf: float
    nobs: int
    lags: int

    @property
    def _free(self) -> int:
        return self.params.size

    @property
    def aic(self) -> float:
        return float(np.linalg.slogdet(self.sigma_ml)[1] + 2 * self._free / self.nobs)

    @property
    def bic(self) -> float:
        return float(np.linalg.slogdet(self.sigma_ml)[1] + math.log(self.nobs) * self._free / self.nobs)

    @property
    def hqic(self) -> float:
        return float(np.linalg.slogdet(self.sigma_ml)[1] + 2 * math.log(math.log(self.nobs)) * self._free / self.nobs)

    @property
    def fpe(self) -> float:
        m = len(self.terms)
        return float(((self.nobs + m) / (self.nobs - m)) ** len(self.names) * np.linalg.det(self.sigma_ml))

    @property
    def pvalues(self) -> np.ndarray:
        return 2 * np.asarray(dist.norm_sf(np.abs(self.params / self.bse)))

    def impact(self) -> np.ndarray:
        """Structural impact matrix: the lower Cholesky factor of the errors' covariance."""
        return np.linalg.cholesky(self.sigma_ml)

    def impulse_responses(self, steps: int, orthogonal: bool = False) -> np.ndarray:
        """Responses (step, of, to) of the variables to a unit error, or to an orthogonal one of its size."""
        k = len(self.names)
        a = [self.params[-k * self.lags :][i * k : (i + 1) * k].T for i in range(self.lags)]
        out = [np.eye(k)]
        for h in range(1, steps + 1):
            out.append(sum(out[h - i - 1] @ a[i] for i in range(min(h, self.lags))))
        return np.array([m @ self.impact() if orthogonal else m for m in out])

    def forecast(self, last: np.ndarray, steps: int) -> np.ndarray:
        """Forecasts after the rows last (oldest first; at least lags of them)."""
        rows = [np.asarray(r, float) for r in last]
        for _ in range(steps):
            z = [1.0] if "const" in self.terms else []
            for i in range(1, self.lags + 1):
                z = [*z, *rows[-i]]
            rows.append(np.array(z) @ self.params)
        return np.array(rows[len(last) :])


def var(df: DataFrame, columns: list[str], order_by: str, lags: int, trend: str = "c") -> VarFit:
    """Vector autoregression, each equation by least squares, all from one Gram matrix."""
    if trend not in ("n", "c"):
        raise ValueError("the trend is n or c")
    y = [f"y{i}" for i in range(len(columns))]
    x = df.select(order_by, *(F.col(c).cast("double").alias(n) for c, n in zip(columns, y)), F.lit(1.0).alias("const")).na.drop("any")
    z = (["const"] if trend == "c" else []) + [f"{n}_l{k}" for k in range(1, lags + 1) for n in y]
    g, n = products(with_lags(x, y, order_by, lags), [*z, *y])
    m, k = len(z), len(y)
    if n <= m:
        raise ValueError("the series are too short")
    inv = regression.inverse(g[:m, :m])
    b = inv @ g[:m, m:]
    sse = g[m:, m:] - b.T @ g[:m, m:]
    sigma_u, ml = sse / (n - m), sse / n
    bse = np.sqrt(np.outer(np.diag(inv), np.diag(sigma_u)))
    llf = -n / 2 * (k * (math.log(2 * math.pi) + 1) + np.linalg.slogdet(ml)[1])
    terms = ["const"] * (trend == "c") + [f"L{j}.{c}" for j in range(1, lags + 1) for c in columns]
    return VarFit(columns, terms, b, bse, sigma_u, ml, float(llf), n, lags)


@dataclass
class Johansen:
    eig: np.ndarray
    trace: np.ndarray
    max_eig: np.ndarray
    vectors: np.ndarray
    nobs: int


def moments_of_differences(df: DataFrame, columns: list[str], order_by: str, k_ar_diff: int, det: str):
    """Residual products of differences and lagged levels after the lagged differences and det ("n" or "c", or "ci": a constant among the levels)."""
    y = [f"y{i}" for i in range(len(columns))]
    x = df.select(order_by, *(F.col(c).cast("double").alias(n) for c, n in zip(columns, y)), F.lit(1.0).alias("const")).na.drop("any")
    x = with_lags(x, y, order_by, 1)
    x = x.select(order_by, "const", *(f"{n}_l1" for n in y), *((F.col(n) - F.col(f"{n}_l1")).alias(f"d{n}") for n in y))
    d = [f"d{n}" for n in y]
    x = with_lags(x, d, order_by, k_ar_diff)
    z = (["const"] if det == "c" else []) + [f"{n}_l{k}" for k in range(1, k_ar_diff + 1) for n in d]
    level = [f"{n}_l1" for n in y] + (["const"] if det == "ci" else [])
    g, n = products(x, [*z, *d, *level])
    m, k = len(z), len(d)
    b = regression.inverse(g[:m, :m]) @ g[:m, m:] if m else np.zeros((0, g.shape[0] - m))
    s = (g[m:, m:] - b.T @ g[:m, m:]) / n
    return s[:k, :k], s[:k, k:], s[k:, k:], n, g, m


def coint_johansen(df: DataFrame, columns: list[str], order_by: str, det: str = "c", k_ar_diff: int = 1) -> Johansen:
    """Eigenvalues of the reduced-rank problem with trace and largest-eigenvalue statistics for every rank."""
    s00, s01, s11, n, _, _ = moments_of_differences(df, columns, order_by, k_ar_diff, det)
    low = np.linalg.inv(np.linalg.cholesky(s11))
    values, vectors = np.linalg.eigh(low @ s01.T @ np.linalg.solve(s00, s01) @ low.T)
    order = np.argsort(-values)
    eig = np.clip(values[order], 0, 1 - 1e-15)[: len(columns)]
    logs = np.log1p(-eig)
    return Johansen(eig, -n * np.cumsum(logs[::-1])[::-1], -n * logs, (low.T @ vectors)[:, order], n)


def vecm(df: DataFrame, columns: list[str], order_by: str, k_ar_diff: int = 1, rank: int = 1, det: str = "n") -> dict[str, np.ndarray | float]:
    """Error-correction model of a given rank: alpha, beta (identity on top), gamma, sigma_u and llf."""
    s00, s01, s11, n, g, m = moments_of_differences(df, columns, order_by, k_ar_diff, det)
    j = coint_johansen(df, columns, order_by, det, k_ar_diff)
    beta = j.vectors[:, :rank]
    beta = beta @ np.linalg.inv(beta[:rank])
    alpha = s01 @ beta @ np.linalg.inv(beta.T @ s11 @ beta)
    k = len(columns)
    gamma = (regression.inverse(g[:m, :m]) @ (g[:m, m : m + k] - g[:m, m + k :] @ beta @ alpha.T)).T if m else np.zeros((k, 0))
    sigma = s00 - alpha @ (beta.T @ s11 @ beta) @ alpha.T
    llf = -n / 2 * (k * (math.log(2 * math.pi) + 1) + np.linalg.slogdet(s00)[1] + np.log1p(-j.eig[:rank]).sum())
    return {"alpha": alpha, "beta": beta, "gamma": gamma, "sigma_u": sigma, "llf": float(llf)}
