"""Density estimates, histograms, box statistics, principal components and copulas."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.operators.hypothesis import ROWS, grouped_quantiles


def kde(df: DataFrame, value: str, grid: list[float], bandwidth: float) -> DataFrame:
    """Gaussian kernel density at each grid point: one aggregate with a sum per point, so that the data is read once and not crossed."""
    x = F.col(value).cast("double")
    cells = [F.sum(F.exp(-0.5 * F.pow((F.lit(float(g)) - x) / bandwidth, 2))).alias(f"g{i}") for i, g in enumerate(grid)]
    row = df.agg(F.count(value), *cells).first()
    return df.sparkSession.createDataFrame([(float(g), s / (row[0] * bandwidth * math.sqrt(2 * math.pi))) for g, s in zip(grid, row[1:])], "x double, density double")


def histogram(df: DataFrame, value: str, low: float, width: float, bins: int) -> DataFrame:
    """Rows per bin of equal width; the last one has its upper end, too."""
    x = F.col(value)
    i = F.least(F.floor((x - low) / width), F.lit(bins - 1))
    return df.where((x >= low) & (x <= low + bins * width)).groupBy(i.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def box(df: DataFrame, value: str, group: str, rows: int = ROWS) -> DataFrame:
    """Quartiles, whiskers within 1.5 interquartile ranges and the number of outliers, by group."""
    q = grouped_quantiles(df, value, group, {"q1": 0.25, "med": 0.5, "q3": 0.75}, rows)
    x = df.where(F.col(group).isNotNull()).join(q, group, "left")
    span = F.col("q3") - F.col("q1")
    inside = (F.col(value) >= F.col("q1") - 1.5 * span) & (F.col(value) <= F.col("q3") + 1.5 * span)
    return x.groupBy(group, "q1", "med", "q3").agg(F.min(F.when(inside, F.col(value))).alias("whisker_low"), F.max(F.when(inside, F.col(value))).alias("whisker_high"), F.count_if(~inside).alias("outliers"))


def pca(df: DataFrame, columns: list[str]) -> DataFrame:
    """Eigenvalues and shares of the correlation matrix, largest first, from one aggregate."""
    pairs = [(i, j) for i in range(len(columns)) for j in range(i)]
    row = df.select(*columns).na.drop().agg(*(F.corr(columns[i], columns[j]) for i, j in pairs)).first()
    c = np.eye(len(columns))
    for (i, j), r in zip(pairs, row):
        c[i, j] = c[j, i] = r
    values = np.sort(np.linalg.eigvalsh(c))[::-1]
    return df.sparkSession.createDataFrame([(i + 1, float(v), float(v / values.sum())) for i, v in enumerate(values)], "component int, eigenvalue double, share double")


def clayton_pdf(u: Column, v: Column, theta: float) -> Column:
    return (theta + 1) * F.pow(u * v, -(theta + 1)) * F.pow(F.pow(u, -theta) + F.pow(v, -theta) - 1, -(2 * theta + 1) / theta)


def frank_cdf(u: Column, v: Column, theta: float) -> Column:
    return -F.log1p(F.expm1(-theta * u) * F.expm1(-theta * v) / math.expm1(-theta)) / theta


def gumbel_cdf(u: Column, v: Column, theta: float) -> Column:
    return F.exp(-F.pow(F.pow(-F.log(u), theta) + F.pow(-F.log(v), theta), 1 / theta))


def select_sigma(df: DataFrame, value: str) -> float:
    """The smaller of standard deviation and interquartile range by 1.349."""
    s, q = df.agg(F.stddev_samp(value), F.percentile(value, F.array(F.lit(0.25), F.lit(0.75)))).first()
    iqr = (q[1] - q[0]) / 1.3489795003921634 if q else 0.0
    return min(s, iqr) if iqr > 0 else s


def bandwidth(df: DataFrame, value: str, rule: str = "normal_reference") -> float:
    """silverman (0.9), scott (1.059) or normal_reference (1.0592 for a Gaussian kernel) times sigma n^(-1/5)."""
    n = df.where(F.col(value).isNotNull()).count()
    c = {"silverman": 0.9, "scott": 1.059, "normal_reference": 1.0592238410488122}[rule]
    return c * select_sigma(df, value) * n ** (-0.2)


#: Kernels of a distance in bandwidths, as columns.
KERNELS = {
    "gaussian": lambda u: F.exp(-0.5 * u * u) / math.sqrt(2 * math.pi),
    "epanechnikov": lambda u: F.when(F.abs(u) <= 1, 0.75 * (1 - u * u)).otherwise(0.0),
    "uniform": lambda u: F.when(F.abs(u) <= 1, 0.5).otherwise(0.0),
    "triangular": lambda u: F.when(F.abs(u) <= 1, 1 - F.abs(u)).otherwise(0.0),
    "biweight": lambda u: F.when(F.abs(u) <= 1, 15 / 16 * F.pow(1 - u * u, 2)).otherwise(0.0),
    "triweight": lambda u: F.when(F.abs(u) <= 1, 35 / 32 * F.pow(1 - u * u, 3)).otherwise(0.0),
    "cosine": lambda u: F.when(F.abs(u) <= 1, math.pi / 4 * F.cos(math.pi / 2 * u)).otherwise(0.0),
}


def kde_kernel(df: DataFrame, columns: list[str], grid: list[list[float]], bandwidths: list[float], kernel: str = "gaussian") -> DataFrame:
    """Product-kernel density of one or more columns at each grid point: one aggregate with a sum per point."""
    cells = []
    for p in grid:
        k = F.lit(1.0)
        for c, g, h in zip(columns, p, bandwidths):
            k = k * KERNELS[kernel]((F.lit(float(g)) - F.col(c).cast("double")) / F.lit(float(h))) / F.lit(float(h))
        cells.append(F.avg(k))
    row = df.select(*columns).na.drop().agg(*(c.alias(f"g{i}") for i, c in enumerate(cells))).first()
    names = ", ".join(f"x{i} double" for i in range(len(columns)))
    return df.sparkSession.createDataFrame([(*map(float, p), v) for p, v in zip(grid, row)], f"{names}, density double")


def kernel_regression(df: DataFrame, response: str, columns: list[str], grid: list[list[float]], bandwidths: list[float], local_linear: bool = True) -> DataFrame:
    """Local constant or local linear mean of the response at each grid point with Gaussian kernels: one aggregate for all points."""
    k, cells = len(columns), []
    y = F.col(response).cast("double")
    for p in grid:
        d = [F.col(c).cast("double") - F.lit(float(g)) for c, g in zip(columns, p)]
        w = F.lit(1.0)
        for x, h in zip(d, bandwidths):
            w = w * F.exp(-0.5 * F.pow(x / F.lit(float(h)), 2))
        z = [F.lit(1.0), *(d if local_linear else [])]
        cells += [F.sum(w * a * b) for i, a in enumerate(z) for b in z[i:]] + [F.sum(w * a * y) for a in z]
    m = 1 + (k if local_linear else 0)
    size = m * (m + 1) // 2 + m
    row = list(df.select(response, *columns).na.drop().agg(*(c.alias(f"c{i}") for i, c in enumerate(cells))).first())
    out = []
    for i, p in enumerate(grid):
        v = row[i * size : (i + 1) * size]
        a, at = np.zeros((m, m)), 0
        for r in range(m):
            for c in range(r, m):
                a[r, c] = a[c, r] = v[at]
                at += 1
        out.append((*map(float, p), float((np.linalg.pinv(a) @ np.array(v[at:], float))[0])))
    return df.sparkSession.createDataFrame(out, ", ".join(f"x{i} double" for i in range(k)) + ", mean double")


def lowess(df: DataFrame, response: str, column: str, frac: float = 2 / 3, points: int = 100, rounds: int = 3) -> DataFrame:
    """(x, fitted): locally weighted lines at points places along the column with tricube weights, made robust by bisquare weights of
    residuals. The data enter as sums in fine bins of equal numbers of rows (20 for each point), so that their number doesn't matter."""
    x = df.select(F.col(column).cast("double").alias("x"), F.col(response).cast("double").alias("y")).na.drop()
    cuts = x.agg(F.percentile_approx("x", F.array(*(F.lit(i / (20 * points)) for i in range(1, 20 * points))), 100_000)).first()[0] or []
    cuts = sorted(set(cuts))
    bounds = F.array(*(F.lit(float(c)) for c in cuts))
    b = x.groupBy(F.size(F.filter(bounds, lambda c: c < F.col("x"))).alias("b")).agg(F.count("*").alias("n"), F.avg("x").alias("x"), F.avg("y").alias("y")).orderBy("x").toPandas()
    bx, by, n = b["x"].to_numpy(float), b["y"].to_numpy(float), b["n"].to_numpy(float)
    if not len(bx):
        return df.sparkSession.createDataFrame([], "x double, fitted double")
    at = np.unique(np.quantile(bx, np.linspace(0, 1, points)))
    need, robust = frac * n.sum(), np.ones(len(bx))

    def fit(p: float) -> float:
        d = np.abs(bx - p)
        o = np.argsort(d)
        h = d[o][min(np.searchsorted(np.cumsum(n[o]), need), len(o) - 1)] or 1e-300
        w = n * robust * np.where(d < h, (1 - (d / h) ** 3) ** 3, 0.0)
        if w.sum() <= 0:
            w = n * np.exp(-d / h)
        m = (w * bx).sum() / w.sum()
        v = (w * (bx - m) ** 2).sum()
        slope = (w * (bx - m) * by).sum() / v if v > 0 else 0.0
        return float((w * by).sum() / w.sum() + slope * (p - m))

    for i in range(rounds + 1):
        fitted = np.array([fit(p) for p in at])
        if i == rounds:
            break
        r = np.abs(by - np.interp(bx, at, fitted))
        s = 6 * np.median(np.repeat(r, np.maximum(n / n.min(), 1).astype(int))) if len(r) else 0.0
        robust = np.where(r < s, (1 - (r / s) ** 2) ** 2, 0.0) if s > 0 else np.ones(len(bx))
    return df.sparkSession.createDataFrame([(float(a), f) for a, f in zip(at, fitted)], "x double, fitted double")


def clayton_cdf(u: Column, v: Column, theta: float) -> Column:
    return F.pow(F.greatest(F.pow(u, -theta) + F.pow(v, -theta) - 1, F.lit(0.0)), -1 / theta)


def frank_pdf(u: Column, v: Column, theta: float) -> Column:
    a = -F.expm1(-theta * u) * -F.expm1(-theta * v)
    return theta * (-math.expm1(-theta)) * F.exp(-theta * (u + v)) / F.pow(F.lit(-math.expm1(-theta)) - a, 2)


def gumbel_pdf(u: Column, v: Column, theta: float) -> Column:
    x, y = -F.log(u), -F.log(v)
    s = F.pow(x, theta) + F.pow(y, theta)
    r = F.pow(s, 1 / theta)
    return F.exp(-r) / (u * v) * F.pow(x * y, theta - 1) * F.pow(s, 2 / theta - 2) * (1 + (theta - 1) / r)


def gaussian_copula_pdf(u: Column, v: Column, rho: float) -> Column:
    from tallyforge.functions import distributions as dist

    a, b = dist.column(dist.Normal(), "ppf", u), dist.column(dist.Normal(), "ppf", v)
    return F.exp(-(rho * rho * (a * a + b * b) - 2 * rho * a * b) / (2 * (1 - rho * rho))) / math.sqrt(1 - rho * rho)


def student_copula_pdf(u: Column, v: Column, rho: float, df: float) -> Column:
    from tallyforge.functions import distributions as dist

    t = dist.StudentT(df)
    a, b = dist.column(t, "ppf", u), dist.column(t, "ppf", v)
    joint = F.pow(1 + (a * a + b * b - 2 * rho * a * b) / (df * (1 - rho * rho)), -(df + 2) / 2) / (2 * math.pi * math.sqrt(1 - rho * rho))
    return joint / (dist.column(t, "pdf", a) * dist.column(t, "pdf", b))


def bvn_cdf(x: float, y: float, rho: float) -> float:
    """P(X <= x, Y <= y) of two normals of correlation rho: an integral over the correlation, by Gauss and Legendre's points."""
    from tallyforge.functions import distributions as dist

    if abs(rho) >= 1:
        return min(dist.norm_cdf(x), dist.norm_cdf(y)) if rho > 0 else max(dist.norm_cdf(x) + dist.norm_cdf(y) - 1, 0.0)
    z, w = np.polynomial.legendre.leggauss(64)
    a = math.asin(rho)
    s = np.sin(a * (z + 1) / 2)
    return float(dist.norm_cdf(x) * dist.norm_cdf(y) + a / 2 * (w * np.exp(-(x * x + y * y - 2 * s * x * y) / (2 * (1 - s * s)))).sum() / (2 * math.pi))


def copula_theta(family: str, tau: float) -> float:
    """Parameter of a copula with Kendall's tau."""
    if family == "clayton":
        return 2 * tau / (1 - tau)
    if family == "gumbel":
        return 1 / (1 - tau)
    if family in ("gaussian", "student"):
        return math.sin(math.pi * tau / 2)
    if family == "frank":
        from tallyforge.operators.robust import brentq

        z, w = np.polynomial.legendre.leggauss(64)

        def of(theta: float) -> float:
            t = theta * (z + 1) / 2
            return 1 - 4 / theta * (1 - float((w * t / np.expm1(t)).sum()) / 2) - tau

        return brentq(of, 1e-6, 500.0) if tau > 0 else -copula_theta("frank", -tau)
    raise ValueError(f"{family} isn't known")


def kendalls_tau(df: DataFrame, a: str, b: str) -> float:
    """Tau-b from counts of distinct pairs: discordant pairs are counted by blocks of a's order, each holding a sorted list of b's
    distinct values with counts; as many as the table of distinct (a, b) pairs, which must suit the driver."""
    c = df.select(F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b")).na.drop().groupBy("a", "b").agg(F.count("*").alias("n")).toPandas().to_numpy(float)
    if not len(c):
        return math.nan
    n = c[:, 2].sum()
    c = c[np.lexsort((c[:, 1], c[:, 0]))]
    values, rank = np.unique(c[:, 1], return_inverse=True)
    tree, concordant, i = np.zeros(len(values) + 1), 0.0, 0

    def upto(k: int) -> float:
        s = 0.0
        while k > 0:
            s += tree[k]
            k -= k & -k
        return s

    while i < len(c):
        j = i
        while j < len(c) and c[j, 0] == c[i, 0]:
            concordant += c[j, 2] * upto(rank[j])
            j += 1
        for r in range(i, j):
            k = rank[r] + 1
            while k <= len(values):
                tree[k] += c[r, 2]
                k += k & -k
        i = j
    ties = lambda v: sum(s * (s - 1) / 2 for s in np.bincount(np.unique(v, return_inverse=True)[1], c[:, 2]))
    ta, tb, tab, total = ties(c[:, 0]), ties(c[:, 1]), (c[:, 2] * (c[:, 2] - 1) / 2).sum(), n * (n - 1) / 2
    discordant = total - concordant - ta - tb + tab
    d = math.sqrt((total - ta) * (total - tb))
    return float((concordant - discordant) / d) if d else math.nan
