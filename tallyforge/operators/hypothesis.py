"""Descriptive statistics and hypothesis tests; each takes a DataFrame and returns a small one."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyforge.functions import distributions as dist


def one(df: DataFrame, /, **values: float) -> DataFrame:
    return df.sparkSession.createDataFrame([tuple(None if v is None else float(v) for v in values.values())], ", ".join(f"{k} double" for k in values))


def ratio(a: float | None, b: float | None) -> float:
    """a / b, NaN where that isn't defined."""
    return a / b if a is not None and b else math.nan


def moments(df: DataFrame, value: str) -> dict[str, float]:
    """n, mean and central moments m2, m3, m4 (divided by n), from two passes; NaN without rows."""
    x = df.select(F.col(value).cast("double").alias("x")).where("x is not null and not isnan(x)")
    n, mean = x.agg(F.count("*"), F.avg("x")).first()
    d = F.col("x") - F.lit(mean)
    m2, m3, m4 = x.agg(F.avg(d * d), F.avg(d * d * d), F.avg(d * d * d * d)).first() if n else (math.nan,) * 3
    return {"n": n, "mean": mean if n else math.nan, "m2": m2, "m3": m3, "m4": m4}


def shape(m: dict[str, float]) -> tuple[float, float]:
    """Skewness and kurtosis; NaN where all values are equal."""
    return (m["m3"] / m["m2"] ** 1.5, m["m4"] / m["m2"] ** 2) if m["n"] and m["m2"] > 0 else (math.nan, math.nan)


#: Rows of a group beyond which only the ranges of its values that hold a wanted place are sorted, and groups that are broadcast at most.
ROWS, GROUPS = 1_000_000, 100_000


def ranges(df: DataFrame, cuts: str, value: str, name: str) -> DataFrame:
    """df with name, how many of the ascending cuts (an array of up to 255, null for none) are below value, by halving. It is a fold:
    chained columns are collapsed into an expression that grows threefold a step."""
    steps = F.array(*(F.lit(k) for k in (128, 64, 32, 16, 8, 4, 2, 1)))
    return df.withColumn(name, F.aggregate(steps, F.lit(0), lambda i, k: i + F.when(F.get(F.col(cuts), i + k - 1) < F.col(value), k).otherwise(0)))


def grouped_quantiles(df: DataFrame, value: str, group: str, shares: dict[str, float], rows: int = ROWS) -> DataFrame:
    """Exact quantiles with interpolation by group: (group, a double for each of shares), without null groups and values; NaN is above
    all numbers. Distinct values are counted and placed by running counts. Those of a group of more than rows rows are cut into 200
    ranges, of which only those that hold a wanted place are sorted, each by itself, so that no task holds a large group. Up to
    GROUPS groups, a join with the result is a broadcast."""
    spark = df.sparkSession
    x = df.select(F.col(group).alias("g"), F.col(value).cast("double").alias("x"), F.xxhash64(group).alias("h")).where("g is not null and x is not null")
    large = F.when(F.col("n") > rows, F.struct("h", "n"))
    groups, found = x.groupBy("g", "h").agg(F.count("*").alias("n")).agg(F.count("*"), F.collect_list(large)).first()  # at most one of each rows rows
    size = {r["h"]: r["n"] for r in found}
    if size:
        every = F.array(*(F.lit(i / 200) for i in range(1, 200)))
        big = x.where(F.col("h").isin(list(size)))
        # The cuts are values, so that a repeated task cuts alike.
        cuts = {r["h"]: sorted({c for c in r["c"] if not math.isnan(c)}) for r in big.groupBy("h").agg(F.percentile_approx("x", every, 1000).alias("c")).collect()}
        bound = spark.createDataFrame(list(cuts.items()), "h bigint, cuts array<double>")
        counts = {(r["h"], r["r"]): r["count"] for r in ranges(big.join(F.broadcast(bound), "h"), "cuts", "x", "r").groupBy("h", "r").count().collect()}
        held = []
        for h, c in cuts.items():
            places = {k for p in shares.values() for k in (math.floor(p * (size[h] - 1)), math.ceil(p * (size[h] - 1)))}
            base, upto = [], 0
            for r in range(len(c) + 1):
                n = counts.get((h, r), 0)
                base.append(upto if any(upto <= k < upto + n for k in places) else None)
                upto += n
            held.append((h, size[h], c, base))
        bound = spark.createDataFrame(held, "h bigint, n bigint, cuts array<double>, base array<bigint>")
        y = ranges(x.join(F.broadcast(bound), "h", "left"), "cuts", "x", "r").withColumn("b", F.when(F.col("cuts").isNull(), 0).otherwise(F.get("base", F.col("r")))).where("b is not null")
    else:
        y = x.select("g", "x", F.lit(0).alias("r"), F.lit(None).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("b"))
    w = Window.partitionBy("g", "r")
    y = y.groupBy("g", "r", "b", "n", "x").agg(F.count("*").alias("c"))
    y = y.select("g", "x", "c", (F.col("b") + F.sum("c").over(w.orderBy("x").rowsBetween(Window.unboundedPreceding, 0))).alias("upto"), F.coalesce("n", F.sum("c").over(w)).alias("n"))
    at = {m: F.lit(float(p)) * (F.col("n") - 1) for m, p in shares.items()}
    here = lambda k: F.max(F.when((F.col("upto") - F.col("c") <= k) & (k < F.col("upto")), F.col("x")))
    y = y.groupBy("g", "n").agg(*(here(f(t)).alias(f"{e}_{m}") for m, t in at.items() for e, f in (("lo", F.floor), ("hi", F.ceil))))
    between = lambda lo, hi, t: F.when(lo == hi, lo).otherwise((F.ceil(t) - t) * lo + (t - F.floor(t)) * hi)
    out = y.select(F.col("g").alias(group), *(between(F.col(f"lo_{m}"), F.col(f"hi_{m}"), t).alias(m) for m, t in at.items()))
    return F.broadcast(out) if groups <= GROUPS else out


def quantiles(df: DataFrame, value: str | Column, shares: list[float], rows: int = ROWS) -> list[float]:
    """Exact quantiles with interpolation, of all rows as of one group. NaN without rows."""
    v = F.col(value) if isinstance(value, str) else value
    x = df.select(v.cast("double").alias("x"), F.lit(0).alias("all")).where("x is not null and not isnan(x)")
    row = grouped_quantiles(x, "x", "all", {f"q{i}": p for i, p in enumerate(shares)}, rows).first()
    return list(row)[1:] if row else [math.nan] * len(shares)


def describe(df: DataFrame, value: str) -> DataFrame:
    """One row: count, missing, mean, std, coefficient of variation, quartiles by interpolation, min, max, skewness and kurtosis (3
    for a normal). Without rows all but the counts are NaN; with one, what needs two."""
    x = F.col(value).cast("double")
    ok = x.isNotNull() & ~F.isnan(x)
    m = moments(df, value)
    total, low, high = df.agg(F.count("*"), F.min(F.when(ok, x)), F.max(F.when(ok, x))).first()
    p = (0.05, 0.25, 0.5, 0.75, 0.95)
    q = {f"p{int(100 * a)}": v for a, v in zip(p, quantiles(df, value, list(p)))}
    s = math.sqrt(m["m2"] * m["n"] / (m["n"] - 1)) if m["n"] > 1 else math.nan
    skew, kurt = shape(m)
    return one(df, nobs=m["n"], missing=total - m["n"], mean=m["mean"], std=s, coef_var=ratio(s, m["mean"]), skew=skew, kurtosis=kurt, **q, min=math.nan if low is None else low, max=math.nan if high is None else high)


def weighted(df: DataFrame, value: str, weight: str) -> DataFrame:
    """Weighted mean, variance (ddof 0) and the standard deviation of the mean. NaN without weight."""
    x, w = F.col(value), F.col(weight)
    total, mean = df.agg(F.sum(w), F.sum(w * x) / F.nullif(F.sum(w), F.lit(0.0))).first()
    if not total:
        return one(df, sum_weights=total or 0.0, mean=math.nan, var=math.nan, std_mean=math.nan)
    var = df.agg(F.sum(w * (x - F.lit(mean)) * (x - F.lit(mean)))).first()[0] / total
    return one(df, sum_weights=total, mean=mean, var=var, std_mean=math.sqrt(var / (total - 1)) if total > 1 else math.nan)


def by_group(df: DataFrame, value: str, group: str) -> list[tuple]:
    """(group, n, mean, sample variance), ordered by group."""
    return sorted(tuple(r) for r in df.where(F.col(group).isNotNull()).groupBy(group).agg(F.count(value), F.avg(value), F.var_samp(value)).collect())


def ttest_ind(df: DataFrame, value: str, group: str, a, b, pooled: bool = True, diff: float = 0.0, alternative: str = "two-sided") -> DataFrame:
    """Student's (pooled) or Welch's t of two groups' difference of means against diff. NaN where a group has fewer than two rows."""
    t, dof, _ = two_means(df, value, group, a, b, pooled, diff)
    return one(df, tstat=t, df=dof, pvalue=tail(t, alternative, lambda z: dist.t_sf(z, dof)))


def tail(stat: float, alternative: str, sf) -> float:
    """p-value of a symmetric statistic: two-sided, larger or smaller."""
    if not math.isfinite(stat):
        return math.nan if math.isnan(stat) else {"two-sided": 0.0, "larger": float(stat < 0), "smaller": float(stat > 0)}[alternative]
    return {"two-sided": lambda: 2 * sf(abs(stat)), "larger": lambda: sf(stat), "smaller": lambda: sf(-stat)}[alternative]()


def two_means(df: DataFrame, value: str, group: str, a, b, pooled: bool, diff: float = 0.0) -> tuple[float, float, float]:
    g = {r[0]: r[1:] for r in by_group(df.where(F.col(group).isin(a, b)), value, group)}
    (n1, m1, v1), (n2, m2, v2) = (g.get(k, (0, None, None)) for k in (a, b))
    if n1 < 2 or n2 < 2:
        return math.nan, math.nan, math.nan
    if pooled:
        dof = n1 + n2 - 2
        se = math.sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / dof * (1 / n1 + 1 / n2))
    else:
        se = math.sqrt(v1 / n1 + v2 / n2)
        dof = se**4 / ((v1 / n1) ** 2 / (n1 - 1) + (v2 / n2) ** 2 / (n2 - 1)) if se else math.nan
    return (m1 - m2 - diff) / se if se else math.nan, dof, se


def ttost_ind(df: DataFrame, value: str, group: str, a, b, low: float, high: float, pooled: bool = True) -> DataFrame:
    """Equivalence of two means within [low, high] by two one-sided tests; pvalue is the larger one."""
    t1, dof, _ = two_means(df, value, group, a, b, pooled, low)
    t2, _, _ = two_means(df, value, group, a, b, pooled, high)
    sf = lambda z: dist.t_sf(z, dof)
    p1, p2 = tail(t1, "larger", sf), tail(t2, "smaller", sf)
    return one(df, pvalue=max(p1, p2), t_low=t1, p_low=p1, t_high=t2, p_high=p2, df=dof)


def ztest_one(df: DataFrame, value: str, mean: float, alternative: str = "two-sided") -> DataFrame:
    n, m, v = df.agg(F.count(value), F.avg(value), F.var_samp(value)).first()
    z = ratio(m - mean, math.sqrt(v / n)) if n > 1 else math.nan
    return one(df, zstat=z, pvalue=tail(z, alternative, dist.norm_sf))


def ztest_two(df: DataFrame, value: str, group: str, a, b, diff: float = 0.0, alternative: str = "two-sided") -> DataFrame:
    """z of two groups' means with the pooled variance."""
    z, _, _ = two_means(df, value, group, a, b, True, diff)
    return one(df, zstat=z, pvalue=tail(z, alternative, dist.norm_sf))


def ttest_mean(df: DataFrame, value: str, mean: float = 0.0, weight: str | None = None, alternative: str = "two-sided") -> DataFrame:
    """One mean (weighted by counts) against a value."""
    w = F.col(weight) if weight else F.lit(1.0)
    x = df.where(F.col(value).isNotNull())
    total, m = x.agg(F.sum(w), F.sum(w * F.col(value)) / F.sum(w)).first()
    if not total or total <= 1:
        return one(df, tstat=math.nan, df=math.nan, pvalue=math.nan)
    var = x.agg(F.sum(w * F.pow(F.col(value) - F.lit(m), 2))).first()[0] / (total - 1)
    t = ratio(m - mean, math.sqrt(var / total))
    return one(df, tstat=t, df=total - 1, pvalue=tail(t, alternative, lambda z: dist.t_sf(z, total - 1)))


def oneway(df: DataFrame, value: str, group: str, kind: str = "equal") -> DataFrame:
    """F of group means: variances equal, unequal (Welch) or Brown and Forsythe's."""
    g = by_group(df, value, group)
    k, n = len(g), sum(r[1] for r in g)
    grand = sum(r[1] * r[2] for r in g) / n
    between = sum(r[1] * (r[2] - grand) ** 2 for r in g)
    if kind == "equal":
        f, d1, d2 = between / (k - 1) / (sum((r[1] - 1) * r[3] for r in g) / (n - k)), k - 1, n - k
    elif kind == "unequal":
        w = [r[1] / r[3] for r in g]
        total = sum(w)
        centre = sum(a * r[2] for a, r in zip(w, g)) / total
        off = sum((1 - a / total) ** 2 / (r[1] - 1) for a, r in zip(w, g))
        f = sum(a * (r[2] - centre) ** 2 for a, r in zip(w, g)) / (k - 1) / (1 + 2 * (k - 2) / (k * k - 1) * off)
        d1, d2 = k - 1, (k * k - 1) / (3 * off)
    else:
        parts = [(1 - r[1] / n) * r[3] for r in g]
        f, d1 = between / sum(parts), k - 1
        d2 = sum(parts) ** 2 / sum(p * p / (r[1] - 1) for p, r in zip(parts, g))
    return one(df, statistic=f, df_num=d1, df_denom=d2, pvalue=dist.f_sf(f, d1, d2))


def pairwise(df: DataFrame, value: str, group: str) -> DataFrame:
    """Differences of all pairs of group means with the pooled standard error of Tukey and Kramer."""
    g = df.where(F.col(group).isNotNull()).groupBy(F.col(group).alias("g")).agg(F.count(value).alias("n"), F.avg(value).alias("m"), F.var_samp(value).alias("v"))
    s = g.agg((F.sum(F.expr("(n - 1) * v")) / F.sum(F.expr("n - 1"))).alias("s2"))
    a, b = (g.select(*(F.col(c).alias(f"{c}{i}") for c in "gnm")) for i in (1, 2))
    return a.join(b, F.col("g1") < F.col("g2")).join(F.broadcast(s)).select(F.col("g1").alias("group1"), F.col("g2").alias("group2"), F.expr("m2 - m1").alias("meandiff"), F.expr("sqrt(s2 / 2 * (1 / n1 + 1 / n2))").alias("std_pair"))


def tukey_hsd(df: DataFrame, value: str, group: str, alpha: float = 0.05) -> DataFrame:
    """Every pair of groups (at most as many as the driver's memory holds): meandiff, std_pair, q, pvalue of the studentised range, simultaneous interval, reject."""
    g = by_group(df, value, group)
    k, dof = len(g), sum(r[1] - 1 for r in g)
    s2 = sum((r[1] - 1) * r[3] for r in g if r[1] > 1) / dof
    cut = srange_ppf(1 - alpha, k, dof)
    rows = []
    for i, a in enumerate(g):
        for b in g[i + 1 :]:
            d, se = b[2] - a[2], math.sqrt(s2 / 2 * (1 / a[1] + 1 / b[1]))
            q = abs(d) / se if se else math.nan
            rows.append((str(a[0]), str(b[0]), *map(float, (d, se, q, srange_sf(q, k, dof), d - cut * se, d + cut * se)), bool(q > cut)))
    return df.sparkSession.createDataFrame(rows, "group1 string, group2 string, meandiff double, std_pair double, q double, pvalue double, ci_low double, ci_high double, reject boolean")


def srange_cdf(q: float, k: int, dof: float) -> float:
    """Studentised range of k means: the range of normals integrated over the scale, both by Gauss and Legendre's points."""
    if q <= 0:
        return 0.0
    z, w = np.polynomial.legendre.leggauss(64)

    def ranges(r: np.ndarray) -> np.ndarray:
        """P(range of k standard normals <= r)."""
        t = 8.5 * z
        inner = np.clip(np.asarray(dist.norm_cdf(t[None, :])) - np.asarray(dist.norm_cdf(t[None, :] - r[:, None])), 0, 1) ** (k - 1)
        return np.clip(k * 8.5 * (w * np.asarray(dist.norm_pdf(t)) * inner).sum(1), 0, 1)

    if dof > 25_000:
        return float(ranges(np.array([q]))[0])
    # Scale s with dof s^2 chi-square: integrate over eight deviations around 1.
    sd = 1 / math.sqrt(2 * dof)
    low, high = max(1e-9, 1 - 9 * sd), 1 + 9 * sd + (3 / dof if dof < 10 else 0) * 2
    total = 0.0
    for a, b in zip(np.linspace(low, high, 5), np.linspace(low, high, 5)[1:]):
        s = (b - a) / 2 * z + (a + b) / 2
        logf = math.log(2) + dof / 2 * math.log(dof / 2) - math.lgamma(dof / 2) + (dof - 1) * np.log(s) - dof * s * s / 2
        total += (b - a) / 2 * float((w * np.exp(logf) * ranges(q * s)).sum())
    return float(min(max(total, 0.0), 1.0))


def srange_sf(q: float, k: int, dof: float) -> float:
    return 1 - srange_cdf(q, k, dof)


def srange_ppf(p: float, k: int, dof: float) -> float:
    low, high = 0.0, 1.0
    while srange_cdf(high, k, dof) < p and high < 1e6:
        high *= 2
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if srange_cdf(middle, k, dof) < p else (low, middle)
    return (low + high) / 2


def proportions_ztest(df: DataFrame, success: str, group: str) -> DataFrame:
    """z of two groups' shares of rows where success holds, with the pooled variance."""
    g = sorted(tuple(r) for r in df.groupBy(group).agg(F.count("*"), F.count_if(F.expr(success))).collect())
    (_, n1, c1), (_, n2, c2) = g
    p = (c1 + c2) / (n1 + n2)
    z = (c1 / n1 - c2 / n2) / math.sqrt(p * (1 - p) * (1 / n1 + 1 / n2))
    return one(df, prop1=c1 / n1, prop2=c2 / n2, zstat=z, pvalue=2 * dist.norm_sf(abs(z)))


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    """Chi-square of independence of two categories."""
    cells = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count("*").cast("double").alias("n")).collect()
    rows, cols = {}, {}
    for x, y, n in cells:
        rows[x], cols[y] = rows.get(x, 0) + n, cols.get(y, 0) + n
    total, seen = sum(rows.values()), {(x, y): n for x, y, n in cells}
    chi = sum((seen.get((x, y), 0) - rows[x] * cols[y] / total) ** 2 / (rows[x] * cols[y] / total) for x in sorted(rows) for y in sorted(cols))
    dof = (len(rows) - 1) * (len(cols) - 1)
    return one(df, statistic=chi, df=dof, pvalue=dist.chi2_sf(chi, dof) if dof else 1.0)


def cohens_kappa(df: DataFrame, a: str, b: str) -> DataFrame:
    """Agreement of two raters beyond chance."""
    cells = [tuple(r) for r in df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).count().collect()]
    n = sum(c for *_, c in cells)
    share = lambda k, v: sum(r[2] for r in cells if r[k] == v) / n
    same, chance = sum(c for x, y, c in cells if x == y) / n, sum(share(0, v) * share(1, v) for v in sorted({x for x, *_ in cells} | {y for _, y, _ in cells}))
    return one(df, agreement=same, chance=chance, kappa=(same - chance) / (1 - chance))


def jarque_bera(df: DataFrame, value: str) -> DataFrame:
    m = moments(df, value)
    skew, kurt = shape(m)
    jb = m["n"] / 6 * (skew**2 + (kurt - 3) ** 2 / 4)
    return one(df, jb=jb, pvalue=dist.chi2_sf(jb, 2) if math.isfinite(jb) else math.nan, skew=skew, kurtosis=kurt)


def omni_normtest(df: DataFrame, value: str) -> DataFrame:
    """D'Agostino and Pearson's statistic from transformed skewness and kurtosis; NaN below 8 rows."""
    m = moments(df, value)
    n, (skew, kurt) = m["n"], shape(m)
    if n < 8 or math.isnan(skew):
        return one(df, statistic=math.nan, pvalue=math.nan)
    y = skew * math.sqrt((n + 1) * (n + 3) / (6 * (n - 2)))
    b2 = 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = -1 + math.sqrt(2 * (b2 - 1))
    zs = math.asinh(y / math.sqrt(2 / (w2 - 1))) / math.sqrt(0.5 * math.log(w2))
    e = 3 * (n - 1) / (n + 1)
    var = 24 * n * (n - 2) * (n - 3) / ((n + 1) ** 2 * (n + 3) * (n + 5))
    x = (kurt - e) / math.sqrt(var)
    b1 = 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * math.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    a = 6 + 8 / b1 * (2 / b1 + math.sqrt(1 + 4 / b1**2))
    d = 1 + x * math.sqrt(2 / (a - 4))
    zk = ((1 - 2 / (9 * a)) - math.copysign(abs((1 - 2 / a) / d) ** (1 / 3), d)) / math.sqrt(2 / (9 * a)) if d else math.nan
    stat = zs * zs + zk * zk
    return one(df, statistic=stat, pvalue=dist.chi2_sf(stat, 2))


def multipletests(df: DataFrame, p: str, method: str = "bh") -> DataFrame:
    """Adjusted p-values: bonferroni, holm or bh (Benjamini and Hochberg). Adds rank_ and p_adjusted; rows without p are left out."""
    x = df.where(F.col(p).isNotNull())
    total = Window.partitionBy()
    x = x.withColumns({"rank_": F.row_number().over(Window.orderBy(p)), "m_": F.count("*").over(total)})
    if method == "bonferroni":
        adjusted = F.col(p) * F.col("m_")
    elif method == "holm":
        adjusted = F.max(F.col(p) * (F.col("m_") - F.col("rank_") + 1)).over(Window.orderBy("rank_").rowsBetween(Window.unboundedPreceding, 0))
    else:
        adjusted = F.min(F.col(p) * F.col("m_") / F.col("rank_")).over(Window.orderBy(F.desc("rank_")).rowsBetween(Window.unboundedPreceding, 0))
    return x.withColumn("p_adjusted", F.least(F.lit(1.0), adjusted)).drop("m_")


def average_ranks(df: DataFrame, value: str, name: str) -> DataFrame:
    """Adds the rank of value, ties averaged: ranks come from counts of distinct values, not from a sort of all rows."""
    counts = df.groupBy(value).agg(F.count("*").alias("c_"))
    upto = F.sum("c_").over(Window.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    return df.join(counts.select(value, (upto - (F.col("c_") - 1) / 2).alias(name)), value)


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    x = average_ranks(average_ranks(df.select(a, b).na.drop(), a, "ra_"), b, "rb_")
    return x.agg(F.count("*").alias("n"), F.corr("ra_", "rb_").alias("rho"))


def ecdf(df: DataFrame, value: str) -> DataFrame:
    """Distinct values with the share of rows up to each."""
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("x")).agg(F.count("*").alias("c"))
    return counts.select("x", (F.sum("c").over(Window.orderBy("x").rowsBetween(Window.unboundedPreceding, 0)) / F.sum("c").over(Window.partitionBy())).alias("y"))
