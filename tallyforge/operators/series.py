"""Time series, one per partition_by value; order_by is required, for Spark rows have no order of their own.

Windows run per series. Where there is just one series (no partition_by) and it is long, its rows are first cut into
stretches of the order column, whose sums and last rows are carried over, so that no task holds all of it.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyforge.functions import distributions as dist
from tallyforge.operators import tsmodels

#: Rows that one window sorts at most, about, where a series is cut into stretches.
STRETCH = 1_000_000


def over(order_by: str, partition_by: list[str] = ()) -> Window:
    return Window.partitionBy(*partition_by).orderBy(order_by)


def stretches(df: DataFrame, order_by: str, rows: int = STRETCH) -> tuple[DataFrame, int]:
    """df with a column stretch_ (0, 1, ...) that follows order_by, and how many there are: one up to rows rows. Equal order values
    are in one stretch. The cuts are values, so that a repeated task cuts alike."""
    n = df.count()
    if n <= rows:
        return df.withColumn("stretch_", F.lit(0)), 1
    parts = min(-(-n // rows), 4096)
    key = F.xxhash64(order_by)
    seen = sorted(r[0] for r in df.where(F.col(order_by).isNotNull()).select(order_by, key.alias("h_")).orderBy("h_").select(order_by).limit(20 * parts).distinct().collect())
    cuts = sorted({seen[int(len(seen) * i / parts)] for i in range(1, parts)})
    kind = df.schema[order_by].dataType.simpleString()
    array = F.array(*(F.lit(c).cast(kind) for c in cuts))
    return df.withColumn("stretch_", F.coalesce(F.size(F.filter(array, lambda c: c <= F.col(order_by))), F.lit(0))), len(cuts) + 1


def numbered(df: DataFrame, order_by: str, partition_by: list[str] = (), sums: dict[str, Column] | None = None, rows: int = STRETCH) -> DataFrame:
    """df with pos_, the place of a row in its series from 0, and for each of sums (name to column) its sum up to the row."""
    sums = sums or {}
    keys = list(partition_by)
    if keys:
        w = over(order_by, keys)
        upto = w.rowsBetween(Window.unboundedPreceding, 0)
        return df.select("*", (F.row_number().over(w) - 1).cast("bigint").alias("pos_"), *(F.sum(c).over(upto).alias(n) for n, c in sums.items()))
    cut, parts = stretches(df, order_by, rows)
    w = over(order_by, ["stretch_"])
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    local = cut.select("*", (F.row_number().over(w) - 1).cast("bigint").alias("pos_"), *(F.sum(c).over(upto).alias(n) for n, c in sums.items()))
    if parts == 1:
        return local.drop("stretch_")
    whole = cut.groupBy("stretch_").agg(F.count("*").alias("n_"), *(F.sum(c).alias(f"{n}_") for n, c in sums.items())).collect()  # at most 4096 rows
    whole.sort(key=lambda r: r["stretch_"])
    before, base = [], [0] + [0.0] * len(sums)
    for r in whole:
        before.append((r["stretch_"], *base))
        base = [b + (r[c] or 0) for b, c in zip(base, ["n_", *(f"{n}_" for n in sums)])]
    names = ["b0_", *(f"b{i + 1}_" for i in range(len(sums)))]
    carried = df.sparkSession.createDataFrame(before, "stretch_ int, b0_ bigint" + "".join(f", {n} double" for n in names[1:]))
    out = local.join(F.broadcast(carried), "stretch_")
    return out.select(*df.columns, (F.col("pos_") + F.col("b0_")).alias("pos_"), *((F.col(n) + F.col(f"b{i + 1}_")).alias(n) for i, n in enumerate(sums)))


def with_lags(df: DataFrame, columns: list[str], order_by: str, lags: int | list[int], partition_by: list[str] = (), rows: int = STRETCH) -> DataFrame:
    """df with <column>_l1, ... up to lags, or for each of a list of lags, for each column (null before a series' start). In a long single series the last rows of a stretch
    are sent to the next one as well."""
    wanted = list(range(1, lags + 1)) if isinstance(lags, int) else sorted(set(lags))
    lags = max(wanted, default=0)
    named = lambda w: [F.lag(c, k).over(w).alias(f"{c}_l{k}") for c in columns for k in wanted]
    if partition_by or not lags:
        return df.select("*", *named(over(order_by, partition_by)))
    cut, parts = stretches(df, order_by, rows)
    if parts == 1:
        return df.select("*", *named(over(order_by)))
    size = max(rows, lags)
    placed = numbered(df, order_by, rows=rows).withColumn("block_", F.floor(F.col("pos_") / size))
    both = F.when(F.col("pos_") % size >= size - lags, F.array(F.col("block_"), F.col("block_") + 1)).otherwise(F.array("block_"))
    spread = placed.withColumn("at_", F.explode(both))
    return spread.select("*", *named(Window.partitionBy("at_").orderBy("pos_"))).where("at_ = block_").drop("at_", "block_", "pos_")


def lagmat(df: DataFrame, value: str | list[str], order_by: str, lags: int, partition_by: list[str] = ()) -> DataFrame:
    """The series (one or more columns) with its lags 1 to lags (null before the start)."""
    values = [value] if isinstance(value, str) else list(value)
    return with_lags(df.select(*partition_by, order_by, *values), values, order_by, lags, partition_by)


def add_trend(df: DataFrame, order_by: str, trend: str = "c", partition_by: list[str] = ()) -> DataFrame:
    """df with const, trend and trend_squared for "c", "t", "ct" or "ctt" ("n": none); the trend counts from 1."""
    if trend not in ("n", "c", "t", "ct", "ctt"):
        raise ValueError(f"trend {trend} isn't known")
    out = df.withColumn("const", F.lit(1.0)) if "c" in trend else df
    if "t" in trend:
        t = (F.col("pos_") + 1).cast("double")
        out = numbered(out, order_by, partition_by).withColumn("trend", t)
        out = (out.withColumn("trend_squared", t * t) if trend == "ctt" else out).drop("pos_")
    return out


def autocovariances(df: DataFrame, value: str, order_by: str, nlags: int, partition_by: list[str] = ()) -> DataFrame:
    """(partition_by, n, mean, s0, s1, ...): sums of products of deviations at each lag, one row per series."""
    keys = list(partition_by)
    x = df.where(F.col(value).isNotNull()).select(*keys, order_by, F.col(value).cast("double").alias("v_"))
    if keys:
        centred = x.withColumn("d_", F.col("v_") - F.avg("v_").over(Window.partitionBy(*keys)))
    else:
        mean = x.agg(F.avg("v_")).first()[0]
        centred = x.withColumn("d_", F.col("v_") - F.lit(mean))
    lagged = with_lags(centred, ["d_"], order_by, nlags, keys)
    cells = [F.sum(F.col("d_") * F.col(f"d__l{k}" if k else "d_")).alias(f"s{k}") for k in range(nlags + 1)]
    return lagged.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("v_").alias("mean"), *cells)


def acf(df: DataFrame, value: str, order_by: str, nlags: int, partition_by: list[str] = (), adjusted: bool = False, alpha: float | None = None) -> DataFrame:
    """Autocovariance and autocorrelation at lags 0 to nlags, divided by n (adjusted: by n less the lag), with Ljung and Box's
    statistic and its p-value; with alpha Bartlett's interval."""
    sums = autocovariances(df, value, order_by, nlags, partition_by)
    keys = list(partition_by)

    def rows(n: int, s: list[float]) -> list[tuple]:
        out, q, bartlett = [], 0.0, 1.0
        for k, v in enumerate(s):
            v = v or 0.0
            cov = v / (n - k if adjusted else n)
            r = cov / (s[0] / n) if s[0] else math.nan
            q += n * (n + 2) * r * r / (n - k) if k else 0.0
            half = dist.norm_ppf(1 - (alpha or 0.05) / 2) * math.sqrt(bartlett / n) if k else 0.0
            bartlett += 2 * r * r if k else 0.0
            out.append((k, cov, r, q, dist.chi2_sf(q, k) if k and math.isfinite(q) else math.nan, r - half, r + half))
        return out

    spark = df.sparkSession
    schema = "lag int, acovf double, acf double, ljung_box double, pvalue double, ci_low double, ci_high double"
    if not keys:
        r = sums.first()
        found = spark.createDataFrame(rows(r["n"], [r[f"s{k}"] for k in range(nlags + 1)]) if r else [], schema)
    else:
        kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in sums.select(*keys).schema)

        def expand(frames):
            for frame in frames:
                out = [(*key, *x) for key, n, s in zip(frame[keys].itertuples(index=False), frame["n"], frame[[f"s{k}" for k in range(nlags + 1)]].to_numpy()) for x in rows(n, list(s))]
                yield pd.DataFrame(out, columns=[*keys, "lag", "acovf", "acf", "ljung_box", "pvalue", "ci_low", "ci_high"])

        found = sums.mapInPandas(expand, f"{kinds}, {schema}")
    return found if alpha is not None else found.drop("ci_low", "ci_high")


def pacf(df: DataFrame, value: str, order_by: str, nlags: int, method: str = "yw") -> DataFrame:
    """Partial autocorrelations at lags 0 to nlags: "yw" adjusted Yule-Walker, "ywm" unadjusted, "ld" Levinson and Durbin, "ols" by regressions."""
    if method == "ols":
        from tallyforge.operators.likelihood import matrix, totals

        x = lagmat(df.where(F.col(value).isNotNull()).select(order_by, F.col(value).cast("double").alias("v")), "v", order_by, nlags)
        k = nlags + 2
        names = ["c", "v", *(f"v_l{i}" for i in range(1, nlags + 1))]
        mean = x.agg(F.avg("v")).first()[0]
        x = x.select(order_by, F.lit(1.0).alias("c"), *((F.col(c) - F.lit(mean)).alias(c) for c in names[1:]))
        out = [(0, 1.0)]
        for i in range(1, nlags + 1):
            part = x.where(F.col(f"v_l{i}").isNotNull()).select(*names[: i + 2])
            g = totals(part, lambda b: (lambda z: (z.T @ z).ravel())(matrix(b, names[: i + 2])), (i + 2) ** 2).reshape(i + 2, i + 2)  # noqa: B023
            take = [0, *range(2, i + 2)]
            out.append((i, float(np.linalg.lstsq(g[np.ix_(take, take)], g[take, 1], rcond=None)[0][-1])))
        return df.sparkSession.createDataFrame(out, "lag int, pacf double")
    r = autocovariances(df, value, order_by, nlags).first()
    gamma = np.array([(r[f"s{k}"] or 0.0) / (r["n"] - k if method in ("yw", "yw_adjusted") else r["n"]) for k in range(nlags + 1)])
    out = [1.0] + [float(tsmodels.yule_walker(gamma[: k + 1])[0][-1]) for k in range(1, nlags + 1)]
    return df.sparkSession.createDataFrame(list(enumerate(out)), "lag int, pacf double")


def ccf(df: DataFrame, a: str, b: str, order_by: str, nlags: int) -> DataFrame:
    """Correlation of a, k steps later, with b, for lags 0 to nlags, divided by n - k."""
    x = df.select(order_by, F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b")).na.drop("any")
    n, ma, mb, sa, sb = x.agg(F.count("*"), F.avg("a"), F.avg("b"), F.stddev_pop("a"), F.stddev_pop("b")).first()
    d = with_lags(x.select(order_by, (F.col("a") - F.lit(ma)).alias("a"), (F.col("b") - F.lit(mb)).alias("b")), ["b"], order_by, nlags)
    s = d.agg(*(F.sum(F.col("a") * F.col(f"b_l{k}" if k else "b")) for k in range(nlags + 1))).first()
    return df.sparkSession.createDataFrame([(k, float((s[k] or 0.0) / (n - k) / (sa * sb))) for k in range(nlags + 1)], "lag int, ccf double")


def durbin_watson(df: DataFrame, value: str, order_by: str, partition_by: list[str] = ()) -> DataFrame:
    d = with_lags(df.select(*partition_by, order_by, F.col(value).alias("e")), ["e"], order_by, 1, partition_by)
    cell = (F.sum((F.col("e") - F.col("e_l1")) * (F.col("e") - F.col("e_l1"))) / F.sum(F.col("e") * F.col("e"))).alias("dw")
    return d.groupBy(*partition_by).agg(cell)


def seasonal_decompose(df: DataFrame, value: str, order_by: str, period: int, model: str = "additive", partition_by: list[str] = ()) -> DataFrame:
    """Trend (centred moving average), seasonal and residual part, additive or multiplicative; the trend is null at both ends."""
    keys = list(partition_by)
    x = numbered(df.select(*keys, order_by, value), order_by, keys, {"s_": F.col(value).cast("double")}).withColumnRenamed("pos_", "i")
    # A moving sum is the difference of two sums up to a row, which the carried sums hold for any length of series.
    half, odd = period // 2, period % 2
    back = with_lags(x, ["s_"], order_by, [period] if odd else [1, period, period + 1], keys)
    ahead = back.select(*keys, (F.col("i") - half).alias("i"), F.col("s_").alias("upto_"), *(F.coalesce(F.col(f"s__l{k}"), F.when(F.col("i") - k == -1, 0.0)).alias(f"p{k}_") for k in ((period,) if odd else (1, period, period + 1))))
    if odd:
        trend = (F.col("upto_") - F.col(f"p{period}_")) / period
    else:
        trend = ((F.col("upto_") - F.col(f"p{period + 1}_")) + (F.col("p1_") - F.col(f"p{period}_"))) / (2 * period)
    x = x.drop("s_").join(ahead.select(*keys, "i", trend.alias("trend")), [*keys, "i"], "left")
    gap = F.col(value) - F.col("trend") if model == "additive" else F.col(value) / F.col("trend")
    season = x.groupBy(*keys, (F.col("i") % period).alias("phase")).agg(F.avg(gap).alias("s"))
    level = F.avg("s").over(Window.partitionBy(*keys))
    season = season.withColumn("seasonal", F.col("s") - level if model == "additive" else F.col("s") / level).drop("s")
    out = x.withColumn("phase", F.col("i") % period).join(season, [*keys, "phase"])
    rest = F.col(value) - F.col("trend") - F.col("seasonal") if model == "additive" else F.col(value) / F.col("trend") / F.col("seasonal")
    return out.select(*keys, order_by, value, "trend", "seasonal", rest.alias("resid"))


def rolling_ols(df: DataFrame, y: str, x: str | list[str], order_by: str, window: int, partition_by: list[str] = ()) -> DataFrame:
    """Coefficients over the last window rows; null until the window is full. One regressor: from running moments in the JVM; several:
    running products, solved row by row in Arrow batches (columns coef_0 for the intercept, coef_1, ...)."""
    keys = list(partition_by)
    w = over(order_by, keys).rowsBetween(1 - window, 0)
    full = F.count("*").over(w) == window
    if isinstance(x, str):
        slope = F.covar_pop(x, y).over(w) / F.var_pop(x).over(w)
        return df.select(*keys, order_by, F.when(full, slope).alias("slope"), F.when(full, F.avg(y).over(w) - slope * F.avg(x).over(w)).alias("intercept"))
    k = len(x)
    cells = {f"m{i}": F.avg(c).over(w) for i, c in enumerate([*x, y])}
    cells |= {f"c{i}_{j}": F.covar_pop(x[i], (*x, y)[j]).over(w) for i in range(k) for j in range(i, k + 1)}
    rows = df.select(*keys, order_by, full.alias("full"), *(v.alias(n) for n, v in cells.items()))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.select(*keys, order_by).schema)

    def solve(frames):
        for f in frames:
            a = np.zeros((len(f), k, k))
            for i in range(k):
                for j in range(i, k):
                    a[:, i, j] = a[:, j, i] = f[f"c{i}_{j}"]
            b = f[[f"c{i}_{k}" for i in range(k)]].to_numpy(float)
            ok = f["full"].to_numpy(bool) & np.isfinite(a).all((1, 2))
            beta = np.full((len(f), k + 1), np.nan)
            if ok.any():
                beta[ok, 1:] = np.einsum("nij,nj->ni", np.linalg.pinv(a[ok], hermitian=True), b[ok])
                beta[ok, 0] = f.loc[ok, f"m{k}"] - (beta[ok, 1:] * f.loc[ok, [f"m{i}" for i in range(k)]].to_numpy()).sum(1)
            out = f[[*keys, order_by]].copy()
            for i in range(k + 1):
                out[f"coef_{i}"] = beta[:, i]
            yield out

    return rows.mapInPandas(solve, kinds + "".join(f", coef_{i} double" for i in range(k + 1)))


def kpss(df: DataFrame, value: str, order_by: str, nlags: int, regression: str = "c") -> DataFrame:
    """Stationarity around a level ("c") or a line ("ct") with Bartlett weights: statistic, lags and p-value (between the tabled 0.01 and 0.1)."""
    x = numbered(df.where(F.col(value).isNotNull()).select(order_by, F.col(value).cast("double").alias("v")), order_by)
    n, mean, tbar, slope = x.agg(F.count("*"), F.avg("v"), F.avg("pos_"), F.covar_pop("pos_", "v") / F.nullif(F.var_pop("pos_"), F.lit(0.0))).first()
    e = F.col("v") - F.lit(mean) - ((F.col("pos_") - F.lit(tbar)) * F.lit(slope) if regression == "ct" else F.lit(0.0))
    d = numbered(x.select(order_by, e.alias("d")), order_by, (), {"s": F.col("d")}).drop("pos_")
    d = with_lags(d, ["d"], order_by, nlags)
    row = d.agg(F.sum(F.col("s") * F.col("s")), F.sum(F.col("d") * F.col("d")), *(F.sum(F.col("d") * F.col(f"d_l{k}")) for k in range(1, nlags + 1))).first()
    long_run = (row[1] + 2 * sum((1 - k / (nlags + 1)) * (row[k + 1] or 0.0) for k in range(1, nlags + 1))) / n
    stat = row[0] / n / n / long_run
    p = float(np.interp(stat, tsmodels.KPSS_CRITICAL[regression], [0.10, 0.05, 0.025, 0.01]))
    return df.sparkSession.createDataFrame([(stat, nlags, p)], "statistic double, lags int, pvalue double")


def per_series(df: DataFrame, columns: list[str], order_by: str, run: Callable[[pd.DataFrame], pd.DataFrame], schema: str, partition_by: list[str] = ()) -> DataFrame:
    """run over each series in order, in its own group: for recursions, which have no parallel form."""
    keys = list(partition_by)
    given = df.select(*keys, order_by, *(F.col(c).cast("double").alias(c) for c in columns)).where(" and ".join(f"`{c}` is not null" for c in columns))
    kinds = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in given.select(*keys).schema)

    def one(key, frame):
        out = run(frame.sort_values(order_by, kind="stable").reset_index(drop=True))
        for i, c in enumerate(keys):
            out.insert(i, c, [key[i]] * len(out))
        return out

    return given.groupBy(*keys).applyInPandas(one, kinds + schema)


def smoothing(df: DataFrame, value: str, order_by: str, alpha: float, partition_by: str) -> DataFrame:
    """Simple exponential smoothing at a fixed alpha from the first value: level after each row. A recursion per series, in its group."""
    kind = dict(df.dtypes)

    def run(frame):
        frame = frame.sort_values(order_by)
        frame["level"] = frame[value].ewm(alpha=alpha, adjust=False).mean()
        return frame

    given = df.select(partition_by, order_by, F.col(value).cast("double").alias(value))
    return given.groupBy(partition_by).applyInPandas(run, f"{partition_by} {kind[partition_by]}, {order_by} {kind[order_by]}, {value} double, level double")


def table(df: DataFrame, value: str, order_by: str, fit: Callable[[np.ndarray], dict[str, float]], partition_by: list[str] = ()) -> DataFrame:
    """A model of tsmodels fitted to each series, one task per series: (partition_by, name, value), a row per figure of the fit."""
    return per_series(df, [value], order_by, lambda f: pd.DataFrame([(k, float(v)) for k, v in fit(f[value].to_numpy(float)).items()], columns=["name", "value"]), "name string, value double", partition_by)


def hpfilter(df: DataFrame, value: str, order_by: str, lamb: float = 1600.0, partition_by: list[str] = ()) -> DataFrame:
    """(partition_by, order_by, cycle, trend) of the Hodrick-Prescott filter."""
    return filtered(df, value, order_by, lambda x: tsmodels.hpfilter(x, lamb), partition_by)


def bkfilter(df: DataFrame, value: str, order_by: str, low: float = 6, high: float = 32, k: int = 12, partition_by: list[str] = ()) -> DataFrame:
    """(partition_by, order_by, cycle, trend) of Baxter and King's band-pass; NaN for k rows at both ends."""
    return filtered(df, value, order_by, lambda x: tsmodels.bkfilter(x, low, high, k), partition_by)


def cffilter(df: DataFrame, value: str, order_by: str, low: float = 6, high: float = 32, drift: bool = True, partition_by: list[str] = ()) -> DataFrame:
    """(partition_by, order_by, cycle, trend) of Christiano and Fitzgerald's band-pass."""
    return filtered(df, value, order_by, lambda x: tsmodels.cffilter(x, low, high, drift), partition_by)


def filtered(df: DataFrame, value: str, order_by: str, f: Callable, partition_by: list[str]) -> DataFrame:
    kind = df.schema[order_by].dataType.simpleString()

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        cycle, trend = f(frame[value].to_numpy(float))
        return pd.DataFrame({order_by: frame[order_by], "cycle": cycle, "trend": trend})

    return per_series(df, [value], order_by, run, f"{order_by} {kind}, cycle double, trend double", partition_by)


def stl(df: DataFrame, value: str, order_by: str, period: int, seasonal: int = 7, partition_by: list[str] = ()) -> DataFrame:
    """(partition_by, order_by, trend, seasonal, resid) by repeated local regressions."""
    kind = df.schema[order_by].dataType.simpleString()

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        t, s = tsmodels.stl(frame[value].to_numpy(float), period, seasonal)
        return pd.DataFrame({order_by: frame[order_by], "trend": t, "seasonal": s, "resid": frame[value] - t - s})

    return per_series(df, [value], order_by, run, f"{order_by} {kind}, trend double, seasonal double, resid double", partition_by)
