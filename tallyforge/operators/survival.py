"""Survival curves, the log-rank test, cumulative incidence and Cox regression, from counts and sums per distinct time."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyforge.functions import distributions as dist
from tallyforge.operators.formula import design
from tallyforge.operators.likelihood import Estimate, matrix, newton, totals
from tallyforge.operators.series import numbered


def risk_table(df: DataFrame, time: str, status: str, by: list[str] = (), entry: str | None = None, weight: str | None = None) -> DataFrame:
    """(by, t, d events, c rows, n at risk) per distinct time; with entry, rows are at risk after their entry only; with weight, sums of it."""
    w = F.col(weight).cast("double") if weight else F.lit(1)
    kind = "double" if weight else "bigint"
    x = df.where(F.col(time).isNotNull() & F.col(status).isNotNull())
    t = x.groupBy(*by, F.col(time).cast("double").alias("t")).agg(F.sum((F.col(status).cast("int") * w).cast(kind)).alias("d"), F.sum(w.cast(kind)).alias("c"))
    t = t.withColumn("e", F.lit(0).cast(kind))
    if entry:
        late = x.groupBy(*by, F.col(entry).cast("double").alias("t")).agg(F.sum(w.cast(kind)).alias("e")).select(*by, "t", F.lit(0).cast(kind).alias("d"), F.lit(0).cast(kind).alias("c"), "e")
        t = t.unionByName(late).groupBy(*by, "t").agg(*(F.sum(c).alias(c) for c in "dce"))
    # At risk at t: those who leave at t or later, less those who enter at t or later.
    t = t.withColumn("back_", -F.col("t"))
    if by:
        return t.withColumn("n", F.sum(F.col("c") - F.col("e")).over(Window.partitionBy(*by).orderBy("back_").rowsBetween(Window.unboundedPreceding, 0))).drop("e", "back_")
    out = numbered(t, "back_", (), {"n": F.col("c") - F.col("e")}).drop("pos_", "e", "back_")
    return out.withColumn("n", F.col("n").cast(kind))


def kaplan_meier(df: DataFrame, time: str, status: str, entry: str | None = None, weight: str | None = None) -> DataFrame:
    """Survival and Greenwood's standard error after each event time."""
    t = risk_table(df, time, status, (), entry, weight).where("d > 0")
    sums = {
        "lost": F.when(F.col("d") == F.col("n"), 1).otherwise(0),
        "log_s": F.when(F.col("d") < F.col("n"), F.log1p(-F.col("d") / F.col("n"))).otherwise(0.0),
        "g": F.when(F.col("n") > F.col("d"), F.col("d") / (F.col("n").cast("double") * (F.col("n") - F.col("d")))).otherwise(0.0),
    }
    t = numbered(t, "t", (), sums)
    t = t.withColumn("surv", F.when(F.col("lost") >= 1, 0.0).otherwise(F.exp("log_s")))
    return t.select("t", F.col("n").alias("n_risk"), F.col("d").alias("n_events"), "surv", (F.col("surv") * F.sqrt("g")).alias("std_err"))


def survival_quantile(curve: DataFrame, p: float) -> float | None:
    """First time at which a Kaplan-Meier curve is below 1 - p (or at it, then halfway to the next drop); None where it never gets there."""
    below = curve.where(F.col("surv") < 1 - p).agg(F.min("t")).first()[0]
    at = curve.where(F.abs(F.col("surv") - (1 - p)) < 1e-12).agg(F.min("t")).first()[0]
    return below if at is None else at if below is None else (at + below) / 2


def logrank(df: DataFrame, time: str, status: str, group: str, weight: str = "logrank", strata: str | None = None, fh_p: float = 1.0) -> DataFrame:
    """Chi-square of equal survival of two groups or more, within strata. weight: logrank, gehan-breslow (n at risk),
    tarone-ware (its root) or fleming-harrington (survival before t to the power fh_p). NaN for a single group."""
    x = df.where(F.col(time).isNotNull() & F.col(status).isNotNull() & F.col(group).isNotNull())
    names = sorted(r[0] for r in x.select(group).distinct().collect())
    k = len(names)
    stratum = (F.col(strata).cast("string") if strata else F.lit("")).alias("s")
    x = x.select(stratum, F.col(time).cast("double").alias("t"), F.col(status).cast("bigint").alias("e"), *((F.col(group) == F.lit(v)).cast("bigint").alias(f"g{i}") for i, v in enumerate(names)))
    t = x.groupBy("s", "t").agg(F.sum("e").alias("d"), F.count("*").alias("c"), *(f(i) for i in range(k) for f in (lambda i: F.sum(F.col("e") * F.col(f"g{i}")).alias(f"d{i}"), lambda i: F.sum(f"g{i}").alias(f"c{i}"))))
    sums = {"n": F.col("c"), **{f"n{i}": F.col(f"c{i}") for i in range(k)}}
    if strata:
        later = Window.partitionBy("s").orderBy(F.desc("t")).rowsBetween(Window.unboundedPreceding, 0)
        t = t.select("*", *(F.sum(c).over(later).alias(m) for m, c in sums.items())).where("d > 0")
        before = Window.partitionBy("s").orderBy("t").rowsBetween(Window.unboundedPreceding, -1)
        left = F.coalesce(F.sum(F.log1p(-F.least(F.col("d") / F.col("n"), F.lit(1 - 1e-15)))).over(before), F.lit(0.0))
        t = t.withColumn("ls", left)
    else:
        t = numbered(t.withColumn("back_", -F.col("t")), "back_", (), sums).drop("pos_", "back_").where("d > 0")
        drop = F.log1p(-F.least(F.col("d") / F.col("n"), F.lit(1 - 1e-15)))
        t = numbered(t, "t", (), {"ls": drop}).withColumn("ls", F.col("ls") - drop).drop("pos_")
    w = {"logrank": F.lit(1.0), "gehan-breslow": F.col("n").cast("double"), "tarone-ware": F.sqrt("n"), "fleming-harrington": F.exp(fh_p * F.col("ls"))}[weight]
    v = F.when(F.col("n") > 1, F.col("d").cast("double") * (F.col("n") - F.col("d")) / (F.col("n") - 1)).otherwise(0.0) * w * w
    p = lambda i: F.col(f"n{i}") / F.col("n")
    m = k - 1
    row = t.agg(F.count("*"), *(F.sum(w * (F.col(f"d{i}") - F.col("d") * p(i))) for i in range(m)), *(F.sum(v * p(i) * ((1.0 if i == j else 0.0) - p(j))) for i in range(m) for j in range(m))).first()
    schema = "chi2 double, df int, pvalue double"
    if m < 1 or not row[0]:
        return df.sparkSession.createDataFrame([(math.nan, max(m, 0), math.nan)], schema)
    u, cov = np.array(row[1 : m + 1], float), np.array(row[m + 1 :], float).reshape(m, m)
    chi = float(u @ np.linalg.pinv(cov) @ u)
    return df.sparkSession.createDataFrame([(chi, m, float(dist.chi2_sf(chi, m)))], schema)


def cumulative_incidence(df: DataFrame, time: str, cause: str) -> DataFrame:
    """Probability of each cause (above 0; 0 is censored) having happened by each time, with the standard error of a sum of
    independent steps: (cause, t, incidence, std_err)."""
    x = df.where(F.col(time).isNotNull() & F.col(cause).isNotNull()).select(F.col(time).cast("double").alias("t"), F.col(cause).cast("int").alias("k"))
    causes = sorted(r[0] for r in x.where("k > 0").select("k").distinct().collect())
    t = x.groupBy("t").agg(F.count("*").alias("c"), F.count_if(F.col("k") > 0).alias("d"), *(F.count_if(F.col("k") == k).alias(f"d{k}") for k in causes))
    t = numbered(t.withColumn("back_", -F.col("t")), "back_", (), {"n": F.col("c")}).where("d > 0")
    # Counts as doubles: the cube of a bigint overflows beyond two million rows at risk.
    t = t.select("t", *(F.col(c).cast("double").alias(c) for c in ("n", "d", *(f"d{k}" for k in causes))))
    drop = F.log1p(-F.least(F.col("d") / F.col("n"), F.lit(1 - 1e-15)))
    t = numbered(t, "t", (), {"ls": drop}).drop("pos_").withColumn("s", F.exp(F.col("ls") - drop))
    hazard = {f"i{k}": F.col("s") * F.col(f"d{k}") / F.col("n") for k in causes}
    t = numbered(t, "t", (), hazard).drop("pos_")
    # Variance of the incidence at t: three sums over times before, each split into parts that don't depend on t.
    a = F.when(F.col("n") > F.col("d"), F.col("d") / (F.col("n") * (F.col("n") - F.col("d")))).otherwise(0.0)
    parts = {}
    for k in causes:
        i, s, d, n = F.col(f"i{k}"), F.col("s"), F.col(f"d{k}"), F.col("n")
        parts |= {f"a{k}": a, f"b{k}": a * i, f"c{k}": a * i * i, f"e{k}": s * s * (n - d) * d / (n * n * n), f"f{k}": s * d / (n * n), f"h{k}": i * s * d / (n * n)}
    t = numbered(t, "t", (), parts).drop("pos_")
    out = []
    for k in causes:
        i = F.col(f"i{k}")
        var = i * i * F.col(f"a{k}") - 2 * i * F.col(f"b{k}") + F.col(f"c{k}") + F.col(f"e{k}") - 2 * (i * F.col(f"f{k}") - F.col(f"h{k}"))
        out.append(F.struct(F.lit(k).alias("cause"), "t", i.alias("incidence"), F.sqrt(F.greatest(var, F.lit(0.0))).alias("std_err")))
    if not out:
        return df.sparkSession.createDataFrame([], "cause int, t double, incidence double, std_err double")
    return t.select(F.explode(F.array(*out)).alias("r")).select("r.*")


def cox(df: DataFrame, time: str, status: str, formula: str, ties: str = "breslow", strata: str | None = None) -> Estimate:
    """Proportional hazards (formula without response) by Newton's method on the partial likelihood, ties by Breslow or Efron.

    Every step sums exp(x b), its products with x and x x' over the rows of each distinct time, then over later times: two
    aggregates, of which the second runs over distinct times. Rows with a null are left out.
    """
    plan = design(df, formula)
    if plan.names[:1] == ["Intercept"]:
        plan.names, plan.columns = plan.names[1:], plan.columns[1:]
    k = len(plan.names)
    columns = [f"x{i}" for i in range(k)]
    plan.response = F.col(time)
    frame = plan.frame(df, F.col(status).cast("int").alias("e"), (F.col(strata).cast("string") if strata else F.lit("")).alias("s")).persist()
    efron = {"breslow": False, "efron": True}[ties]
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    try:
        n, events, *mean = frame.agg(F.count("*"), F.sum("e"), *(F.avg(c) for c in columns)).first()
        if not n or not events:
            raise ValueError("no event")
        moved = frame.select("y", "e", "s", *((F.col(c) - F.lit(m)).alias(c) for c, m in zip(columns, mean))).persist()

        def at(beta: np.ndarray) -> np.ndarray:
            r = F.exp(F.least(sum((F.lit(float(b)) * F.col(c) for b, c in zip(beta, columns)), F.lit(0.0)), F.lit(600.0)))
            kinds = [("r", r), *((f"r{i}", r * F.col(f"x{i}")) for i in range(k)), *((f"r{i}_{j}", r * F.col(f"x{i}") * F.col(f"x{j}")) for i, j in pairs)]
            own = [F.sum("e").alias("d"), *(F.sum(F.col("e") * F.col(c)).alias(f"u{i}") for i, c in enumerate(columns)), F.sum(F.col("e") * F.log(r)).alias("lr")]
            died = [F.sum(F.col("e") * c).alias(f"d{m}") for m, c in kinds] if efron else []
            t = moved.groupBy("s", "y").agg(*(F.sum(c).alias(m) for m, c in kinds), *own, *died)
            names = [m for m, _ in kinds]
            if strata:
                w = Window.partitionBy("s").orderBy(F.desc("y")).rowsBetween(Window.unboundedPreceding, 0)
                t = t.select("d", "lr", *(f"u{i}" for i in range(k)), *([f"d{m}" for m in names] if efron else []), *(F.sum(m).over(w).alias(f"s{m}") for m in names))
            else:
                t = numbered(t.withColumn("back_", -F.col("y")), "back_", (), {f"s{m}": F.col(m) for m in names})
            t = t.where("d > 0")

            def step(batch: pa.RecordBatch) -> np.ndarray:
                d, lr = matrix(batch, ["d"])[:, 0], matrix(batch, ["lr"])[:, 0]
                u = matrix(batch, [f"u{i}" for i in range(k)])
                s = matrix(batch, [f"s{m}" for m in names])
                q = matrix(batch, [f"d{m}" for m in names]) if efron else None
                value, g, h = lr.sum(), u.sum(0), np.zeros((k, k))
                most = int(d.max()) if efron else 1
                for j in range(most):
                    ok = d > j if efron else np.ones(len(d), bool)
                    times = np.ones(ok.sum()) if efron else d
                    z = s[ok] - (j / d[ok])[:, None] * q[ok] if efron else s
                    first = z[:, 1 : k + 1] / z[:, :1]
                    second = z[:, k + 1 :] / z[:, :1]
                    value -= (times * np.log(z[:, 0])).sum()
                    g = g - times @ first
                    for c, (a, b) in enumerate(pairs):
                        v = (times * (second[:, c] - first[:, a] * first[:, b])).sum()
                        h[a, b] -= v
                        if a != b:
                            h[b, a] -= v
                return np.concatenate([[value], g, h.ravel()])

            return totals(t, step, 1 + k + k * k)

        params, llf, hess, done, rounds = newton(at, np.zeros(k))
        null = at(np.zeros(k))[0]
    finally:
        frame.unpersist()
    out = Estimate(plan.names, params, np.linalg.pinv(-hess, hermitian=True), float(llf), int(n), done, rounds, frame)
    out.stats = {"events": float(events), "llnull": float(null), "llr": 2 * (llf - null), "llr_pvalue": dist.chi2_sf(max(2 * (llf - null), 0.0), k) if k else math.nan}
    return out
