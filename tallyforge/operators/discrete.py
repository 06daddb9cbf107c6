"""Discrete-choice, count and related likelihood models over formulas; every one is a log-likelihood of a row."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.functions import distributions as dist
from tallyforge.functions import special as sp
from tallyforge.operators import summaries
from tallyforge.operators.formula import design
from tallyforge.operators.likelihood import Estimate, fit, matrix, newton, totals


def log_expit(x):
    return -np.logaddexp(0, -x)


def log_norm_cdf(x):
    """Logarithm of the normal distribution function; the far tail by its asymptotic series."""
    x = np.asarray(x, float)
    near = np.maximum(x, -30)
    far = -0.5 * x * x - np.log(np.maximum(-x, 1)) - 0.5 * math.log(2 * math.pi) + np.log1p(-1 / np.maximum(x * x, 1) + 3 / np.maximum(x**4, 1))
    return np.where(x > -30, np.log(np.maximum(np.asarray(dist.norm_cdf(near)), 1e-300)), far)


def poisson_ll(y, eta):
    return y * eta - np.exp(eta) - sp.lgamma(y + 1)


def negbin_ll(y, eta, log_alpha):
    a = np.exp(log_alpha)
    m = a * np.exp(eta)
    return sp.lgamma(y + 1 / a) - sp.lgamma(1 / a) - sp.lgamma(y + 1) + y * (np.log(m) - np.log1p(m)) - np.log1p(m) / a


def prepared(df: DataFrame, formula: str, valid: str | None = None, what: str = ""):
    """Design, frame, number of rows and mean of y; a ValueError if rows break the condition valid."""
    plan = design(df, formula)
    frame = plan.frame(df)
    bad = F.count_if(~F.expr(valid)) if valid else F.lit(0)
    n, mean, wrong, var = frame.agg(F.count("*"), F.avg("y"), bad, F.var_samp("y")).first()
    if not n:
        raise ValueError("no complete row")
    if wrong:
        raise ValueError(f"{wrong} rows have a response that isn't {what}")
    return plan, frame, n, mean, var


def first_params(plan, value: float) -> np.ndarray:
    return np.array([value if name == "Intercept" else 0.0 for name in plan.names])


def with_null(result: Estimate, null: float) -> Estimate:
    result.stats |= {"llnull": null, "pseudo_rsquared": 1 - result.llf / null if null else math.nan, "llr": 2 * (result.llf - null)}
    k = len(result.params) - 1
    result.stats["llr_pvalue"] = dist.chi2_sf(max(result.stats["llr"], 0.0), k) if k > 0 else math.nan
    return result


COUNT = "y >= 0 and y = floor(y)", "a count"
BINARY = "y in (0, 1)", "0 or 1"


def logit(df: DataFrame, formula: str) -> Estimate:
    """Binary logit."""
    plan, frame, n, mean, _ = prepared(df, formula, *BINARY)
    k = list(range(len(plan.names)))
    p = min(max(mean, 1e-9), 1 - 1e-9)
    out = fit(frame, lambda y, v: log_expit((2 * y - 1) * v[:, 0]), [k], first_params(plan, math.log(p / (1 - p))), plan.names, n)
    return with_null(out, n * (p * math.log(p) + (1 - p) * math.log(1 - p)))


def probit(df: DataFrame, formula: str) -> Estimate:
    """Binary probit."""
    plan, frame, n, mean, _ = prepared(df, formula, *BINARY)
    k = list(range(len(plan.names)))
    p = min(max(mean, 1e-9), 1 - 1e-9)
    out = fit(frame, lambda y, v: log_norm_cdf((2 * y - 1) * v[:, 0]), [k], first_params(plan, dist.norm_ppf(p)), plan.names, n)
    return with_null(out, n * (p * math.log(p) + (1 - p) * math.log(1 - p)))


def poisson(df: DataFrame, formula: str) -> Estimate:
    """Poisson counts, log link."""
    plan, frame, n, mean, _ = prepared(df, formula, *COUNT)
    k = list(range(len(plan.names)))
    out = fit(frame, lambda y, v: poisson_ll(y, v[:, 0]), [k], first_params(plan, math.log(max(mean, 1e-9))), plan.names, n)
    gammas = totals(frame.select("y"), lambda b: np.array([np.sum(sp.lgamma(matrix(b, ["y"])[:, 0] + 1))]), 1)[0]
    return with_null(out, n * mean * math.log(mean) - n * mean - gammas if mean else 0.0)


def negative_binomial(df: DataFrame, formula: str) -> Estimate:
    """Counts of variance mu + alpha mu^2; the last coefficient is alpha itself."""
    plan, frame, n, mean, var = prepared(df, formula, *COUNT)
    k = list(range(len(plan.names)))
    start = np.append(first_params(plan, math.log(max(mean, 1e-9))), math.log(max((var - mean) / max(mean, 1e-9) ** 2, 0.05)))
    out = fit(frame, lambda y, v: negbin_ll(y, v[:, 0], v[:, 1]), [k, None], start, [*plan.names, "alpha"], n)
    return exponentiated(out, -1)


def exponentiated(out: Estimate, at: int) -> Estimate:
    """A coefficient that was fitted as logarithm, as itself, with its standard error by the delta method."""
    a = math.exp(out.params[at])
    out.params[at] = a
    out.cov[at, :] *= a
    out.cov[:, at] *= a
    return out


def generalized_poisson(df: DataFrame, formula: str, p: int = 1) -> Estimate:
    """Counts of generalised Poisson type: variance mu (1 + alpha mu^(p - 1))^2; the last coefficient is alpha."""
    plan, frame, n, mean, _ = prepared(df, formula, *COUNT)
    k = list(range(len(plan.names)))

    def ll(y, v):
        mu, alpha = np.exp(v[:, 0]), v[:, 1]
        b = 1 + alpha * mu ** (p - 1)
        a = mu + alpha * mu ** (p - 1) * y
        value = np.log(mu) + (y - 1) * np.log(np.where(a > 0, a, np.nan)) - y * np.log(np.where(b > 0, b, np.nan)) - a / b - sp.lgamma(y + 1)
        return np.where(np.isnan(value), -1e10, value)

    return fit(frame, ll, [k, None], np.append(first_params(plan, math.log(max(mean, 1e-9))), 0.05), [*plan.names, "alpha"], n)


def truncated_poisson(df: DataFrame, formula: str) -> Estimate:
    """Poisson counts of which zeros can't be seen."""
    plan, frame, n, mean, _ = prepared(df, formula, "y >= 1 and y = floor(y)", "a count above zero")
    k = list(range(len(plan.names)))
    return fit(frame, lambda y, v: truncated_ll(y, v[:, 0]), [k], first_params(plan, math.log(mean)), plan.names, n)


def truncated_ll(y, eta):
    mu = np.exp(eta)
    return y * eta - mu - sp.lgamma(y + 1) - np.log(-np.expm1(-mu))


def zero_inflated_poisson(df: DataFrame, formula: str, inflation: str = "1") -> Estimate:
    """Counts that are zero by a logit of the inflation terms, and Poisson otherwise; inflation's coefficients come first."""
    both = joint(df, formula, inflation)
    plan, frame, n, mean, k, m = both

    def ll(y, v):
        return np.where(y == 0, np.logaddexp(log_expit(v[:, 0]), log_expit(-v[:, 0]) - np.exp(v[:, 1])), log_expit(-v[:, 0]) + poisson_ll(y, v[:, 1]))

    names = [f"inflate_{x}" for x in plan.names[k:]] + plan.names[:k]
    start = np.concatenate([np.zeros(m), first_params_of(plan.names[:k], math.log(max(mean, 1e-9)) + 0.1)])
    return fit(frame, ll, [list(range(k, k + m)), list(range(k))], start, names, n)


def first_params_of(names: list[str], value: float) -> np.ndarray:
    return np.array([value if x == "Intercept" else 0.0 for x in names])


def joint(df: DataFrame, formula: str, second: str, valid: tuple[str, str] | None = COUNT):
    """A design of two sets of terms: (plan, frame, n, mean, columns of the first, of the second)."""
    plan, other = design(df, formula), design(df, f"{formula.partition('~')[0]} ~ {second}")
    k, m = len(plan.names), len(other.names)
    plan.names, plan.columns = plan.names + other.names, plan.columns + other.columns
    frame = plan.frame(df)
    n, mean, wrong = frame.agg(F.count("*"), F.avg("y"), F.count_if(~F.expr(valid[0]))).first()
    if not n:
        raise ValueError("no complete row")
    if wrong:
        raise ValueError(f"{wrong} rows have a response that isn't {valid[1]}")
    return plan, frame, n, mean, k, m


def hurdle_poisson(df: DataFrame, formula: str, zero: str | None = None) -> Estimate:
    """Zero or not by a Poisson of its own (the hurdle), counts above zero by a truncated Poisson. The hurdle's coefficients come first."""
    right = formula.partition("~")[2]
    plan, frame, n, mean, k, m = joint(df, formula, zero or right)

    def ll(y, v):
        jump = np.exp(v[:, 0])
        return np.where(y == 0, -jump, np.log(-np.expm1(-jump)) + truncated_ll(np.maximum(y, 1), v[:, 1]))

    names = [f"zero_{x}" for x in plan.names[k:]] + plan.names[:k]
    start = np.concatenate([np.zeros(m), first_params_of(plan.names[:k], math.log(max(mean, 1e-9)) + 0.1)])
    return fit(frame, ll, [list(range(k, k + m)), list(range(k))], start, names, n)


def mnlogit(df: DataFrame, formula: str) -> Estimate:
    """Multinomial logit: a linear predictor for each level of the response but the first in order; rows of the levels that the
    response takes (any type that sorts). Coefficients are named level:term."""
    left, _, right = formula.partition("~")
    levels = sorted(r[0] for r in df.select(F.expr(left).alias("v")).where("v is not null").distinct().collect())
    if len(levels) < 2:
        raise ValueError("the response needs two levels or more")
    index = F.expr(left)
    code = F.when(index == F.lit(levels[0]), 0)
    for i, v in enumerate(levels[1:], 1):
        code = code.when(index == F.lit(v), i)
    plan, frame, n, _, _ = prepared(df.withColumn("level_code__", code), f"level_code__ ~ {right}")
    k, j = list(range(len(plan.names))), len(levels) - 1

    def ll(y, v):
        top = np.maximum(v.max(1), 0)
        norm = top + np.log(np.exp(-top) + np.exp(v - top[:, None]).sum(1))
        return np.where(y > 0, v[np.arange(len(y)), np.maximum(y.astype(int) - 1, 0)], 0.0) - norm

    names = [f"{v}:{x}" for v in levels[1:] for x in plan.names]
    return fit(frame, ll, [k] * j, np.zeros(j * len(k)), names, n)


def ordered(df: DataFrame, formula: str, distr: str = "probit") -> Estimate:
    """Ordered logit or probit without intercept: coefficients, then the first threshold and the logarithms of the steps between
    thresholds (exp of those, summed, gives the others)."""
    left, _, right = formula.partition("~")
    levels = sorted(r[0] for r in df.select(F.expr(left).alias("v")).where("v is not null").distinct().collect())
    if len(levels) < 2:
        raise ValueError("the response needs two levels or more")
    code = F.when(F.expr(left) == F.lit(levels[0]), 0)
    for i, v in enumerate(levels[1:], 1):
        code = code.when(F.expr(left) == F.lit(v), i)
    # As in a model with intercept, categories lose a level; the intercept itself is then left out.
    plan = design(df.withColumn("level_code__", code), f"level_code__ ~ {right}")
    if plan.names[:1] == ["Intercept"]:
        plan.names, plan.columns = plan.names[1:], plan.columns[1:]
    frame = plan.frame(df.withColumn("level_code__", code))
    counts = {int(r[0]): r[1] for r in frame.groupBy("y").count().collect()}
    n, j, k = sum(counts.values()), len(levels) - 1, list(range(len(plan.names)))
    quantile, cdf = {"probit": (dist.norm_ppf, lambda x: np.asarray(dist.norm_cdf(x))), "logit": (lambda p: math.log(p / (1 - p)), lambda x: 1 / (1 + np.exp(-x)))}[distr]
    cuts = [quantile(min(max(sum(counts.get(c, 0) for c in range(i + 1)) / n, 1e-6), 1 - 1e-6)) for i in range(j)]
    start = np.concatenate([np.zeros(len(k)), [cuts[0]], [math.log(max(b - a, 1e-3)) for a, b in zip(cuts, cuts[1:])]])

    def ll(y, v):
        eta, steps = v[:, :1], v[:, 1:]
        at = np.cumsum(np.column_stack([steps[:, :1], np.exp(steps[:, 1:])]), axis=1) - eta
        bounds = np.column_stack([np.full(len(y), -np.inf), at, np.full(len(y), np.inf)])
        i = y.astype(int)
        rows = np.arange(len(y))
        low, high = bounds[rows, i], bounds[rows, i + 1]
        flip = low > 0  # take differences where the function is small
        p = np.where(flip, cdf(-low) - cdf(-high), cdf(high) - cdf(low))
        return np.log(np.maximum(p, 1e-300))

    if k:
        return fit(frame, ll, [k, *[None] * j], start, [*plan.names, *(f"{a}/{b}" for a, b in zip(levels, levels[1:]))], n)
    frame = frame.withColumn("x0", F.lit(0.0))
    return fit(frame, lambda y, v: ll(y, np.column_stack([np.zeros(len(y)), v])), [None] * j, start, [f"{a}/{b}" for a, b in zip(levels, levels[1:])], n)


def beta_regression(df: DataFrame, formula: str, precision: str = "1") -> Estimate:
    """Shares between 0 and 1 with a logit mean and a log precision; the precision's coefficients come last."""
    plan, frame, n, mean, k, m = joint(df, formula, precision, ("y > 0 and y < 1", "between 0 and 1"))

    def ll(y, v):
        mu, phi = 1 / (1 + np.exp(-v[:, 0])), np.exp(v[:, 1])
        a, b = mu * phi, (1 - mu) * phi
        return sp.lgamma(phi) - sp.lgamma(a) - sp.lgamma(b) + (a - 1) * np.log(y) + (b - 1) * np.log1p(-y)

    names = plan.names[:k] + [f"precision_{x}" for x in plan.names[k:]]
    start = np.concatenate([first_params_of(plan.names[:k], math.log(mean / (1 - mean))), first_params_of(plan.names[k:], 1.0)])
    return fit(frame, ll, [list(range(k)), list(range(k, k + m))], start, names, n)


def conditional(df: DataFrame, formula: str, group: str, kind: str = "logit") -> Estimate:
    """Logit or Poisson given each group's total, which takes out a group's own level. Columns that don't vary within groups, the
    intercept among them, aren't identified and are left out; so are groups that say nothing (all or none for the logit).

    Every group is one unit of the likelihood: its rows meet in one task. For the logit the sum over all ways to place
    the ones is found by recursion over the group's rows, not by listing them.
    """
    plan = design(df, formula)
    if plan.names[:1] == ["Intercept"]:
        plan.names, plan.columns = plan.names[1:], plan.columns[1:]
    k = len(plan.names)
    columns = [f"x{i}" for i in range(k)]
    frame = plan.frame(df, F.col(group).alias("g_"))
    if frame.where(F.expr(f"not ({BINARY[0] if kind == 'logit' else COUNT[0]})")).limit(1).count():
        raise ValueError("the response doesn't suit the model")
    packed = frame.groupBy("g_").agg(F.collect_list(F.array("y", *columns)).alias("rows"), F.sum("y").alias("t"), F.count("*").alias("n"))
    packed = packed.where("t > 0 and t < n and n > 1" if kind == "logit" else "t > 0 and n > 1").select("rows", "n").persist()

    def at(params: np.ndarray) -> np.ndarray:
        def one(batch: pa.RecordBatch) -> np.ndarray:
            total = np.zeros(1 + k + k * k)
            for cell in batch.column("rows"):
                z = np.array(cell.as_py(), float)
                y, x = z[:, 0], z[:, 1:]
                total += (conditional_logit if kind == "logit" else conditional_poisson)(y, x, params)
            return total

        return totals(packed, one, 1 + k + k * k)

    try:
        nobs = packed.agg(F.sum("n")).first()[0] or 0
        if not nobs:
            raise ValueError("no group says anything")
        params, llf, hess, done, rounds = newton(at, np.zeros(k))
    finally:
        packed.unpersist()
    return Estimate(plan.names, params, np.linalg.pinv(-hess, hermitian=True), float(llf), int(nobs), done, rounds, frame)


def conditional_logit(y, x, b):
    """Value, gradient and Hessian of one group: log of the recursion f(t) over rows, with its derivatives by the coefficients."""
    k, t = x.shape[1], int(y.sum())
    e = x @ b
    shift = e.max()
    w = np.exp(e - shift)
    f, g, h = np.zeros(t + 1), np.zeros((t + 1, k)), np.zeros((t + 1, k, k))
    f[0] = 1.0
    for wi, xi in zip(w, x):
        outer = np.einsum("i,tj->tij", xi, g[:-1])
        h[1:] += wi * (h[:-1] + outer + outer.transpose(0, 2, 1) + np.multiply.outer(f[:-1], np.outer(xi, xi)))
        g[1:] += wi * (g[:-1] + np.multiply.outer(f[:-1], xi))
        f[1:] += wi * f[:-1]
        top = f.max()
        if top > 1e100:
            f, g, h = f / top, g / top, h / top
            shift += math.log(top) / t
    mean = g[t] / f[t]
    return np.concatenate([[y @ e - math.log(f[t]) - shift * t], y @ x - mean, -(h[t] / f[t] - np.outer(mean, mean)).ravel()])


def conditional_poisson(y, x, b):
    e = x @ b
    p = np.exp(e - e.max())
    p /= p.sum()
    n, mean = y.sum(), p @ x
    return np.concatenate([[y @ e - n * (math.log(np.exp(e - e.max()).sum()) + e.max())], y @ x - n * mean, -n * ((x.T * p) @ x - np.outer(mean, mean)).ravel()])


def summary(result: Estimate, response: str, model: str) -> str:
    return summaries.estimate(result, response, model)
