"""Tests about fitted models, agreement, power, proportions and decompositions."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.functions import distributions as dist
from tallyforge.operators import regression
from tallyforge.operators.hypothesis import one, quantiles, tail
from tallyforge.operators.linalg import pinv
from tallyforge.operators.series import numbered, with_lags


def residuals(df: DataFrame, formula: str, name: str = "e_") -> tuple[DataFrame, regression.Fit]:
    """df with the residual of a least-squares fit as one more column, and the fit. Rows that the fit leaves out have none."""
    fit = regression.linear(df, formula)
    return fit.predict(df, "fitted_").withColumn(name, fit.plan.response.cast("double") - F.col("fitted_")), fit


def _lm(fit: regression.Fit) -> dict[str, float]:
    """LM and F statistics of an auxiliary regression."""
    s = fit.stats
    lm = s["nobs"] * s["rsquared"]
    return {"lm": lm, "lm_pvalue": dist.chi2_sf(max(lm, 0.0), s["df_model"]) if s["df_model"] else math.nan, "f": s["fvalue"], "f_pvalue": s["f_pvalue"]}


def het_breuschpagan(df: DataFrame, formula: str) -> DataFrame:
    """Whether squared residuals depend on the regressors."""
    x, _ = residuals(df, formula)
    right = formula.partition("~")[2]
    return one(df, **_lm(regression.linear(x.withColumn("e2_", F.col("e_") * F.col("e_")), f"e2_ ~ {right}")))


def het_white(df: DataFrame, formula: str) -> DataFrame:
    """Whether squared residuals depend on the regressors, their squares and products."""
    x, fit = residuals(df, formula)
    names = [f"z{i}_" for i, n in enumerate(fit.plan.names) if n != "Intercept"]
    x = x.select((F.col("e_") * F.col("e_")).alias("e2_"), *(c.cast("double").alias(f"z{i}_") for i, c in enumerate(fit.plan.columns) if f"z{i}_" in names))
    terms = names + [f"I({a} * {b})" for i, a in enumerate(names) for b in names[i:]]
    return one(df, **_lm(regression.linear(x, "e2_ ~ " + " + ".join(terms))))


def acorr_lm(df: DataFrame, value: str, order_by: str, nlags: int) -> DataFrame:
    """Regression of a series on its lags: LM and F statistics."""
    x = with_lags(df.select(order_by, F.col(value).cast("double").alias("v")), ["v"], order_by, nlags).na.drop("any")
    return one(df, **_lm(regression.linear(x, "v ~ " + " + ".join(f"v_l{k}" for k in range(1, nlags + 1)))))


def het_arch(df: DataFrame, resid: str, order_by: str, nlags: int) -> DataFrame:
    """acorr_lm of squared residuals."""
    return acorr_lm(df.withColumn("sq_", F.col(resid) * F.col(resid)), "sq_", order_by, nlags)


def acorr_breusch_godfrey(df: DataFrame, formula: str, order_by: str, nlags: int) -> DataFrame:
    """Whether residuals depend on their lags beside the regressors; lags before the start are zero."""
    x, fit = residuals(df, formula)
    x = with_lags(x, ["e_"], order_by, nlags)
    x = x.withColumns({f"e__l{k}": F.coalesce(f"e__l{k}", F.lit(0.0)) for k in range(1, nlags + 1)})
    full = regression.linear(x, f"e_ ~ {formula.partition('~')[2]} + " + " + ".join(f"e__l{k}" for k in range(1, nlags + 1)))
    s = full.stats
    lm = s["nobs"] * (1 - s["ssr"] / fit.stats["ssr"])
    f = (fit.stats["ssr"] - s["ssr"]) / nlags / (s["ssr"] / full.df_resid)
    return one(df, lm=lm, lm_pvalue=dist.chi2_sf(max(lm, 0.0), nlags), f=f, f_pvalue=dist.f_sf(f, nlags, full.df_resid))


def linear_reset(df: DataFrame, formula: str, power: int = 3) -> DataFrame:
    """Whether powers of the fitted values (2 to power) add to the fit: F test."""
    x, fit = residuals(df, formula)
    # Powers of standardised fitted values span the same columns and keep their precision.
    m, s = x.agg(F.avg("fitted_"), F.stddev_pop("fitted_")).first()
    x = x.withColumn("f_", (F.col("fitted_") - F.lit(m)) / F.lit(s or 1.0))
    full = regression.linear(x, formula + " + " + " + ".join(f"I(f_ ** {k})" for k in range(2, power + 1)))
    return one(df, **dict(zip(("f", "pvalue", "df_num"), compare_f_test(full, fit))))


def compare_f_test(full: regression.Fit, restricted: regression.Fit) -> tuple[float, float, float]:
    """F, its p-value and the number of restrictions."""
    q = restricted.df_resid - full.df_resid
    f = (restricted.stats["ssr"] - full.stats["ssr"]) / q / (full.stats["ssr"] / full.df_resid)
    return f, dist.f_sf(f, q, full.df_resid), q


def compare_lr_test(full: regression.Fit, restricted: regression.Fit) -> tuple[float, float, float]:
    """Likelihood ratio, its p-value and the number of restrictions."""
    q = restricted.df_resid - full.df_resid
    lr = 2 * (full.stats["llf"] - restricted.stats["llf"])
    return lr, dist.chi2_sf(max(lr, 0.0), q), q


def variance_inflation(df: DataFrame, columns: list[str]) -> DataFrame:
    """1 / (1 - R squared) of every column on the others and a constant, all from one matrix: the diagonal of the inverse correlations."""
    from tallyforge.operators.multivariate import cov2corr, covariance

    inv, _ = pinv(cov2corr(covariance(df, columns)[0])[0])
    return df.sparkSession.createDataFrame([(c, float(v)) for c, v in zip(columns, np.diag(inv))], "term string, vif double")


def anova_lm(df: DataFrame, formula: str, typ: int = 1) -> DataFrame:
    """Sums of squares by term, in order (typ 1) or each after all that don't contain it (typ 2): (term, df, sum_sq, f, pvalue)."""
    from tallyforge.operators.formula import parse

    response, terms, intercept = parse(formula)
    show = lambda ts: f"{response} ~ {' + '.join(':'.join(t) for t in ts) or '1'}{'' if intercept else ' - 1'}"
    full = regression.linear(df, show(terms))
    fits: dict[str, regression.Fit] = {}

    def fit(ts) -> regression.Fit:
        return fits.setdefault(show(ts), full if len(ts) == len(terms) else regression.linear(df, show(ts)))

    rows = []
    for i, t in enumerate(terms):
        before = terms[:i] if typ == 1 else [u for u in terms if not set(t) <= set(u)]
        small, big = fit(before), fit([*before, t])
        q, ss = small.df_resid - big.df_resid, small.stats["ssr"] - big.stats["ssr"]
        f = ss / q / full.stats["scale"] if q else math.nan
        rows.append((":".join(t), float(q), ss, f, dist.f_sf(f, q, full.df_resid) if q else math.nan))
    rows.append(("Residual", float(full.df_resid), full.stats["ssr"], None, None))
    return df.sparkSession.createDataFrame(rows, "term string, df double, sum_sq double, f double, pvalue double")


def oaxaca(df: DataFrame, formula: str, group: str, a, b, weight: float | str = "pooled") -> dict[str, float]:
    """Difference of two groups' means of the response: three_fold parts (endowments, coefficients, interaction) and two_fold (explained,
    unexplained) by pooled coefficients or a weight between the groups' own."""
    fits = [regression.linear(df.where(F.col(group) == F.lit(v)), formula) for v in (a, b)]
    means = []
    for f in fits:
        row = f.frame.agg(F.avg("y"), *(F.avg(f"x{i}") for i in range(len(f.plan.names)))).first()
        means.append((row[0], np.array(row[1:], float)))
    (ya, xa), (yb, xb) = means
    ba, bb = fits[0].params, fits[1].params
    pooled = regression.linear(df.where(F.col(group).isin(a, b)), formula).params if weight == "pooled" else weight * ba + (1 - weight) * bb
    return {
        "gap": ya - yb, "endowments": float((xa - xb) @ bb), "coefficients": float(xb @ (ba - bb)), "interaction": float((xa - xb) @ (ba - bb)),
        "explained": float((xa - xb) @ pooled), "unexplained": float(xa @ (ba - pooled) + xb @ (pooled - bb)),
    }


def proportion_confint(count: float, nobs: float, alpha: float = 0.05, method: str = "normal") -> tuple[float, float]:
    """Interval of a share: normal, wilson, agresti_coull, beta (Clopper and Pearson) or jeffreys."""
    p, z = count / nobs, dist.norm_ppf(1 - alpha / 2)
    if method == "normal":
        h = z * math.sqrt(p * (1 - p) / nobs)
        return max(p - h, 0.0), min(p + h, 1.0)
    if method in ("wilson", "agresti_coull"):
        n = nobs + z * z
        centre = (count + z * z / 2) / n
        h = z * math.sqrt(p * (1 - p) / nobs + z * z / (4 * nobs * nobs)) / (1 + z * z / nobs) if method == "wilson" else z * math.sqrt(centre * (1 - centre) / n)
        return max(centre - h, 0.0), min(centre + h, 1.0)
    from tallyforge.functions.special import betaincinv

    if method == "beta":
        return (betaincinv(count, nobs - count + 1, alpha / 2) if count else 0.0), (betaincinv(count + 1, nobs - count, 1 - alpha / 2) if count < nobs else 1.0)
    if method == "jeffreys":
        return betaincinv(count + 0.5, nobs - count + 0.5, alpha / 2), betaincinv(count + 0.5, nobs - count + 0.5, 1 - alpha / 2)
    raise ValueError(f"method {method} isn't known")


def poisson_2indep(count1: float, exposure1: float, count2: float, exposure2: float, ratio: float = 1.0, method: str = "score", alternative: str = "two-sided") -> tuple[float, float]:
    """Ratio of two rates against a value: score, wald, sqrt, or exact conditional (cond); statistic and p-value."""
    d = exposure2 / exposure1
    r = ratio / d
    if method == "cond":
        law = dist.Binomial(int(count1 + count2), r / (1 + r))
        up, down = law.sf(count1 - 1), law.cdf(count1)
        return math.nan, {"two-sided": min(1.0, 2 * min(up, down)), "larger": up, "smaller": down}[alternative]
    stat = {
        "score": lambda: (count1 - count2 * r) / math.sqrt((count1 + count2) * r),
        "wald": lambda: (count1 - count2 * r) / math.sqrt(count1 + count2 * r * r),
        "sqrt": lambda: 2 * (math.sqrt(count1 + 3 / 8) - math.sqrt((count2 + 3 / 8) * r)) / math.sqrt(1 + r),
    }[method]()
    return stat, tail(stat, alternative, dist.norm_sf)


def aggregate_raters(df: DataFrame, subject: str, category: str) -> DataFrame:
    """Ratings (a row each) to counts by subject and category: (subject, category, n)."""
    return df.where(F.col(category).isNotNull()).groupBy(F.col(subject).alias("subject"), F.col(category).alias("category")).agg(F.count("*").alias("n"))


def fleiss_kappa(counts: DataFrame, method: str = "fleiss") -> float:
    """Agreement of several raters beyond chance from (subject, category, n); method "randolph" takes equal chances. NaN without subjects."""
    by = counts.groupBy("subject").agg(F.sum("n").alias("r"), F.sum(F.col("n") * (F.col("n") - 1)).alias("s")).where("r > 1")
    n, agree = by.agg(F.count("*"), F.avg(F.col("s") / (F.col("r") * (F.col("r") - 1)))).first()
    if not n:
        return math.nan
    shares = counts.groupBy("category").agg(F.sum("n").alias("n"))
    k, total, sq = shares.agg(F.count("*"), F.sum("n"), F.sum(F.col("n") * F.col("n"))).first()
    chance = sq / total**2 if method == "fleiss" else 1 / k
    return (agree - chance) / (1 - chance) if chance < 1 else math.nan


def lilliefors(df: DataFrame, value: str, law: str = "norm") -> DataFrame:
    """Largest distance of the empirical distribution from a normal (or exponential, "exp") of the sample's own mean and deviation, with
    Dallal and Wilkinson's approximate p-value for the normal (NaN above 0.1, where it doesn't hold). From counts of distinct values."""
    x = df.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("x"))
    n, mean, s = x.agg(F.count("*"), F.avg("x"), F.stddev_samp("x")).first()
    if not n or (law == "norm" and not s):
        return one(df, statistic=math.nan, pvalue=math.nan)
    counts = numbered(x.groupBy("x").agg(F.count("*").alias("c")), "x", (), {"upto": F.col("c")})
    d = dist.Normal(mean, s) if law == "norm" else dist.Exponential(1 / mean)
    counts = counts.withColumn("p", dist.column(d, "cdf", "x"))
    stat = counts.agg(F.max(F.greatest(F.col("upto") / n - F.col("p"), F.col("p") - (F.col("upto") - F.col("c")) / n))).first()[0]
    if law != "norm":
        return one(df, statistic=stat, pvalue=math.nan)
    m, k = (n, stat) if n <= 100 else (100, stat * (n / 100) ** 0.49)
    p = math.exp(-7.01256 * k * k * (m + 2.78019) + 2.99587 * k * math.sqrt(m + 2.78019) - 0.122119 + 0.974598 / math.sqrt(m) + 1.67997 / m)
    return one(df, statistic=stat, pvalue=p if p < 0.1 else math.nan)


def nct_cdf(x: float, df: float, nc: float) -> float:
    """Non-central t: normal probabilities integrated over the scale's chi-square density by Gauss and Legendre's points."""
    z, w = np.polynomial.legendre.leggauss(200)
    sd = 1 / math.sqrt(2 * df)
    low, high = max(1e-12, 1 - 10 * sd), 1 + 12 * sd
    s = (high - low) / 2 * z + (low + high) / 2
    logf = math.log(2) + df / 2 * math.log(df / 2) - math.lgamma(df / 2) + (df - 1) * np.log(s) - df * s * s / 2
    return float(min(max((high - low) / 2 * (w * np.exp(logf) * np.asarray(dist.norm_cdf(x * s - nc))).sum(), 0.0), 1.0))


def nct_sf(x: float, df: float, nc: float) -> float:
    return 1 - nct_cdf(x, df, nc)


class TTestPower:
    """Power of a one-sample (or paired) t-test; solve finds the one figure left None."""

    def power(self, effect: float, nobs: float, alpha: float = 0.05, alternative: str = "two-sided") -> float:
        dof, nc = nobs - 1, effect * math.sqrt(nobs)
        if alternative == "two-sided":
            cut = dist.t_isf(alpha / 2, dof)
            return nct_sf(cut, dof, nc) + nct_cdf(-cut, dof, nc)
        cut = dist.t_isf(alpha, dof)
        return nct_sf(cut, dof, nc) if alternative == "larger" else nct_cdf(-cut, dof, nc)

    def solve(self, effect: float | None = None, nobs: float | None = None, alpha: float | None = 0.05, power: float | None = None, alternative: str = "two-sided", **more) -> float:
        given = {"effect": effect, "nobs": nobs, "alpha": alpha, "power": power}
        lacking = [k for k, v in given.items() if v is None]
        if len(lacking) != 1:
            raise ValueError("exactly one figure must be None")
        at = lambda **x: self.power(*(({k: v for k, v in given.items() if k != "power"} | x)[k] for k in ("effect", "nobs", "alpha")), alternative, **more)
        if lacking[0] == "power":
            return at()
        low, high = {"effect": (1e-8, 1e3), "nobs": (2.0001, 1e9), "alpha": (1e-12, 1 - 1e-12)}[lacking[0]]
        return search(lambda v: at(**{lacking[0]: v}) - power, low, high)


class NormalIndPower(TTestPower):
    """Power of a z-test of two independent means; ratio: size of the second sample by that of the first (0: one sample)."""

    def power(self, effect: float, nobs: float, alpha: float = 0.05, alternative: str = "two-sided", ratio: float = 1.0) -> float:
        n = nobs if ratio == 0 else 1 / (1 / nobs + 1 / (nobs * ratio))
        nc = effect * math.sqrt(n)
        if alternative == "two-sided":
            cut = dist.norm_isf(alpha / 2)
            return dist.norm_sf(cut - nc) + dist.norm_cdf(-cut - nc)
        cut = dist.norm_isf(alpha)
        return dist.norm_sf(cut - nc) if alternative == "larger" else dist.norm_cdf(-cut - nc)


def search(f: Callable[[float], float], low: float, high: float) -> float:
    from tallyforge.operators.robust import brentq

    a = low
    while a < high:  # the first doubling at which the sign changes
        b = min(a * 2, high)
        if f(low) * f(b) <= 0:
            return brentq(f, a if f(low) * f(a) > 0 else low, b, 1e-10)
        a = b
    raise ValueError("no figure gives that power")


def distance_statistics(df: DataFrame, x: str, y: str) -> dict[str, float]:
    """Distance covariance, correlation and variances of two columns by sums over sorted values: mean absolute differences of a row from all
    others come from ranks and sums up to it; the mean product of pairs' differences takes all pairs, in blocks of a
    broadcast copy of the (x, y) counts, whose number is checked."""
    c = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).na.drop("any").groupBy("x", "y").agg(F.count("*").alias("c"))
    rows = c.limit(DISTINCT_PAIRS + 1).toPandas().to_numpy(float)
    if len(rows) > DISTINCT_PAIRS:
        raise ValueError(f"more than {DISTINCT_PAIRS} distinct pairs")
    if not len(rows):
        return {k: math.nan for k in ("covariance", "correlation", "variance_x", "variance_y")}
    w = rows[:, 2] / rows[:, 2].sum()

    def means(v: np.ndarray) -> np.ndarray:
        o = np.argsort(v, kind="stable")
        s, p = v[o], np.cumsum(w[o])
        q = np.cumsum(w[o] * s)
        out = np.empty(len(v))
        out[o] = s * p - q + (q[-1] - q) - s * (1 - p)
        return out

    mx, my = means(rows[:, 0]), means(rows[:, 1])
    sxy = sxx = syy = 0.0
    for i in range(0, len(rows), 512):
        a, b = np.abs(rows[i : i + 512, 0, None] - rows[:, 0]), np.abs(rows[i : i + 512, 1, None] - rows[:, 1])
        ww = w[i : i + 512, None] * w
        sxy, sxx, syy = sxy + (ww * a * b).sum(), sxx + (ww * a * a).sum(), syy + (ww * b * b).sum()
    v = lambda s, a, b: max(s + (w @ a) * (w @ b) - 2 * w @ (a * b), 0.0)
    dxy, dxx, dyy = v(sxy, mx, my), v(sxx, mx, mx), v(syy, my, my)
    return {"covariance": math.sqrt(dxy), "correlation": math.sqrt(dxy / math.sqrt(dxx * dyy)) if dxx * dyy > 0 else 0.0, "variance_x": math.sqrt(dxx), "variance_y": math.sqrt(dyy)}


#: The most distinct pairs of values that distance_statistics takes.
DISTINCT_PAIRS = 20_000


def combine(estimates: list[np.ndarray], covariances: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rubin's rules: estimates, covariance and share of missing information of several imputed data sets."""
    q, m = np.array(estimates, float), len(estimates)
    mean, within = q.mean(0), np.mean(covariances, axis=0)
    between = np.cov(q.T, ddof=1).reshape(len(mean), len(mean)) if m > 1 else np.zeros((len(mean), len(mean)))
    total = within + (1 + 1 / m) * between
    return mean, total, (1 + 1 / m) * np.diag(between) / np.diag(total)


def conditional_mean_impute(df: DataFrame, column: str, regressors: list[str]) -> DataFrame:
    """df with nulls of a column replaced by its least-squares mean given the regressors (null where one of those is)."""
    fit = regression.linear(df, f"{column} ~ {' + '.join(regressors)}")
    return fit.predict(df, "mean_").withColumn(column, F.coalesce(F.col(column).cast("double"), F.col("mean_"))).drop("mean_")


def mediation(df: DataFrame, outcome: str, mediator: str, exposure: str) -> dict[str, float]:
    """Linear mediation: direct and indirect effect of the exposure, their sum, the share mediated and Sobel's z and p-value."""
    y, m = regression.linear(df, outcome), regression.linear(df, mediator)
    name = mediator.partition("~")[0].strip()
    a, b, c = m.params[m.plan.names.index(exposure)], y.params[y.plan.names.index(name)], y.params[y.plan.names.index(exposure)]
    sa, sb = m.bse[m.plan.names.index(exposure)], y.bse[y.plan.names.index(name)]
    z = a * b / math.sqrt(a * a * sb * sb + b * b * sa * sa)
    return {"direct": c, "indirect": a * b, "total": c + a * b, "share": a * b / (c + a * b) if c + a * b else math.nan, "z": z, "pvalue": 2 * dist.norm_sf(abs(z))}


def prob_plot(df: DataFrame, value: str, points: int = 1000, a: float = 0.0) -> DataFrame:
    """(p, theoretical, sample): up to points of a normal probability plot, sample quantiles at the plotting positions (i - a) / (n + 1 - 2 a)."""
    n = df.where(F.col(value).isNotNull()).count()
    i = np.unique(np.linspace(1, n, min(points, n)).round()) if n else np.zeros(0)
    p = (i - a) / (n + 1 - 2 * a)
    q = quantiles(df, value, [(k - 1) / (n - 1) if n > 1 else 0.5 for k in i])
    return df.sparkSession.createDataFrame([(float(x), dist.norm_ppf(float(x)), float(v)) for x, v in zip(p, q)], "p double, theoretical double, sample double")
