"""Models against numpy, published figures and each other; degenerate input."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyforge.functions import distributions as dist
from tallyforge.functions import special
from tallyforge.operators import autoregression, charts, diagnostics, discrete, glm, grouped, hypothesis, linalg, multivariate, regression, robust, series, smooth, survival, tsmodels

FAMILIES = [
    dist.Normal(1, 2), dist.StudentT(4), dist.ChiSquared(3), dist.FDist(3, 9), dist.Gamma(2.5, 0.7), dist.Beta(2, 3), dist.Exponential(0.5), dist.LogNormal(0.1, 0.6), dist.Uniform(-1, 2), dist.WeibullMin(1.5, 2),
    dist.Laplace(1, 0.5), dist.Logistic(0.5, 2), dist.Cauchy(0, 1), dist.Pareto(3, 2),
]
COUNTS = [dist.Poisson(3.3), dist.Binomial(9, 0.35), dist.Geometric(0.3), dist.NegativeBinomial(2.5, 0.4)]


@pytest.mark.parametrize("law", FAMILIES, ids=lambda d: type(d).__name__)
def test_continuous_families(law):
    p = np.array([1e-9, 0.01, 0.3, 0.45, 0.9, 0.999])
    x = law.ppf(p)
    assert np.allclose(law.cdf(x), p, rtol=1e-9) and np.allclose(law.sf(x), 1 - p, rtol=1e-9) and np.allclose(law.sf(law.isf(p)), p, rtol=1e-9)
    h = 1e-5 * (1 + np.abs(x[1:-1]))
    assert np.allclose((law.cdf(x[1:-1] + h) - law.cdf(x[1:-1] - h)) / (2 * h), law.pdf(x[1:-1]), rtol=1e-5)
    assert np.isnan(law.ppf(1.5)) and isinstance(law.pdf(0.5), float)


@pytest.mark.parametrize("law", COUNTS, ids=lambda d: type(d).__name__)
def test_count_families(law):
    k = np.arange(0, 200.0)
    pmf = law.pmf(k)
    assert math.isclose(pmf.sum(), 1, rel_tol=1e-9) and np.allclose(np.cumsum(pmf), law.cdf(k), atol=1e-10) and np.allclose(law.sf(k), 1 - law.cdf(k), atol=1e-10)
    assert math.isclose((k * pmf).sum(), law.mean(), rel_tol=1e-8) and math.isclose((k * k * pmf).sum() - law.mean() ** 2, law.var(), rel_tol=1e-7)
    for p in (0.05, 0.5, 0.95):
        q = law.ppf(p)
        assert law.cdf(q) >= p > law.cdf(q - 1)
    assert law.pmf(2.5) == 0 and law.pmf(-1) == 0


def test_special_functions_and_bad_parameters():
    assert math.isclose(special.digamma(0.5), -1.9635100260214235, rel_tol=1e-12) and math.isclose(special.gamma(-1.5), 2.3632718012073544, rel_tol=1e-12)
    assert math.isclose(special.gammaincc(2.5, 3.0), math.erfc(math.sqrt(3)) + 2 * math.exp(-3) / math.sqrt(2 * math.pi) * (math.sqrt(6) + 6**1.5 / 3), rel_tol=1e-12) and math.isclose(special.betainc(2, 3, 0.4), 0.5248, rel_tol=1e-12)
    assert math.isclose(special.erfinv(0.5), 0.4769362762044699, rel_tol=1e-12) and math.isclose(special.gammaincinv(3, special.gammainc(3, 2.2)), 2.2, rel_tol=1e-9)
    for bad in (lambda: dist.Normal(0, 0), lambda: dist.Binomial(3, 2), lambda: dist.Geometric(0), lambda: dist.Uniform(1, 1)):
        with pytest.raises(ValueError):
            bad()
    step = dist.StepFunction([1, 2], [10, 20])
    assert [step(v) for v in (0.5, 1, 1.5, 2)] == [0, 10, 10, 20] and dist.Ecdf([1, 2, 2, 4])(2) == 0.75 and dist.Ecdf([1, 2, 2, 4], "left")(2) == 0.25


def test_linear_algebra_and_optimisers():
    a = np.array([[4.0, 1, 2], [1, 3, 0], [2, 0, 5]])
    assert math.isclose(linalg.det(a), np.linalg.det(a)) and np.allclose(linalg.inv(a) @ a, np.eye(3)) and np.allclose(linalg.cholesky_solve(a, [1, 2, 3]), np.linalg.solve(a, [1, 2, 3]))
    assert linalg.matrix_rank([[1, 2], [2, 4]]) == 1 and linalg.lstsq_qr([[1, 2], [2, 4], [3, 6]], [1, 2, 3]) is None
    for bad in (lambda: linalg.inv([[1, 2], [2, 4]]), lambda: linalg.cholesky([[1, 2], [2, 1]])):
        with pytest.raises(linalg.Singular):
            bad()
    found = linalg.minimize_bfgs([-1.2, 1.0], lambda p: (1 - p[0]) ** 2 + 100 * (p[1] - p[0] ** 2) ** 2)
    assert found.converged and np.allclose(found.x, 1, atol=1e-4)
    assert math.isclose(robust.brentq(math.cos, 1, 2), math.pi / 2) and math.isclose(robust.fminbound(lambda v: (v - 1) ** 4, 0, 3, 1e-6), 1, abs_tol=1e-2)


def test_series_models():
    rng = np.random.default_rng(0)
    x = np.cumsum(rng.normal(size=80))
    d = np.diff(np.eye(80), 2, axis=0)
    assert np.allclose(tsmodels.hpfilter(x, 1600)[1], np.linalg.solve(np.eye(80) + 1600 * d.T @ d, x))
    assert np.allclose(tsmodels.arma_acovf([1, -0.5], [1, 0.4], 4), [1 + 0.9**2 / 0.75, *(0.5**k * (0.9 * 1.2 / 0.75) for k in range(3))])
    season = np.tile([1.0, 2, 3, 4], 20)
    t, s = tsmodels.stl(season + np.arange(80) * 0.1, 4)
    assert np.allclose(s, np.tile([-1.5, -0.5, 0.5, 1.5], 20), atol=0.05) and np.allclose(np.diff(t), 0.1, atol=0.02)
    assert np.allclose(tsmodels.smooth(season + np.arange(80) * 0.1, True, "add", 4).forecast(2), [9, 10.1], atol=0.01)
    y = np.zeros(150)
    for i in range(1, 150):
        y[i] = 0.7 * y[i - 1] + rng.normal()
    fit = tsmodels.sarimax(y, tsmodels.SarimaxOrder(1, 0, 0))
    full = 0.5 * math.log(1 - fit.params["ar.L1"] ** 2) - 75 * math.log(2 * math.pi * fit.params["sigma2"]) - ((1 - fit.params["ar.L1"] ** 2) * y[0] ** 2 + ((y[1:] - fit.params["ar.L1"] * y[:-1]) ** 2).sum()) / (2 * fit.params["sigma2"])
    assert math.isclose(fit.llf, full, rel_tol=1e-8) and abs(fit.params["ar.L1"] - 0.7) < 0.2
    z = np.concatenate([rng.normal(0, 1, 60), rng.normal(6, 1, 60)])
    m = tsmodels.markov_regression(z, 2)
    assert abs(m.params["const[0]"]) < 0.5 and abs(m.params["const[1]"] - 6) < 0.5 and (m.extra["smoothed"][:55, 0] > 0.9).all()
    space = tsmodels.unobserved_space(False, 0, np.array([1.0, 0.5]))
    full, part = space.filter(np.where(np.arange(80) == 40, np.nan, x)), space.smooth(x)
    assert np.isfinite(full["loglike"]) and part.shape == (80, 1)


def test_published_figures():
    assert math.isclose(diagnostics.TTestPower().solve(effect=0.5, power=0.8), 33.3671, rel_tol=1e-4) and math.isclose(diagnostics.NormalIndPower().solve(effect=0.5, power=0.8), 62.791, rel_tol=1e-4)
    assert math.isclose(hypothesis.srange_ppf(0.95, 3, 20), 3.5779, rel_tol=1e-4) and math.isclose(hypothesis.srange_sf(3.5779, 3, 20), 0.05, rel_tol=1e-3)
    assert np.allclose(diagnostics.proportion_confint(10, 30, method="wilson"), (0.19230, 0.51220), atol=1e-5) and np.allclose(diagnostics.proportion_confint(10, 30, method="beta"), (0.17287, 0.52812), atol=1e-5)
    assert math.isclose(diagnostics.poisson_2indep(60, 51477.5, 30, 54308.7)[0], 3.417402, rel_tol=1e-6)
    assert math.isclose(smooth.bvn_cdf(0, 0, 0.5), 1 / 3, rel_tol=1e-12) and math.isclose(smooth.copula_theta("frank", 0.2), 1.860884, rel_tol=1e-4)
    c = multivariate.corr_nearest(np.array([[1, 0.9, 0.2], [0.9, 1, 0.9], [0.2, 0.9, 1]]))
    assert np.linalg.eigvalsh(c).min() > -1e-12 and np.allclose(np.diag(c), 1)


def test_charts():
    f = charts.Figure(rows=1, cols=2)
    f.axes[0].plot([1, 2, 3], [1, 4, 9], label="a<b").scatter([1, 2], [3, 4]).bar([1, 2], [1, 2]).errorbar([1], [2], 0.5).axhline(1).axvspan(1, 2).annotate("x & y", 1, 1).legend().set(title="T", ylog=True)
    f.axes[1].boxplot([charts.BoxStats.of([1, 2, 3, 4, 100])]).violinplot([charts.ViolinShape.of([1, 2, 3])]).heatmap([[1, 2], [3, 4]])
    assert "a&lt;b" in f.svg() and "x &amp; y" in f.svg() and charts.Figure().svg().endswith("</svg>") and charts.Axes().is_empty
    assert charts.nice_ticks(0, 10) == [0, 2, 4, 6, 8, 10] and charts.fmt_tick(1e7) == "1e+07" and charts.Color.parse("#fff").hex == "#ffffff"


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(3)
    n = 400
    a, b, g = rng.normal(size=n), rng.normal(size=n), rng.integers(0, 8, n)
    eta = 0.3 + 0.5 * a - 0.4 * b
    y = 1 + 2 * a - b + rng.normal(size=n) + rng.normal(size=8)[g]
    counts, ones = rng.poisson(np.exp(eta)), (rng.random(n) < 1 / (1 + np.exp(-eta))).astype(int)
    frame = spark.createDataFrame([(i, *map(float, (p, q, v)), int(c), int(o), int(k)) for i, (p, q, v, c, o, k) in enumerate(zip(a, b, y, counts, ones, g))], "i int, a double, b double, y double, c int, o int, g int").persist()
    return frame, np.column_stack([np.ones(n), a, b]), y, counts, ones, g


def newton(score, information, k):
    beta = np.zeros(k)
    for _ in range(60):
        beta = beta + np.linalg.solve(information(beta), score(beta))
    return beta, np.sqrt(np.diag(np.linalg.inv(information(beta))))


def test_likelihood_models_equal_newton(data):
    frame, x, _, counts, ones, _ = data
    mu = lambda b: np.exp(x @ b)
    want = newton(lambda b: x.T @ (counts - mu(b)), lambda b: (x.T * mu(b)) @ x, 3)
    for fit in (discrete.poisson(frame, "c ~ a + b"), glm.glm(frame, "c ~ a + b", "poisson")):
        assert np.allclose(fit.params, want[0], rtol=1e-6, atol=1e-7) and np.allclose(fit.bse, want[1], rtol=1e-5)
    p = lambda b: 1 / (1 + np.exp(-x @ b))
    want = newton(lambda b: x.T @ (ones - p(b)), lambda b: (x.T * (p(b) * (1 - p(b)))) @ x, 3)
    fit = discrete.logit(frame, "o ~ a + b")
    assert fit.converged and np.allclose(fit.params, want[0], rtol=1e-6, atol=1e-7) and np.allclose(fit.bse, want[1], rtol=1e-5)
    probit, other = discrete.probit(frame, "o ~ a + b"), glm.glm(frame, "o ~ a + b", "binomial", "probit")
    assert np.allclose(probit.params, other.params, rtol=1e-4, atol=1e-5) and math.isclose(probit.llf, other.stats["llf"], rel_tol=1e-7)
    two = discrete.mnlogit(frame, "o ~ a + b")
    assert np.allclose(two.params, fit.params, rtol=1e-5, atol=1e-6)
    assert np.allclose(discrete.ordered(frame, "o ~ a + b", "logit").params[:2], fit.params[1:], rtol=1e-4)
    negbin = discrete.negative_binomial(frame, "c ~ a + b")
    assert negbin.params[-1] > 0 and negbin.llf >= discrete.poisson(frame, "c ~ a + b").llf - 1.0
    with pytest.raises(ValueError):
        discrete.logit(frame, "c ~ a")
    with pytest.raises(ValueError):
        discrete.poisson(frame.limit(0), "c ~ a")


def test_robust_quantile_and_grouped_models(data):
    frame, x, y, _, _, g = data
    ols = np.linalg.lstsq(x, y, rcond=None)[0]
    assert np.allclose(robust.rlm(frame, "y ~ a + b", "ls").params, ols, rtol=1e-6)
    assert np.allclose(robust.rlm(frame, "y ~ a + b", "huber").params, ols, atol=0.2)
    q = regression.quantreg(frame.coalesce(1), "y ~ a + b", 0.5, rounds=40)
    below = np.mean(y < x @ q.params)
    assert abs(below - 0.5) < 0.04
    same = (g[:, None] == g).astype(float)
    inverse = lambda r: np.eye(400) - same * (r / (1 + r * same.sum(1)))  # noqa: E731  of I + r same
    vi = inverse(0.8)
    gls = regression.gls(frame, "y ~ a + b", np.eye(400) + 0.8, "i", ["g"])
    assert np.allclose(gls.params, np.linalg.solve(x.T @ vi @ x, x.T @ vi @ y), rtol=1e-8)
    mixed = grouped.mixed(frame, "y ~ a + b", "g")
    ratio = mixed.random_cov[0, 0] / mixed.scale
    vi = inverse(ratio)
    assert np.allclose(mixed.params, np.linalg.solve(x.T @ vi @ x, x.T @ vi @ y), rtol=1e-6) and 0.1 < ratio < 10
    fit, rho = grouped.gee(frame, "y ~ a + b", "g")
    assert np.allclose(fit.params, mixed.params, atol=0.1) and 0 < rho < 1
    assert np.allclose(diagnostics.variance_inflation(frame, ["a", "b"]).toPandas()["vif"], 1 / (1 - np.corrcoef(x[:, 1], x[:, 2])[0, 1] ** 2))
    assert "R-squared" in regression.linear(frame, "y ~ a + b").summary()


def test_survival_models(spark):
    rng = np.random.default_rng(5)
    t, z = np.ceil(rng.exponential(5, 120)), rng.normal(size=120)
    e = (rng.random(120) < 0.7).astype(int)
    frame = spark.createDataFrame([(float(a), int(b), float(c)) for a, b, c in zip(t, e, z)], "t double, e int, z double")

    def loglike(b, efron):
        total = 0.0
        for u in np.unique(t[e == 1]):
            risk, died = np.exp(b * z[t >= u]).sum(), np.exp(b * z[(t == u) & (e == 1)])
            total += b * z[(t == u) & (e == 1)].sum() - sum(math.log(risk - (j / len(died) * died.sum() if efron else 0)) for j in range(len(died)))
        return total

    for ties in ("breslow", "efron"):
        fit = survival.cox(frame, "t", "e", "z", ties)
        b = robust.fminbound(lambda v: -loglike(v, ties == "efron"), -2, 2, 1e-9)  # noqa: B023
        assert abs(fit.params[0] - b) < 1e-4 and math.isclose(fit.llf, loglike(fit.params[0], ties == "efron"), rel_tol=1e-9)
    with pytest.raises(ValueError):
        survival.cox(frame.withColumn("e", F.lit(0)), "t", "e", "z")


def test_box_of_large_groups(spark):
    rng = np.random.default_rng(7)
    data = [("a", float(v)) for v in rng.normal(size=3000)] + [("b", float(v)) for v in rng.integers(0, 5, 2000)] + [("c", 0.0)] * 900 + [("c", float(v)) for v in rng.exponential(size=300)] + [("d", math.nan)] * 700 + [("d", float(i)) for i in range(600)] + [("e", 1.5), ("f", None), (None, 2.0)]
    frame = spark.createDataFrame(data, "k string, v double").repartition(5).persist()
    want = {r[0]: r[1] for r in frame.where("k is not null and v is not null").groupBy("k").agg(F.percentile("v", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))).collect()} | {"f": [None] * 3}
    for rows in (500, 1_000_000):
        boxes = smooth.box(frame, "v", "k", rows)
        got = {r["k"]: [r["q1"], r["med"], r["q3"]] for r in boxes.collect()}
        assert repr(sorted(got.items())) == repr(sorted(want.items()))
        plan = boxes._jdf.queryExecution().optimizedPlan().toString()
        assert "percentile(" not in plan and "rightHint=(strategy=broadcast)" in plan
    frame.unpersist()


def test_degenerate_input(spark):
    one, none = spark.createDataFrame([(1, 2.0)], "i int, v double"), spark.createDataFrame([], "i int, v double")
    for frame, n in ((one, 1), (none, 0)):
        assert hypothesis.describe(frame, "v").first()["nobs"] == n and math.isnan(hypothesis.describe(frame, "v").first()["std"])
        assert math.isnan(hypothesis.jarque_bera(frame, "v").first()["jb"])
    exact = regression.linear(spark.createDataFrame([(1.0, 1.0), (2.0, 3.0)], "x double, y double"), "y ~ x")
    assert np.allclose(exact.params, [-1, 2]) and math.isnan(exact.stats["scale"]) and np.isnan(exact.pvalues).all()


def test_stretches_of_a_long_series(spark):
    frame = spark.range(1000).selectExpr("cast(id as int) i", "cast((id * 7919) % 101 as double) v").repartition(7)
    want = [float(i * 7919 % 101) for i in range(1000)]
    got = series.numbered(frame, "i", (), {"s": F.col("v")}, rows=90).orderBy("i").collect()
    assert [r["pos_"] for r in got] == list(range(1000)) and np.allclose([r["s"] for r in got], np.cumsum(want))
    got = series.with_lags(frame, ["v"], "i", 3, rows=90).orderBy("i").collect()
    assert [r["v_l3"] for r in got] == [None] * 3 + want[:-3]
    x = spark.createDataFrame([(i, float(v)) for i, v in enumerate(np.cumsum(np.random.default_rng(1).normal(size=200)))], "i int, v double")
    r = autoregression.adfuller(x, "v", "i").first()
    assert r["pvalue"] > 0.01 and r["crit_1"] < r["crit_5"] < r["crit_10"]
