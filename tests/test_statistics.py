"""Statistical operators against numpy, published values and SQL."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyforge.functions import distributions as dist
from tallyforge.operators import glm, hypothesis, regression, series, survival
from tallyforge.operators.formula import design
from tallyforge.plans import catalog

TABLES = ("lineitem", "orders", "customer", "part", "supplier", "events", "labels")


def rows(frame):
    clean = lambda v: None if v is None or v != v else (v.item() if isinstance(v, np.generic) else v)
    return sorted((tuple(clean(v) for v in r) for r in frame[sorted(frame.columns)].itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    got, want = rows(catalog.QUERIES[name](spark, sf).toPandas()), rows(con.execute(catalog.ORACLES[name]).fetch_df())
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert all(x == y or (isinstance(x, float) and y is not None and math.isclose(x, y, rel_tol=1e-6, abs_tol=2e-6)) for x, y in zip(a, b)), (a, b)


def test_distribution_tails():
    assert math.isclose(dist.norm_ppf(0.975), 1.959963984540054, rel_tol=1e-12)
    assert math.isclose(dist.t_sf(2.228138851964939, 10), 0.025, rel_tol=1e-10)
    assert math.isclose(dist.chi2_sf(3.841458820694124, 1), 0.05, rel_tol=1e-10)
    assert math.isclose(dist.f_sf(4.964602743730711, 1, 10), 0.05, rel_tol=1e-9)
    assert math.isclose(dist.t_ppf(0.975, 10), 2.228138851964939, rel_tol=1e-9)
    assert math.isclose(dist.t_ppf(0.99999, 1), 31830.988607, rel_tol=1e-8)
    assert dist.chi2_sf(0, 3) == 1 and dist.f_sf(0, 2, 3) == 1


@pytest.fixture(scope="module")
def sample(spark):
    rng = np.random.default_rng(2)
    x, g = rng.normal(size=(300, 2)), rng.integers(0, 3, 300)
    y = 1 + x @ [2.0, -1.0] + g * 0.5 + rng.normal(size=300)
    return spark.createDataFrame([(float(a), float(b), "abc"[k], float(v)) for (a, b), k, v in zip(x, g, y)], "a double, b double, g string, y double"), x, g, y


def test_linear_model_equals_numpy(sample):
    df, x, g, y = sample
    full = np.column_stack([np.ones(300), x, g == 1, g == 2, x[:, 0] * x[:, 1]]).astype(float)
    want = np.linalg.lstsq(full, y, rcond=None)[0]
    for frame in (df.repartition(1), df.repartition(7)):
        fit = regression.linear(frame, "y ~ a*b + C(g)")
        got = dict(zip(fit.plan.names, fit.params))
        order = ["Intercept", "a", "b", "C(g)[T.b]", "C(g)[T.c]", "a:b"]
        assert np.allclose([got[n] for n in order], want, rtol=1e-9)
    e = y - full @ want
    assert math.isclose(fit.stats["ssr"], e @ e, rel_tol=1e-9)


def test_data_far_from_zero_keep_precision(spark):
    df = spark.createDataFrame([(1e9 + i, 3.0 * i + 1) for i in range(100)], "x double, y double")
    assert math.isclose(regression.linear(df, "y ~ x").params[1], 3.0, rel_tol=1e-9)


def test_collinear_columns_and_missing_rows(spark):
    df = spark.createDataFrame([(float(i), 2.0 * i, float(i * i)) for i in range(20)] + [(None, 1.0, 1.0), (math.nan, 1.0, 1.0)], "a double, b double, y double")
    fit = regression.linear(df, "y ~ a + b")
    assert fit.stats["nobs"] == 20 and fit.df_resid == 18
    with pytest.raises(ValueError):
        regression.linear(df.limit(0), "y ~ a")


def test_formula_terms(sample):
    df = sample[0]
    assert design(df, "y ~ a + log(b) + I(a + 1) - 1").names == ["a", "log(b)", "I(a + 1)"]
    assert design(df, "y ~ g:a - 1").names == ["g[a]:a", "g[b]:a", "g[c]:a"]
    assert design(df, "y ~ a*b - a").names == ["Intercept", "b", "a:b"]
    assert design(df, "y ~ a + g:a").names == ["Intercept", "a", "g[T.b]:a", "g[T.c]:a"]
    assert design(df, "y ~ (a + b + c)**2".replace("c", "y")).names == ["Intercept", "a", "b", "y", "a:b", "a:y", "b:y"]
    assert design(df, "y ~ g/a").names == ["Intercept", "g[T.b]", "g[T.c]", "g[a]:a", "g[b]:a", "g[c]:a"]
    assert design(df, "y ~ C(g, Sum) - 1").names == ["C(g, Sum)[mean]", "C(g, Sum)[S.a]", "C(g, Sum)[S.b]"]
    for bad in ("y ~", "~ a", "y ~ a +", "y ~ (a", "y ~ a ** b", "y ~ C(g, Odd)"):
        with pytest.raises(ValueError):
            design(df, bad)
    assert design(df, "y ~ C(g) - 1").names == ["C(g)[a]", "C(g)[b]", "C(g)[c]"]


def test_logit_equals_newton(sample, spark):
    df, x, _, y = sample
    z = (y > 1).astype(float)
    full, beta = np.column_stack([np.ones(300), x]), np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-full @ beta))
        beta += np.linalg.solve(full.T @ (full * (p * (1 - p))[:, None]), full.T @ (z - p))
    fit = glm.glm(df.withColumn("z", (F.col("y") > 1).cast("int")), "z ~ a + b", "binomial")
    assert np.allclose(fit.params, beta, rtol=1e-6)


def test_smoothing_and_streams(spark, tmp_path):
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate([3, 5, 9])], "k string, i int, v double")
    assert [round(r["level"], 6) for r in series.smoothing(df, "v", "i", 0.5, "k").orderBy("i").collect()] == [3, 4, 6.5]
    from tallyforge.streaming.windows import windowed_ols

    data = spark.sql("select timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,cast(id as int)) ts, cast(id as double) x, cast(3 * id + 1 as double) y from range(48)")
    data.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(data.schema).parquet(str(tmp_path / "in"))
    job = windowed_ols(stream, "ts", "y", "x").writeStream.format("memory").queryName("fits").outputMode("complete").option("checkpointLocation", str(tmp_path / "state")).start()
    job.processAllAvailable()
    job.stop()
    got = spark.table("fits").collect()
    assert len(got) == 2 and all(abs(r["slope"] - 3) < 1e-9 for r in got)


def test_survival_of_all(spark):
    df = spark.createDataFrame([(1, 1), (2, 0), (3, 1)], "t int, e int")
    assert [(r["t"], round(r["surv"], 6)) for r in survival.kaplan_meier(df, "t", "e").orderBy("t").collect()] == [(1.0, 0.666667), (3.0, 0.0)]


def test_incidence_of_millions(spark):
    rows = lambda n: spark.range(n).select((F.col("id") % 3).alias("t"), (F.col("id") % 2).alias("k"))
    few, many = (survival.cumulative_incidence(rows(n), "t", "k").orderBy("t").collect() for n in (24, 2_400_000))
    assert [round(r["incidence"], 9) for r in many] == [round(1 / 6, 9), 0.375, 0.6875]
    assert all(abs(a["std_err"] - b["std_err"] * 100_000**0.5) < 1e-9 for a, b in zip(few, many))


def test_adjusted_p_values(spark):
    df = spark.createDataFrame([(0.01,), (0.02,), (0.03,), (None,)], "p double")
    assert [round(r["p_adjusted"], 6) for r in hypothesis.multipletests(df, "p", "holm").orderBy("p").collect()] == [0.03, 0.04, 0.04]
