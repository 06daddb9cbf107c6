"""Queries of the statistical operators over whole tables and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions import distributions as dist
from tallyforge.operators import autoregression, discrete, glm, hypothesis, linalg, regression, series, smooth, survival
from tallyforge.sources.tables import table
from tallyforge.streaming.windows import windowed_ols

#: Two-sided p-values in SQL, by Simpson's rule over the density.
def normal_p(z: str) -> str:
    return f"greatest(0, 1 - least(abs({z}), 40) / 3000 / sqrt(2 * pi()) * (select sum(case when i in (0, 2000) then 1 when i % 2 = 1 then 4 else 2 end * exp(-0.5 * (least(abs({z}), 40) * i / 2000) ^ 2)) from range(2001) r(i)))"


def t_p(t: str, df: str) -> str:
    return f"greatest(0, 1 - least(abs({t}), 60) / 3000 * exp(lgamma(({df} + 1) / 2) - lgamma({df} / 2)) / sqrt({df} * pi()) * (select sum(case when i in (0, 2000) then 1 when i % 2 = 1 then 4 else 2 end * (1 + (least(abs({t}), 60) * i / 2000) ^ 2 / {df}) ^ (-({df} + 1) / 2)) from range(2001) r(i)))"


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def rounded(df: DataFrame, places: int) -> DataFrame:
    """Doubles rounded; sums over partitions differ in their last digits."""
    return df.select(*((F.round(c, places) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def query(name: str, sql: str | None = None, places: int = 6):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = lambda s, d: rounded(f(s, d), places)
        if sql:
            ORACLES[name] = sql
        return f

    return add


def lineitem(s: SparkSession, d: str, *columns: str) -> DataFrame:
    return table(s, d, "lineitem", *columns)


def daily(s: SparkSession, d: str) -> DataFrame:
    """Orders' mean price per day: the series of the time-series queries."""
    return table(s, d, "orders", "o_orderdate", "o_totalprice").groupBy(F.to_date("o_orderdate").cast("string").alias("day")).agg((F.sum(F.round(F.col("o_totalprice") * 100).cast("bigint")) / F.count("*") / 99991).alias("x"))


DAILY = "daily as (select o_orderdate::date::varchar as day, sum(round(o_totalprice * 100)::bigint) / count(*) / 99991 x from orders group by 1)"
LIFE = "life as (select datediff('day', o_orderdate, l_shipdate) t, (l_returnflag = 'R')::int e, l_linestatus g from lineitem join orders on o_orderkey = l_orderkey)"


def life(s: SparkSession, d: str) -> DataFrame:
    """Days from order to shipment, with returned items as events."""
    o = table(s, d, "orders", "o_orderkey", "o_orderdate")
    li = lineitem(s, d, "l_orderkey", "l_shipdate", "l_returnflag", "l_linestatus")
    return li.join(o, F.col("o_orderkey") == F.col("l_orderkey")).select(F.date_diff("l_shipdate", "o_orderdate").alias("t"), (F.col("l_returnflag") == "R").cast("int").alias("e"), F.col("l_linestatus").alias("g"))


@query("ols_coefficients", places=4)
def _(s, d):
    return regression.linear(lineitem(s, d, "l_extendedprice", "l_quantity", "l_discount", "l_returnflag"), "l_extendedprice ~ l_quantity + l_discount + C(l_returnflag)").coef


CLOSED = """with a as (select avg(l_quantity) mx, avg(l_extendedprice) my, count(*) n from lineitem),
b as (select n, mx, my, sum((l_quantity - mx) ^ 2) sxx, sum((l_quantity - mx) * (l_extendedprice - my)) sxy, sum((l_extendedprice - my) ^ 2) syy from lineitem, a group by all),
c as (select *, sxy / sxx slope, my - sxy / sxx * mx icept from b)"""


@query("ols_simple", CLOSED + """ select 'Intercept' term, round(icept, 4) coef, round(sqrt((syy - slope * sxy) / (n - 2) * (1 / n + mx * mx / sxx)), 4) std_err, round(icept / sqrt((syy - slope * sxy) / (n - 2) * (1 / n + mx * mx / sxx)), 4) stat from c
union all select 'l_quantity', round(slope, 4), round(sqrt((syy - slope * sxy) / (n - 2) / sxx), 4), round(slope / sqrt((syy - slope * sxy) / (n - 2) / sxx), 4) from c""", 4)  # fmt: skip
def _(s, d):
    return regression.linear(lineitem(s, d, "l_extendedprice", "l_quantity"), "l_extendedprice ~ l_quantity").coef.select("term", "coef", "std_err", "stat")


for _hc, _factor, _power in (("HC0", "1", 0), ("HC1", "n / (n - 2)", 0), ("HC2", "1", 1), ("HC3", "1", 2)):

    @query(f"ols_{_hc.lower()}", CLOSED + f""", d as (select *, l_extendedprice - icept - slope * l_quantity e, 1 / n + (l_quantity - mx) ^ 2 / sxx h, l_quantity - mx dx from lineitem, c)
select 'l_quantity' term, round(sqrt(sum(e * e * dx * dx / (1 - h) ^ {_power}) / any_value(sxx) ^ 2 * any_value({_factor})), 6) std_err from d""")  # fmt: skip
    def _(s, d, hc=_hc):
        return regression.linear(lineitem(s, d, "l_extendedprice", "l_quantity"), "l_extendedprice ~ l_quantity", cov=hc).coef.where("term = 'l_quantity'").select("term", "std_err")


@query("ols_two", """with a as (select avg(l_quantity) m1, avg(l_discount) m2, avg(l_extendedprice) my from lineitem),
b as (select sum((l_quantity - m1) ^ 2) s11, sum((l_discount - m2) ^ 2) s22, sum((l_quantity - m1) * (l_discount - m2)) s12, sum((l_quantity - m1) * (l_extendedprice - my)) s1, sum((l_discount - m2) * (l_extendedprice - my)) s2 from lineitem, a)
select 'l_quantity' term, round((s22 * s1 - s12 * s2) / (s11 * s22 - s12 * s12), 4) coef from b union all select 'l_discount', round((s11 * s2 - s12 * s1) / (s11 * s22 - s12 * s12), 4) from b""", 4)  # fmt: skip
def _(s, d):
    return regression.linear(lineitem(s, d, "l_extendedprice", "l_quantity", "l_discount"), "l_extendedprice ~ l_quantity + l_discount").coef.where("term <> 'Intercept'").select("term", "coef")


@query("wls_simple", """with a as (select sum(l_quantity * l_discount) / sum(l_quantity) mx, sum(l_quantity * l_extendedprice) / sum(l_quantity) my from lineitem)
select 'l_discount' term, round(sum(l_quantity * (l_discount - mx) * (l_extendedprice - my)) / sum(l_quantity * (l_discount - mx) ^ 2), 4) coef from lineitem, a""", 4)  # fmt: skip
def _(s, d):
    return regression.linear(lineitem(s, d, "l_extendedprice", "l_quantity", "l_discount"), "l_extendedprice ~ l_discount", weights="l_quantity").coef.where("term = 'l_discount'").select("term", "coef")


@query("ols_dummy", "with m as (select l_returnflag f, avg(l_extendedprice) a from lineitem group by 1) select case when f = 'A' then 'Intercept' else 'C(l_returnflag)[T.' || f || ']' end term, round(a - case when f = 'A' then 0 else (select a from m where f = 'A') end, 4) coef from m", 4)
def _(s, d):
    return regression.linear(lineitem(s, d, "l_extendedprice", "l_returnflag"), "l_extendedprice ~ C(l_returnflag)").coef.select("term", "coef")


@query("ols_model_stats", CLOSED + " select n::double nobs, round(slope * sxy / syy, 9) rsquared, round(slope * sxy / ((syy - slope * sxy) / (n - 2)), 9) fvalue, round(-n / 2 * ln(syy - slope * sxy) - n / 2 * (1 + ln(2 * pi() / n)), 3) llf from c", 9)
def _(s, d):
    m = regression.linear(lineitem(s, d, "l_extendedprice", "l_quantity"), "l_extendedprice ~ l_quantity").model_stats
    return m.select("nobs", "rsquared", "fvalue", F.round("llf", 3).alias("llf"))


def _saturated(y: str, link: str) -> str:
    return f"with m as (select l_linestatus f, {link.format(m=f'avg({y})')} a from lineitem group by 1) select case when f = 'F' then 'Intercept' else 'C(l_linestatus)[T.' || f || ']' end term, round(a - case when f = 'F' then 0 else (select a from m where f = 'F') end, 6) coef from m"


@query("logit_saturated", _saturated("(l_returnflag = 'R')::int", "ln({m} / (1 - {m}))"))
def _(s, d):
    df = lineitem(s, d, "l_returnflag", "l_linestatus").withColumn("y", (F.col("l_returnflag") == "R").cast("int"))
    return glm.glm(df, "y ~ C(l_linestatus)", "binomial").coef.select("term", "coef")


@query("poisson_saturated", _saturated("l_quantity", "ln({m})"))
def _(s, d):
    return glm.glm(lineitem(s, d, "l_quantity", "l_linestatus"), "l_quantity ~ C(l_linestatus)", "poisson").coef.select("term", "coef")


@query("gamma_saturated", _saturated("l_quantity", "1 / {m}"), 6)
def _(s, d):
    return glm.glm(lineitem(s, d, "l_quantity", "l_linestatus"), "l_quantity ~ C(l_linestatus)", "gamma").coef.select("term", "coef")


@query("glm_poisson", places=5)
def _(s, d):
    return glm.glm(lineitem(s, d, "l_quantity", "l_discount", "l_tax", "l_returnflag"), "l_quantity ~ l_discount + l_tax + C(l_returnflag)", "poisson").coef


@query("describe_price", """with m as (select avg(l_extendedprice) mu from lineitem), c as (select avg((l_extendedprice - mu) ^ 2) m2, avg((l_extendedprice - mu) ^ 3) m3, avg((l_extendedprice - mu) ^ 4) m4 from lineitem, m)
select count(*)::double nobs, 0.0::double missing, round(avg(l_extendedprice), 6) mean, round(stddev_samp(l_extendedprice), 6) std, round(stddev_samp(l_extendedprice) / avg(l_extendedprice), 6) coef_var,
 round((select m3 / m2 ^ 1.5 from c), 6) skew, round((select m4 / m2 ^ 2 from c), 6) kurtosis, round(quantile_cont(l_extendedprice, 0.05), 6) p5, round(quantile_cont(l_extendedprice, 0.25), 6) p25, round(quantile_cont(l_extendedprice, 0.5), 6) p50,
 round(quantile_cont(l_extendedprice, 0.75), 6) p75, round(quantile_cont(l_extendedprice, 0.95), 6) p95, min(l_extendedprice) min, max(l_extendedprice) max from lineitem""")  # fmt: skip
def _(s, d):
    return hypothesis.describe(lineitem(s, d, "l_extendedprice"), "l_extendedprice")


@query("weighted_mean_var", "with m as (select sum(l_quantity * l_discount) / sum(l_quantity) mu, sum(l_quantity) w from lineitem) select any_value(w) sum_weights, round(any_value(mu), 9) mean, round(sum(l_quantity * (l_discount - mu) ^ 2) / any_value(w), 9) var, round(sqrt(sum(l_quantity * (l_discount - mu) ^ 2) / any_value(w) / (any_value(w) - 1)), 9) std_mean from lineitem, m", 9)
def _(s, d):
    return hypothesis.weighted(lineitem(s, d, "l_discount", "l_quantity"), "l_discount", "l_quantity")


_TWO = "with g as (select count(*) filter (l_returnflag = 'A') n1, count(*) filter (l_returnflag = 'R') n2, avg(l_extendedprice) filter (l_returnflag = 'A') m1, avg(l_extendedprice) filter (l_returnflag = 'R') m2, var_samp(l_extendedprice) filter (l_returnflag = 'A') v1, var_samp(l_extendedprice) filter (l_returnflag = 'R') v2 from lineitem)"


@query("ttest_ind_pooled", _TWO + " select round((m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) * (1 / n1 + 1 / n2)), 6) tstat, (n1 + n2 - 2)::double df from g")
def _(s, d):
    return hypothesis.ttest_ind(lineitem(s, d, "l_extendedprice", "l_returnflag"), "l_extendedprice", "l_returnflag", "A", "R").select("tstat", "df")


@query("ttest_ind_pvalue", _TWO + f", q as (select (m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) * (1 / n1 + 1 / n2)) t, (n1 + n2 - 2)::double df from g) select round({t_p('t', 'df')}, 4) pvalue from q", 4)
def _(s, d):
    return hypothesis.ttest_ind(lineitem(s, d, "l_extendedprice", "l_returnflag"), "l_extendedprice", "l_returnflag", "A", "R").select("pvalue")


@query("ttest_ind_welch", _TWO + " select round((m1 - m2) / sqrt(v1 / n1 + v2 / n2), 6) tstat, round((v1 / n1 + v2 / n2) ^ 2 / ((v1 / n1) ^ 2 / (n1 - 1) + (v2 / n2) ^ 2 / (n2 - 1)), 4) df from g")
def _(s, d):
    return hypothesis.ttest_ind(lineitem(s, d, "l_extendedprice", "l_returnflag"), "l_extendedprice", "l_returnflag", "A", "R", pooled=False).select("tstat", F.round("df", 4).alias("df"))


@query("ztest_one", f"with q as (select (avg(c_acctbal) - 4500) / sqrt(var_samp(c_acctbal) / count(*)) z from customer) select round(z, 6) zstat, round({normal_p('z')}, 6) pvalue from q")
def _(s, d):
    return hypothesis.ztest_one(table(s, d, "customer", "c_acctbal"), "c_acctbal", 4500)


_GROUPS = "with g as (select c_mktsegment, count(*) n, avg(c_acctbal) m, var_samp(c_acctbal) v from customer group by 1), t as (select sum(n) nn, count(*) k, sum(n * m) / sum(n) mu from g)"


@query("f_oneway", _GROUPS + " select round(sum(n * (m - mu) ^ 2) / (any_value(k) - 1) / (sum((n - 1) * v) / (any_value(nn) - any_value(k))), 6) statistic, (any_value(k) - 1)::double df_num, (any_value(nn) - any_value(k))::double df_denom from g, t")
def _(s, d):
    return hypothesis.oneway(table(s, d, "customer", "c_acctbal", "c_mktsegment"), "c_acctbal", "c_mktsegment").select("statistic", "df_num", "df_denom")


@query("anova_bf", _GROUPS + " select round(sum(n * (m - mu) ^ 2) / sum((1 - n / nn) * v), 6) statistic, round(sum((1 - n / nn) * v) ^ 2 / sum(((1 - n / nn) * v) ^ 2 / (n - 1)), 6) df_denom from g, t")
def _(s, d):
    return hypothesis.oneway(table(s, d, "customer", "c_acctbal", "c_mktsegment"), "c_acctbal", "c_mktsegment", "bf").select("statistic", "df_denom")


@query("anova_welch", _GROUPS + ", w as (select *, n / v w, sum(n / v) over () tw, sum(n / v * m) over () / sum(n / v) over () c from g, t) select round(sum(w * (m - c) ^ 2) / (any_value(k) - 1) / (1 + 2 * (any_value(k) - 2) / (any_value(k) ^ 2 - 1) * sum((1 - w / tw) ^ 2 / (n - 1))), 6) statistic, round((any_value(k) ^ 2 - 1) / (3 * sum((1 - w / tw) ^ 2 / (n - 1))), 6) df_denom from w")
def _(s, d):
    return hypothesis.oneway(table(s, d, "customer", "c_acctbal", "c_mktsegment"), "c_acctbal", "c_mktsegment", "unequal").select("statistic", "df_denom")


@query("tukey_pairs", _GROUPS + ", s as (select sum((n - 1) * v) / sum(n - 1) s2 from g) select a.c_mktsegment group1, b.c_mktsegment group2, round(b.m - a.m, 6) meandiff, round(sqrt(s2 / 2 * (1 / a.n + 1 / b.n)), 6) std_pair from g a join g b on a.c_mktsegment < b.c_mktsegment, s")
def _(s, d):
    return hypothesis.pairwise(table(s, d, "customer", "c_acctbal", "c_mktsegment"), "c_acctbal", "c_mktsegment")


@query("prop_ztest", "with g as (select count(*) filter (l_linestatus = 'F') n1, count(*) filter (l_linestatus = 'O') n2, count(*) filter (l_linestatus = 'F' and l_returnflag = 'R') c1, count(*) filter (l_linestatus = 'O' and l_returnflag = 'R') c2 from lineitem) select round(c1 / n1, 6) prop1, round(c2 / n2, 6) prop2, round((c1 / n1 - c2 / n2) / sqrt((c1 + c2) / (n1 + n2) * (1 - (c1 + c2) / (n1 + n2)) * (1 / n1 + 1 / n2)), 6) zstat from g")
def _(s, d):
    return hypothesis.proportions_ztest(lineitem(s, d, "l_returnflag", "l_linestatus"), "l_returnflag = 'R'", "l_linestatus").select("prop1", "prop2", "zstat")


@query("chi2_contingency", "with c as (select l_returnflag a, l_linestatus b, count(*) n from lineitem group by all), e as (select n, sum(n) over (partition by a) * sum(n) over (partition by b) / sum(n) over () x, (select (count(distinct a) - 1) * (count(distinct b) - 1) from c) df from c) select round(sum((n - x) ^ 2 / x), 6) statistic, any_value(df)::double df, round(exp(-sum((n - x) ^ 2 / x) / 2), 6) pvalue from e")
def _(s, d):
    return hypothesis.contingency(lineitem(s, d, "l_returnflag", "l_linestatus"), "l_returnflag", "l_linestatus")


@query("cohens_kappa", "with p as (select avg((quality = toxic)::int) po, avg(quality) q, avg(toxic) t from labels where quality is not null and toxic is not null) select round(po, 6) agreement, round(q * t + (1 - q) * (1 - t), 6) chance, round((po - q * t - (1 - q) * (1 - t)) / (1 - q * t - (1 - q) * (1 - t)), 6) kappa from p")
def _(s, d):
    return hypothesis.cohens_kappa(table(s, d, "labels", "quality", "toxic"), "quality", "toxic")


@query("jarque_bera", "with m as (select avg(o_totalprice) mu from orders), c as (select count(*) n, avg((o_totalprice - mu) ^ 2) m2, avg((o_totalprice - mu) ^ 3) m3, avg((o_totalprice - mu) ^ 4) m4 from orders, m) select round(n / 6 * (m3 ^ 2 / m2 ^ 3 + (m4 / m2 ^ 2 - 3) ^ 2 / 4), 4) jb, round(exp(-n / 12 * (m3 ^ 2 / m2 ^ 3 + (m4 / m2 ^ 2 - 3) ^ 2 / 4)), 6) pvalue, round(m3 / m2 ^ 1.5, 6) skew, round(m4 / m2 ^ 2, 6) kurtosis from c")
def _(s, d):
    return hypothesis.jarque_bera(table(s, d, "orders", "o_totalprice"), "o_totalprice").select(F.round("jb", 4).alias("jb"), "pvalue", "skew", "kurtosis")


for _method, _sql in (("bonferroni", "p * m"), ("holm", "max(p * (m - r + 1)) over (order by r rows unbounded preceding)"), ("bh", "min(p * m / r) over (order by r desc rows unbounded preceding)")):

    @query(f"multipletests_{_method}", f"with x as (select p_partkey, p_retailprice / (select max(p_retailprice) from part) * 0.05 + p_partkey * 1e-9 p from part), r as (select *, row_number() over (order by p) r, count(*) over () m from x) select p_partkey, round(least(1.0, {_sql}), 6) p_adjusted from r")
    def _(s, d, method=_method):
        part = table(s, d, "part", "p_partkey", "p_retailprice")
        top = part.agg(F.max("p_retailprice")).first()[0]
        return hypothesis.multipletests(part.select("p_partkey", (F.col("p_retailprice") / F.lit(top) * 0.05 + F.col("p_partkey") * 1e-9).alias("p")), "p", method).select("p_partkey", "p_adjusted")


@query("spearman", "with r as (select rank() over (order by s_acctbal) + (count(*) over (partition by s_acctbal) - 1) / 2 a, rank() over (order by s_nationkey) + (count(*) over (partition by s_nationkey) - 1) / 2 b from supplier) select count(*) n, round(corr(a, b), 6) rho from r")
def _(s, d):
    return hypothesis.spearman(table(s, d, "supplier", "s_acctbal", "s_nationkey"), "s_acctbal", "s_nationkey")


@query("ecdf", "select distinct p_retailprice x, round(cume_dist() over (order by p_retailprice), 6) y from part")
def _(s, d):
    return hypothesis.ecdf(table(s, d, "part", "p_retailprice"), "p_retailprice")


@query("lagmat", f"with {DAILY} select day, round(x, 6) x, round(lag(x, 1) over (order by day), 6) x_l1, round(lag(x, 2) over (order by day), 6) x_l2 from daily")
def _(s, d):
    return series.lagmat(daily(s, d), "x", "day", 2)


@query("acf", f"with {DAILY}, m as (select *, x - avg(x) over () d, row_number() over (order by day) i, count(*) over () n from daily), v as (select sum(d * d) v0, any_value(n) n from m), r as (select k::int k, sum(a.d * b.d) s from range(6) t(k) join m a on true join m b on b.i = a.i - k group by 1), z as (select k, s / n acovf, s / v0 acf, case when k > 0 then n * (n + 2) * (s / v0) ^ 2 / (n - k) else 0 end q from r, v) select k lag, round(acovf, 6) acovf, round(acf, 6) acf, round(sum(q) over (order by k rows unbounded preceding), 6) ljung_box from z")
def _(s, d):
    return series.acf(daily(s, d), "x", "day", 5).drop("pvalue")


@query("durbin_watson", f"with {DAILY}, c as (select x - (select avg(x) from daily) e, day from daily), p as (select e, lag(e) over (order by day) p from c) select round(sum((e - p) ^ 2) / sum(e * e), 6) dw from p")
def _(s, d):
    x = daily(s, d)
    return series.durbin_watson(x.withColumn("e", F.col("x") - F.lit(x.agg(F.avg("x")).first()[0])), "e", "day")


@query("seasonal_decompose_7", f"with {DAILY}, i as (select day, x, row_number() over (order by day) - 1 i, case when count(*) over w = 7 then avg(x) over w end trend from daily window w as (order by day rows between 3 preceding and 3 following)), s as (select i % 7 p, avg(x - trend) s from i group by 1), c as (select p, s - (select avg(s) from s) s from s) select day, round(x, 6) x, round(trend, 6) trend, round(s, 6) seasonal, round(x - trend - s, 6) resid from i join c on p = i % 7")
def _(s, d):
    return series.seasonal_decompose(daily(s, d), "x", "day", 7)


@query("rolling_ols", f"with {DAILY}, j as (select day, x, lag(x) over (order by day) p from daily), k as (select * from j where p is not null) select day, round(case when count(*) over w = 30 then covar_pop(x, p) over w / var_pop(p) over w end, 6) slope, round(case when count(*) over w = 30 then avg(x) over w - covar_pop(x, p) over w / var_pop(p) over w * avg(p) over w end, 6) intercept from k window w as (order by day rows between 29 preceding and current row)")
def _(s, d):
    return series.rolling_ols(series.lagmat(daily(s, d), "x", "day", 1).na.drop(), "x", "x_l1", "day", 30)


@query("kpss", f"with {DAILY}, c as (select day, x - avg(x) over () d, count(*) over () n from daily), z as (select d, n, sum(d) over w s, lag(d, 1) over w a, lag(d, 2) over w b from c window w as (order by day rows between unbounded preceding and current row)) select round(sum(s * s) / any_value(n) / any_value(n) / ((sum(d * d) + 2 * (2 / 3 * sum(d * a) + 1 / 3 * sum(d * b))) / any_value(n)), 6) statistic, 2 lags from z")
def _(s, d):
    return series.kpss(daily(s, d), "x", "day", 2).drop("pvalue")


@query("smoothing_fixed_alpha", "with recursive e as (select event_type k, event_id i, value v, row_number() over (partition by event_type order by event_id) r from events where value is not null), t as (select k, i, v, r, v::double level from e where r = 1 union all select e.k, e.i, e.v, e.r, 0.3 * e.v + 0.7 * t.level from t join e on e.k = t.k and e.r = t.r + 1) select k event_type, i event_id, round(v, 6) \"value\", round(level, 6) level from t")
def _(s, d):
    return series.smoothing(table(s, d, "events", "event_type", "event_id", "value").where("value is not null"), "value", "event_id", 0.3, "event_type")


@query("kaplan_meier", f"with {LIFE}, a as (select t::double t, sum(e)::bigint d, count(*) c from life group by 1), b as (select *, sum(c) over (order by t desc rows unbounded preceding)::bigint n from a), f as (select * from b where d > 0), g as (select t, n, d, exp(sum(case when d < n then ln(1 - d / n) else 0 end) over w) * (1 - max((d = n)::int) over w) s, sum(case when n > d then d / (n * (n - d)) end) over w g from f window w as (order by t rows unbounded preceding)) select t, n n_risk, d n_events, round(s, 6) surv, round(s * sqrt(g), 6) std_err from g")
def _(s, d):
    return survival.kaplan_meier(life(s, d), "t", "e")


@query("logrank", f"with {LIFE}, a as (select t, sum(e) d, sum(e * (g = 'F')::int) d1, count(*) c, sum((g = 'F')::int) c1 from life group by 1), b as (select d, d1, sum(c) over w n, sum(c1) over w n1 from a window w as (order by t desc rows unbounded preceding)), f as (select sum(d1 - d * n1 / n) u, sum(case when n > 1 then d * (n1 / n) * (1 - n1 / n) * (n - d) / (n - 1) else 0 end) v from b where d > 0) select round(u * u / v, 6) chi2, 1 df, round({normal_p('sqrt(u * u / v)')}, 6) pvalue from f")
def _(s, d):
    return survival.logrank(life(s, d), "t", "e", "g")


_GRID = [900.0 + 50 * i for i in range(25)]


@query("kde_fixed_bw", f"select x, round(sum(exp(-0.5 * ((x - p_retailprice) / 40) ^ 2)) / (count(*) * 40 * sqrt(2 * pi())), 9) density from part, (select unnest({_GRID})::double x) group by 1", 9)
def _(s, d):
    return smooth.kde(table(s, d, "part", "p_retailprice"), "p_retailprice", _GRID, 40.0)


@query("hist_bins", "select least(floor(l_quantity / 5), 9)::int bin, count(*) n from lineitem where l_quantity between 0 and 50 group by 1")
def _(s, d):
    return smooth.histogram(lineitem(s, d, "l_quantity"), "l_quantity", 0.0, 5.0, 10)


@query("box_stats", "with q as (select l_returnflag, quantile_cont(l_extendedprice, 0.25) q1, quantile_cont(l_extendedprice, 0.5) med, quantile_cont(l_extendedprice, 0.75) q3 from lineitem group by 1), x as (select *, l_extendedprice between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1) ok from lineitem join q using (l_returnflag)) select l_returnflag, round(q1, 6) q1, round(med, 6) med, round(q3, 6) q3, min(l_extendedprice) filter (ok) whisker_low, max(l_extendedprice) filter (ok) whisker_high, count(*) filter (not ok) outliers from x group by all")
def _(s, d):
    return smooth.box(lineitem(s, d, "l_returnflag", "l_extendedprice"), "l_extendedprice", "l_returnflag")


@query("pca_2d", "select 1 component, round(1 + abs(corr(p_size, p_retailprice)), 6) eigenvalue, round((1 + abs(corr(p_size, p_retailprice))) / 2, 6) share from part union all select 2, round(1 - abs(corr(p_size, p_retailprice)), 6), round((1 - abs(corr(p_size, p_retailprice))) / 2, 6) from part")
def _(s, d):
    return smooth.pca(table(s, d, "part", "p_size", "p_retailprice"), ["p_size", "p_retailprice"])


@query("copulas", "with u as (select l_orderkey, l_linenumber, (l_quantity + 1) / 60 u, l_discount * 5 + 0.1 v from lineitem) select l_orderkey, l_linenumber, round(3 * (u * v) ^ -3 * (u ^ -2 + v ^ -2 - 1) ^ -2.5, 6) clayton, round(-ln(1 + (exp(-2 * u) - 1) * (exp(-2 * v) - 1) / (exp(-2) - 1)) / 2, 6) frank, round(exp(-1 * sqrt(ln(u) ^ 2 + ln(v) ^ 2)), 6) gumbel from u")
def _(s, d):
    x = lineitem(s, d, "l_orderkey", "l_linenumber", "l_quantity", "l_discount").select("l_orderkey", "l_linenumber", ((F.col("l_quantity") + 1) / 60).alias("u"), (F.col("l_discount") * 5 + 0.1).alias("v"))
    u, v = F.col("u"), F.col("v")
    return x.select("l_orderkey", "l_linenumber", smooth.clayton_pdf(u, v, 2.0).alias("clayton"), smooth.frank_cdf(u, v, 2.0).alias("frank"), smooth.gumbel_cdf(u, v, 2.0).alias("gumbel"))


@query("windowed_ols", "select date_trunc('day', ts) start, count(*) n, round(covar_pop(value, user_id) / var_pop(value), 4) slope, round(avg(user_id) - covar_pop(value, user_id) / var_pop(value) * avg(value), 4) intercept from events group by 1", 4)
def _(s, d):
    return windowed_ols(table(s, d, "events", "ts", "user_id", "value"), "ts", "user_id", "value")


_MEANS = "m as (select l_returnflag f, avg(l_extendedprice) a from lineitem group by 1), w as (select (select a from m where f = 'A') a, (select a from m where f = 'N') n, (select a from m where f = 'R') r)"
_CODED = {
    "Sum": ["'Intercept', (a + n + r) / 3", "'[S.A]', a - (a + n + r) / 3", "'[S.N]', n - (a + n + r) / 3"],
    "Helmert": ["'Intercept', (a + n + r) / 3", "'[H.N]', (n - a) / 2", "'[H.R]', (r - (a + n) / 2) / 3"],
    "Diff": ["'Intercept', (a + n + r) / 3", "'[D.A]', n - a", "'[D.N]', r - n"],
    "Poly": ["'Intercept', (a + n + r) / 3", "'.Linear', (r - a) / sqrt(2)", "'.Quadratic', (a - 2 * n + r) / sqrt(6)"],
}
for _coding, _rows in _CODED.items():
    _union = " union all ".join(f"select * from (select {r} from w) t(term, coef)" for r in _rows)

    @query(f"ols_coding_{_coding.lower()}", f"with {_MEANS} select case when term = 'Intercept' then term else 'C(l_returnflag, {_coding})' || term end term, round(coef, 4) coef from ({_union})", 4)
    def _(s, d, coding=_coding):
        return regression.linear(lineitem(s, d, "l_extendedprice", "l_returnflag"), f"l_extendedprice ~ C(l_returnflag, {coding})").coef.select("term", "coef")


@query("ols_interaction", "select 'l_returnflag[' || l_returnflag || ']:l_quantity' term, round(sum(l_quantity * l_extendedprice) / sum(l_quantity ^ 2), 4) coef from lineitem group by l_returnflag", 4)
def _(s, d):
    return regression.linear(lineitem(s, d, "l_extendedprice", "l_quantity", "l_returnflag"), "l_extendedprice ~ l_returnflag:l_quantity - 1").coef.select("term", "coef")


@query("ols_nested", "with m as (select l_returnflag, l_linestatus, avg(l_extendedprice) a from lineitem group by all) select round(sum((l_extendedprice - a) ^ 2) / 1e6, 4) ssr, count(*)::double nobs, any_value((select count(*) from m))::double rank from lineitem join m using (l_returnflag, l_linestatus)", 4)
def _(s, d):
    st = regression.linear(lineitem(s, d, "l_extendedprice", "l_returnflag", "l_linestatus"), "l_extendedprice ~ l_returnflag/l_linestatus").model_stats
    return st.select((F.col("ssr") / 1e6).alias("ssr"), "nobs", (F.col("df_model") + 1).alias("rank"))


@query("ols_power_terms", """with z as (select l_quantity - avg(l_quantity) over () q, (l_quantity - avg(l_quantity) over ()) ^ 2 q2, l_extendedprice y from lineitem), c as (select q, q2 - avg(q2) over () q2, y - avg(y) over () y from z),
b as (select sum(q * q) a, sum(q * q2) b, sum(q2 * q2) c, sum(q * y) u, sum(q2 * y) v from c) select 'I(l_quantity ** 2)' term, round((a * v - b * u) / (a * c - b * b), 4) coef from b""", 4)  # fmt: skip
def _(s, d):
    return regression.linear(lineitem(s, d, "l_extendedprice", "l_quantity"), "l_extendedprice ~ l_quantity + I(l_quantity ** 2)").coef.where("term like 'I(%'").select("term", "coef")


@query("ols_inference", CLOSED + f""", t as (select slope, sqrt((syy - slope * sxy) / (n - 2) / sxx) se, (n - 2)::double df from c) select round(slope, 4) coef, round(slope - 1.959963984540054 * se, 1) ci_low, round(slope + 1.959963984540054 * se, 1) ci_high, round({t_p('slope / se', 'df')}, 4) pvalue from t""", 4)
def _(s, d):
    return regression.linear(lineitem(s, d, "l_extendedprice", "l_quantity"), "l_extendedprice ~ l_quantity").coef.where("term = 'l_quantity'").select("coef", F.round("ci_low", 1).alias("ci_low"), F.round("ci_high", 1).alias("ci_high"), "pvalue")


@query("ols_predict", CLOSED + " select l_orderkey, l_linenumber, round(icept + slope * l_quantity, 3) prediction from lineitem, c", 3)
def _(s, d):
    df = lineitem(s, d, "l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity")
    return regression.linear(df, "l_extendedprice ~ l_quantity").predict(df).select("l_orderkey", "l_linenumber", "prediction")


@query("ols_influence", CLOSED + """, e as (select l_orderkey, l_linenumber, l_extendedprice - icept - slope * l_quantity e, 1 / n + (l_quantity - mx) ^ 2 / sxx h, (syy - slope * sxy) / (n - 2) s2 from lineitem, c)
select l_orderkey, l_linenumber, round(h * 1e3, 6) leverage, round(e / sqrt(s2 * (1 - h)), 5) studentised, round(e * e / (s2 * (1 - h)) * h / (1 - h) / 2 * 1e3, 5) cooks_distance from e""", 6)  # fmt: skip
def _(s, d):
    df = lineitem(s, d, "l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity")
    out = regression.influence(regression.linear(df, "l_extendedprice ~ l_quantity"), df, ["l_orderkey", "l_linenumber"])
    return out.select("l_orderkey", "l_linenumber", (F.col("leverage") * 1e3).alias("leverage"), F.round("studentised", 5).alias("studentised"), F.round(F.col("cooks_distance") * 1e3, 5).alias("cooks_distance"))


@query("ols_cluster", CLOSED + """, u as (select l_suppkey, sum((l_extendedprice - icept - slope * l_quantity) * (l_quantity - mx)) u, any_value(sxx) sxx, any_value(n) n from lineitem, c group by 1)
select round(sqrt(sum(u * u) / any_value(sxx) ^ 2 * (count(*) / (count(*) - 1) * (any_value(n) - 1) / (any_value(n) - 2))), 6) std_err from u""")  # fmt: skip
def _(s, d):
    return regression.linear(lineitem(s, d, "l_extendedprice", "l_quantity", "l_suppkey"), "l_extendedprice ~ l_quantity", cov="cluster", groups="l_suppkey").coef.where("term = 'l_quantity'").select("std_err")


@query("ols_hac", f"""with {DAILY}, p as (select day, x, lag(x) over (order by day) p from daily), q as (select * from p where p is not null), m as (select avg(p) mp, avg(x) mx, regr_slope(x, p) b, sum(p * p) - count(*) * avg(p) ^ 2 sxx from q),
u as (select day, (x - mx - b * (p - mp)) * (p - mp) u, sxx from q, m), l as (select u, sxx, lag(u, 1) over w a, lag(u, 2) over w b from u window w as (order by day)) select round(sqrt((sum(u * u) + 2 * (2 / 3 * sum(u * a) + 1 / 3 * sum(u * b))) / any_value(sxx) ^ 2), 6) std_err from l""")  # fmt: skip
def _(s, d):
    x = series.lagmat(daily(s, d), "x", "day", 1).na.drop()
    return regression.linear(x, "x ~ x_l1", cov="HAC", order_by="day", maxlags=2).coef.where("term = 'x_l1'").select("std_err")


@query("gls_blocks", places=4)
def _(s, d):
    n = table(s, d, "nation", "n_nationkey", "n_regionkey").join(table(s, d, "supplier", "s_nationkey", "s_suppkey", "s_acctbal"), F.col("n_nationkey") == F.col("s_nationkey")).groupBy("n_nationkey", "n_regionkey").agg(F.avg("s_acctbal").alias("y"))
    import numpy as np

    return regression.gls(n, "y ~ 1", 0.5 * np.eye(25) + 0.5, "n_nationkey", ["n_regionkey"]).coef.select("term", "coef")


def _scoring(source: str, mu: str, slope: str, variance: str, start: str) -> str:
    """SQL of a generalised linear model with one regressor by Fisher scoring over grouped data (x, n rows, s sum of y); slope is the derivative of mu by eta."""
    m, k, v = (t.format(e="(b0 + b1 * x)") for t in (mu, slope, variance))
    w, r = f"(n * ({k}) ^ 2 / ({v}))", f"((s - n * ({m})) * ({k}) / ({v}))"
    cells = f"sum({w}) a, sum({w} * x) b, sum({w} * x * x) c, sum({r}) u, sum({r} * x) z"
    return f"""with recursive g as materialized ({source}), it as (select 0 i, ({start})::double b0, 0.0::double b1, 0.0::double v0, 0.0::double v1 union all
select i + 1, b0 + (c * u - b * z) / (a * c - b * b), b1 + (a * z - b * u) / (a * c - b * b), c / (a * c - b * b), a / (a * c - b * b) from (select i, b0, b1, {cells} from it, g where i < 40 group by i, b0, b1))
select unnest(['Intercept', 'x']) term, round(unnest([b0, b1]), 5) coef, round(unnest([sqrt(v0), sqrt(v1)]), 5) std_err from it where i = 40"""


_BY_DISCOUNT = "select l_discount x, count(*) n, sum({y})::double s from lineitem group by 1"
_RETURNED = _BY_DISCOUNT.format(y="(l_returnflag = 'R')::int")
_MODELS = {
    "binomial_logit": (_RETURNED, "1 / (1 + exp(-{e}))", "exp(-{e}) / (1 + exp(-{e})) ^ 2", "exp(-{e}) / (1 + exp(-{e})) ^ 2", "-1", "r"),
    "binomial_cloglog": (_RETURNED, "1 - exp(-exp({e}))", "exp({e}) * exp(-exp({e}))", "(1 - exp(-exp({e}))) * exp(-exp({e}))", "-1", "r"),
    "binomial_log": (_RETURNED, "exp({e})", "exp({e})", "exp({e}) * (1 - exp({e}))", "-1.4", "r"),
    "poisson_log": (_BY_DISCOUNT.format(y="l_linenumber"), "exp({e})", "exp({e})", "exp({e})", "1", "l_linenumber"),
    "poisson_sqrt": (_BY_DISCOUNT.format(y="l_linenumber"), "{e} * {e}", "2 * {e}", "{e} * {e}", "1.7", "l_linenumber"),
    "negative_binomial_log": (_BY_DISCOUNT.format(y="l_linenumber"), "exp({e})", "exp({e})", "exp({e}) + exp({e}) ^ 2", "1", "l_linenumber"),
}
for _name, (_source, _mu, _slope, _var, _start, _y) in _MODELS.items():
    _family, _link = _name.rsplit("_", 1)

    @query(f"glm_{_name}", _scoring(_source, _mu, _slope, _var, _start), 5)
    def _(s, d, family=_family, link=_link, y=_y):
        df = lineitem(s, d, "l_returnflag", "l_linenumber", "l_discount").select(F.col("l_discount").alias("x"), "l_linenumber", (F.col("l_returnflag") == "R").cast("int").alias("r"))
        return glm.glm(df, f"{y} ~ x", family, link).coef.select("term", "coef", "std_err")


for _name, _spec in (("logit", _MODELS["binomial_logit"]), ("poisson", _MODELS["poisson_log"])):

    @query(f"discrete_{_name}", _scoring(*_spec[:5]), 5)
    def _(s, d, name=_name, y=_spec[5]):
        df = lineitem(s, d, "l_returnflag", "l_linenumber", "l_discount").select(F.col("l_discount").alias("x"), "l_linenumber", (F.col("l_returnflag") == "R").cast("int").alias("r"))
        return getattr(discrete, name)(df, f"{y} ~ x").coef.select("term", "coef", "std_err")


@query("mnlogit_saturated", "with g as (select l_linestatus s, count(*) filter (l_returnflag = 'A') a, count(*) filter (l_returnflag = 'N') n, count(*) filter (l_returnflag = 'R') r from lineitem where l_linestatus = 'F' group by 1) select unnest(['N:Intercept', 'R:Intercept']) term, round(unnest([ln(n / a), ln(r / a)]), 5) coef, round(unnest([sqrt(1 / n + 1 / a), sqrt(1 / r + 1 / a)]), 5) std_err from g", 5)
def _(s, d):
    df = lineitem(s, d, "l_returnflag", "l_linestatus").where("l_linestatus = 'F'")
    return discrete.mnlogit(df, "l_returnflag ~ 1").coef.select("term", "coef", "std_err")


@query("ordered_logit", "with g as (select count(*) n, count(*) filter (l_returnflag = 'A') a, count(*) filter (l_returnflag <> 'R') b from lineitem) select unnest(['A/N', 'N/R']) term, round(unnest([ln(a / (n - a)), ln(ln(b / (n - b)) - ln(a / (n - a)))]), 5) coef from g", 5)
def _(s, d):
    return discrete.ordered(lineitem(s, d, "l_returnflag"), "l_returnflag ~ 1", "logit").coef.select("term", "coef")


@query("probit_saturated", "select round(avg((l_returnflag = 'R')::int), 5) p, count(*) n from lineitem", 5)
def _(s, d):
    df = lineitem(s, d, "l_returnflag").select((F.col("l_returnflag") == "R").cast("int").alias("r"))
    fit = discrete.probit(df, "r ~ 1")
    return s.createDataFrame([(float(dist.norm_cdf(fit.params[0])), fit.nobs)], "p double, n bigint")


@query("zip_moments", "with recursive g as (select count(*) n, count(*) filter (l_linenumber <= 2) z, sum(greatest(l_linenumber - 2, 0)) s from lineitem), it as (select 0 i, 2.0::double mu union all select i + 1, s / (n - z) * (1 - exp(-mu)) from it, g where i < 200) select round(mu, 4) mu, round(1 - (1 - z / n) / (1 - exp(-mu)), 4) zero from it, g where i = 200", 4)
def _(s, d):
    df = lineitem(s, d, "l_linenumber").select(F.greatest(F.col("l_linenumber") - 2, F.lit(0)).alias("y"))
    fit = discrete.zero_inflated_poisson(df, "y ~ 1")
    import math

    return s.createDataFrame([(math.exp(fit.params[1]), 1 / (1 + math.exp(-fit.params[0])))], "mu double, zero double")


@query("truncated_poisson", "with recursive g as (select avg(l_linenumber) m from lineitem), it as (select 0 i, 2.0::double mu union all select i + 1, m * (1 - exp(-mu)) from it, g where i < 300) select round(mu, 4) mu from it where i = 300", 4)
def _(s, d):
    import math

    return s.createDataFrame([(math.exp(discrete.truncated_poisson(lineitem(s, d, "l_linenumber"), "l_linenumber ~ 1").params[0]),)], "mu double")


@query("hurdle_poisson", "with recursive g as (select count(*) n, count(*) filter (l_linenumber <= 2) z, sum(greatest(l_linenumber - 2, 0)) / count(*) filter (l_linenumber > 2) m from lineitem), it as (select 0 i, 2.0::double mu union all select i + 1, m * (1 - exp(-mu)) from it, g where i < 300) select round(-ln(z / n), 4) jump, round(mu, 4) mu from it, g where i = 300", 4)
def _(s, d):
    import math

    df = lineitem(s, d, "l_linenumber").select(F.greatest(F.col("l_linenumber") - 2, F.lit(0)).alias("y"))
    fit = discrete.hurdle_poisson(df, "y ~ 1")
    return s.createDataFrame([(math.exp(fit.params[0]), math.exp(fit.params[1]))], "jump double, mu double")


_FIRST = f"with {DAILY}, p as (select day, x, lag(x) over (order by day) p from daily), q as (select * from p where p is not null)"


@query("autoreg_1", _FIRST + ", m as (select count(*) n, regr_slope(x, p) b, regr_intercept(x, p) a, regr_sxx(x, p) sxx, regr_syy(x, p) - regr_slope(x, p) * regr_sxy(x, p) ssr from q) select unnest(['const', 'x.L1', 'sigma2']) term, round(unnest([a, b, ssr / n]), 6) coef from m")
def _(s, d):
    return autoregression.autoreg(daily(s, d), "x", "day", 1).where("term in ('const', 'x.L1', 'sigma2')").select("term", "coef")


@query("adfuller_0", _FIRST + ", r as (select x - p d, p from q), m as (select count(*) n, regr_slope(d, p) b, regr_sxx(d, p) sxx, regr_syy(d, p) - regr_slope(d, p) * regr_sxy(d, p) ssr from r) select round(b / sqrt(ssr / (n - 2) / sxx), 4) statistic, n::int nobs, round(-3.43035 - 6.5393 / n - 16.786 / n ^ 2 - 79.433 / n ^ 3, 6) crit_1 from m")
def _(s, d):
    return autoregression.adfuller(daily(s, d), "x", "day", 0, "c", None).select(F.round("statistic", 4).alias("statistic"), "nobs", "crit_1")


@query("granger_1", f"""with {DAILY}, y as (select o_orderdate::date::varchar as day, count(*)::double c from orders group by 1), b as (select day, x, c from daily join y using (day)), l as (select x y, lag(x) over (order by day) p, lag(c) over (order by day) q from b), k as (select y - avg(y) over () y, p - avg(p) over () p, q - avg(q) over () q from l where p is not null),
s as (select count(*) n, sum(y * y) yy, sum(p * p) a, sum(p * q) b, sum(q * q) c, sum(p * y) u, sum(q * y) v from k), f as (select n, yy - u * u / a small, yy - (c * u * u - 2 * b * u * v + a * v * v) / (a * c - b * b) big from s)
select 1 lag, round((small - big) / (big / (n - 3)), 4) f, round(n * (small - big) / big, 4) chi2, (n - 3)::int df_denom from f""")  # fmt: skip
def _(s, d):
    x = table(s, d, "orders", "o_orderdate").groupBy(F.to_date("o_orderdate").cast("string").alias("day")).agg(F.count("*").cast("double").alias("c")).join(daily(s, d), "day")
    return autoregression.granger(x, "x", "c", "day", 1).select("lag", F.round("f", 4).alias("f"), F.round("chi2", 4).alias("chi2"), "df_denom")


@query("var_1", f"""with {DAILY}, y as (select o_orderdate::date::varchar as day, count(*)::double c from orders group by 1), b as (select day, x, c from daily join y using (day)), l as (select x, c, lag(x) over (order by day) p, lag(c) over (order by day) q from b), k as (select x - avg(x) over () x, c - avg(c) over () c, p - avg(p) over () p, q - avg(q) over () q from l where p is not null),
s as (select sum(p * p) a, sum(p * q) b, sum(q * q) c, sum(p * x) ux, sum(q * x) vx, sum(p * c) uc, sum(q * c) vc from k)
select unnest(['x:L1.x', 'x:L1.c', 'c:L1.x', 'c:L1.c']) term, round(unnest([(c * ux - b * vx) / (a * c - b * b), (a * vx - b * ux) / (a * c - b * b), (c * uc - b * vc) / (a * c - b * b), (a * vc - b * uc) / (a * c - b * b)]), 5) coef from s""", 5)  # fmt: skip
def _(s, d):
    x = table(s, d, "orders", "o_orderdate").groupBy(F.to_date("o_orderdate").cast("string").alias("day")).agg(F.count("*").cast("double").alias("c")).join(daily(s, d), "day")
    f = autoregression.var(x, ["x", "c"], "day", 1)
    return s.createDataFrame([(f"{e}:{t}", float(f.params[i, j])) for j, e in enumerate(f.names) for i, t in enumerate(f.terms) if t != "const"], "term string, coef double")


@query("ccf", f"""with {DAILY}, y as (select o_orderdate::date::varchar as day, count(*)::double c from orders group by 1), b as (select row_number() over (order by day) i, x - avg(x) over () x, c - avg(c) over () c, count(*) over () n from daily join y using (day)), v as (select sqrt(avg(x * x) * avg(c * c)) s from b)
select k::int lag, round(sum(p.x * q.c) / (any_value(p.n) - k) / any_value(s), 6) ccf from range(4) r(k), b p, b q, v where q.i = p.i - k group by k""")  # fmt: skip
def _(s, d):
    x = table(s, d, "orders", "o_orderdate").groupBy(F.to_date("o_orderdate").cast("string").alias("day")).agg(F.count("*").cast("double").alias("c")).join(daily(s, d), "day")
    return series.ccf(x, "x", "c", "day", 3)


@query("cox_binary", f"with recursive {LIFE}, a as materialized (select t, sum(e) d, sum(e * (g = 'O')::int) d1, count(*) c, sum((g = 'O')::int) c1 from life group by 1), b as materialized (select d, d1, sum(c) over w n, sum(c1) over w n1 from a window w as (order by t desc rows unbounded preceding)), it as (select 0 i, 0.0::double b, 0.0::double h union all select i + 1, b + sum(d1 - d * n1 * exp(b) / (n - n1 + n1 * exp(b))) / sum(d * n1 * exp(b) * (n - n1) / (n - n1 + n1 * exp(b)) ^ 2), sum(d * n1 * exp(b) * (n - n1) / (n - n1 + n1 * exp(b)) ^ 2) from it, (select * from b where d > 0) z(d, d1, n, n1) where i < 30 group by i, b) select 'late' term, round(b, 4) coef, round(1 / sqrt(h), 4) std_err from it where i = 30", 4)
def _(s, d):
    x = life(s, d).withColumn("late", (F.col("g") == "O").cast("int"))
    return survival.cox(x, "t", "e", "late").coef.select("term", "coef", "std_err")


@query("cumulative_incidence", f"with life as (select datediff('day', o_orderdate, l_shipdate) t, case l_returnflag when 'R' then 1 when 'A' then 2 else 0 end k from lineitem join orders on o_orderkey = l_orderkey), a as (select t::double t, count(*) c, count(*) filter (k > 0) d, count(*) filter (k = 1) d1, count(*) filter (k = 2) d2 from life group by 1), b as (select *, sum(c) over (order by t desc rows unbounded preceding) n from a), f as (select *, coalesce(exp(sum(ln(1 - d / n)) over (order by t rows between unbounded preceding and 1 preceding)), 1) s from b where d > 0), i as (select t, sum(s * d1 / n) over w i1, sum(s * d2 / n) over w i2 from f window w as (order by t rows unbounded preceding)) select 1 cause, t, round(i1, 6) incidence from i union all select 2, t, round(i2, 6) from i")
def _(s, d):
    o = table(s, d, "orders", "o_orderkey", "o_orderdate")
    x = lineitem(s, d, "l_orderkey", "l_shipdate", "l_returnflag").join(o, F.col("o_orderkey") == F.col("l_orderkey"))
    x = x.select(F.date_diff("l_shipdate", "o_orderdate").alias("t"), F.when(F.col("l_returnflag") == "R", 1).when(F.col("l_returnflag") == "A", 2).otherwise(0).alias("k"))
    return survival.cumulative_incidence(x, "t", "k").select("cause", "t", "incidence")


def _values(s: SparkSession, d: str) -> DataFrame:
    return lineitem(s, d, "l_discount", "l_quantity").groupBy("l_discount").agg(F.min("l_quantity").alias("q")).select((F.col("l_discount") * 10 + 0.05).alias("x"), (F.col("l_discount") * 100).cast("int").cast("double").alias("k"))


_VALUES = "with v as (select distinct l_discount * 10 + 0.05 x, round(l_discount * 100)::int::double k from lineitem)"
_B = "exp(lgamma({a}) + lgamma({b}) - lgamma({a} + {b}))"
#: Distribution, then SQL of its density (of x, or of k for counts), and of its distribution function where it is a closed form.
_FAMILIES = {
    "normal": (dist.Normal(0.3, 0.8), "exp(-0.5 * ((x - 0.3) / 0.8) ^ 2) / 0.8 / sqrt(2 * pi())", "case when x >= 0.3 then 1 - {p} / 2 else {p} / 2 end".format(p=normal_p("((x - 0.3) / 0.8)"))),
    "student_t": (dist.StudentT(5), "exp(lgamma(3) - lgamma(2.5)) / sqrt(5 * pi()) * (1 + x * x / 5) ^ -3", f"1 - {t_p('x', '5.0')} / 2"),
    "chi2": (dist.ChiSquared(4), "x / 4 * exp(-x / 2)", "1 - exp(-x / 2) * (1 + x / 2)"),
    "f": (dist.FDist(4, 10), "(0.4 * x) ^ 2 * (1 + 0.4 * x) ^ -7 / x / " + _B.format(a="2.0", b="5.0"), "1 - (10 / (10 + 4 * x)) ^ 5 * (1 + 5 * (4 * x / (10 + 4 * x)))"),
    "gamma": (dist.Gamma(2, 0.5), "4 * x * exp(-2 * x)", "1 - exp(-2 * x) * (1 + 2 * x)"),
    "beta": (dist.Beta(2, 3), "case when x between 0 and 1 then 12 * x * (1 - x) ^ 2 else 0 end", "case when x >= 1 then 1 else x * x * (6 - 8 * x + 3 * x * x) end"),
    "exponential": (dist.Exponential(1.5), "1.5 * exp(-1.5 * x)", "1 - exp(-1.5 * x)"),
    "lognormal": (dist.LogNormal(0.2, 0.7), "exp(-0.5 * ((ln(x) - 0.2) / 0.7) ^ 2) / (x * 0.7 * sqrt(2 * pi()))", None),
    "uniform": (dist.Uniform(0.1, 0.9), "case when x between 0.1 and 0.9 then 1.25 else 0 end", "least(greatest((x - 0.1) / 0.8, 0), 1)"),
    "weibull": (dist.WeibullMin(1.7, 0.6), "1.7 / 0.6 * (x / 0.6) ^ 0.7 * exp(-((x / 0.6) ^ 1.7))", "1 - exp(-((x / 0.6) ^ 1.7))"),
    "laplace": (dist.Laplace(0.4, 0.3), "exp(-abs(x - 0.4) / 0.3) / 0.6", "case when x < 0.4 then exp((x - 0.4) / 0.3) / 2 else 1 - exp((0.4 - x) / 0.3) / 2 end"),
    "logistic": (dist.Logistic(0.4, 0.3), "exp(-(x - 0.4) / 0.3) / 0.3 / (1 + exp(-(x - 0.4) / 0.3)) ^ 2", "1 / (1 + exp(-(x - 0.4) / 0.3))"),
    "cauchy": (dist.Cauchy(0.4, 0.3), "1 / (pi() * 0.3 * (1 + ((x - 0.4) / 0.3) ^ 2))", "0.5 + atan((x - 0.4) / 0.3) / pi()"),
    "pareto": (dist.Pareto(2.5, 0.2), "case when x >= 0.2 then 2.5 * 0.2 ^ 2.5 / x ^ 3.5 else 0 end", "case when x >= 0.2 then 1 - (0.2 / x) ^ 2.5 else 0 end"),
    "poisson": (dist.Poisson(3.5), "exp(k * ln(3.5) - 3.5 - lgamma(k + 1))", None),
    "binomial": (dist.Binomial(12, 0.3), "exp(lgamma(13) - lgamma(k + 1) - lgamma(13 - k) + k * ln(0.3) + (12 - k) * ln(0.7))", None),
    "geometric": (dist.Geometric(0.25), "case when k >= 1 then 0.25 * 0.75 ^ (k - 1) else 0 end", "1 - 0.75 ^ k"),
    "negative_binomial": (dist.NegativeBinomial(3, 0.4), "(k + 1) * (k + 2) / 2 * 0.4 ^ 3 * 0.6 ^ k", None),
}
for _name, (_d, _pdf, _cdf) in _FAMILIES.items():
    _x = "k" if _d.whole else "x"
    _sums = f"(select sum({_pdf.replace('k', 'j.k')}) from (select i::double k from range(0, 40) t(i)) j where j.k <= v.k)" if _d.whole and not _cdf else _cdf
    _cells = f"round({_pdf}, 6) pdf" + (f", round({_sums}, 6) cdf, round(1 - ({_sums}), 6) sf" if _sums and _name != "binomial" else "")
    _back = f", round({_x}, 6) again" if _cdf and not _d.whole and _name not in ("uniform", "beta", "pareto") else ""

    @query(f"dist_{_name}", f"{_VALUES} select round({_x}, 6) point, {_cells}{_back} from v")
    def _(s, d, law=_d, x=_x, full="cdf" in _cells, back=bool(_back)):
        v = _values(s, d).select(F.col(x).alias("point"))
        out = v.select("point", dist.column(law, "pdf", "point").alias("pdf"), *((dist.column(law, "cdf", "point").alias("cdf"), dist.column(law, "sf", "point").alias("sf")) if full else ()))
        return out.withColumn("again", dist.column(law, "ppf", "cdf")) if back else out


@query("tall_qr", "select round(sqrt(sum(l_quantity ^ 2)), 5) r00, round(sum(l_quantity * l_discount) / sqrt(sum(l_quantity ^ 2)), 5) r01, round(sqrt(sum(l_discount ^ 2) - sum(l_quantity * l_discount) ^ 2 / sum(l_quantity ^ 2)), 5) r11 from lineitem", 5)
def _(s, d):
    r = linalg.tall_r(lineitem(s, d, "l_quantity", "l_discount"), ["l_quantity", "l_discount"])
    return s.createDataFrame([(float(r[0, 0]), float(r[0, 1]), float(r[1, 1]))], "r00 double, r01 double, r11 double")


@query("tall_lstsq", CLOSED + " select round(icept, 3) b0, round(slope, 4) b1 from c", 4)
def _(s, d):
    b, _ = linalg.tall_lstsq(lineitem(s, d, "l_quantity", "l_extendedprice").withColumn("one", F.lit(1.0)), "l_extendedprice", ["one", "l_quantity"])
    return s.createDataFrame([(round(float(b[0]), 3), float(b[1]))], "b0 double, b1 double")


@query("tukey_hsd", _GROUPS + ", s as (select sum((n - 1) * v) / sum(n - 1) s2 from g) select a.c_mktsegment group1, b.c_mktsegment group2, round(b.m - a.m, 6) meandiff, round(abs(b.m - a.m) / sqrt(s2 / 2 * (1 / a.n + 1 / b.n)), 6) q from g a join g b on a.c_mktsegment < b.c_mktsegment, s")
def _(s, d):
    return hypothesis.tukey_hsd(table(s, d, "customer", "c_acctbal", "c_mktsegment"), "c_acctbal", "c_mktsegment").select("group1", "group2", "meandiff", "q")


@query("ttest_mean_weighted", "with m as (select sum(l_quantity) w, sum(l_quantity * l_discount) / sum(l_quantity) mu from lineitem) select round((any_value(mu) - 0.05) / sqrt(sum(l_quantity * (l_discount - mu) ^ 2) / (any_value(w) - 1) / any_value(w)), 5) tstat, any_value(w) - 1 df from lineitem, m", 5)
def _(s, d):
    return hypothesis.ttest_mean(lineitem(s, d, "l_discount", "l_quantity"), "l_discount", 0.05, "l_quantity").select("tstat", "df")


@query("ttost_ind", _TWO + " select round((m1 - m2 + 500) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) * (1 / n1 + 1 / n2)), 6) t_low, round((m1 - m2 - 500) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) * (1 / n1 + 1 / n2)), 6) t_high from g")
def _(s, d):
    return hypothesis.ttost_ind(lineitem(s, d, "l_extendedprice", "l_returnflag"), "l_extendedprice", "l_returnflag", "A", "R", -500, 500).select("t_low", "t_high")
