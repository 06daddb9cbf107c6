"""Linear and generalised linear models: sums of products over the data, small algebra on the driver."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyforge.functions import distributions as dist
from tallyforge.operators import summaries
from tallyforge.operators.formula import Design, design
from tallyforge.operators.likelihood import matrix, totals

COEF = "term string, coef double, std_err double, stat double, pvalue double, ci_low double, ci_high double"


#: Designs of more columns than this are multiplied in Arrow batches, not by an expression for each pair of columns.
WIDE = 12


def gram(frame: DataFrame, k: int, weight: Column | None = None, response: Column | None = None, more: list[Column] = ()) -> tuple[np.ndarray, np.ndarray, list]:
    """X'WX, X'Wy and the sums of more, in one aggregate with map-side partial sums."""
    w, y = (F.lit(1.0) if weight is None else weight), (F.col("y") if response is None else response)
    cells = [F.sum(w * F.col(f"x{i}") * F.col(f"x{j}")) for i in range(k) for j in range(i, k)] + [F.sum(w * F.col(f"x{i}") * y) for i in range(k)]
    row = list(frame.agg(*(c.alias(f"c{n}") for n, c in enumerate([*cells, *more]))).first())
    x = np.zeros((k, k))
    upper = [(i, j) for i in range(k) for j in range(i, k)]
    for (i, j), v in zip(upper, row):
        x[i, j] = x[j, i] = v or 0.0
    n = len(upper)
    return x, np.array([v or 0.0 for v in row[n : n + k]]), row[n + k :]


def dot(beta: np.ndarray) -> Column:
    return sum((F.lit(float(b)) * F.col(f"x{i}") for i, b in enumerate(beta)), F.lit(0.0))


@dataclass
class Fit:
    frame: DataFrame
    plan: Design
    params: np.ndarray
    cov: np.ndarray
    df_resid: int
    stats: dict[str, float]
    normal: bool = False
    mean = staticmethod(lambda eta: eta)
    kind = "OLS"

    @property
    def bse(self) -> np.ndarray:
        return np.sqrt(np.maximum(np.diag(self.cov), 0))

    @property
    def tvalues(self) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            return self.params / self.bse

    @property
    def pvalues(self) -> np.ndarray:
        tail = dist.norm_sf if self.normal else lambda t: dist.t_sf(t, self.df_resid)
        return np.array([2 * tail(abs(t)) if math.isfinite(t) and (self.normal or self.df_resid > 0) else math.nan for t in self.tvalues])

    def conf_int(self, alpha: float = 0.05) -> np.ndarray:
        """Lower and upper ends at level 1 - alpha."""
        q = dist.norm_ppf(1 - alpha / 2) if self.normal else dist.t_ppf(1 - alpha / 2, self.df_resid) if self.df_resid > 0 else math.nan
        return np.column_stack([self.params - q * self.bse, self.params + q * self.bse])

    def predict(self, df: DataFrame, name: str = "prediction", formula: str | None = None) -> DataFrame:
        """df with the predicted mean of each row as one more column (null where a regressor is null). Needs the columns of the model's terms."""
        eta = sum((F.lit(float(b)) * c.cast("double") for b, c in zip(self.params, self.plan.columns)), F.lit(0.0))
        return df.withColumn(name, self.mean(eta))

    def summary(self, response: str = "y") -> str:
        """Fixed-width table of the fit."""
        return summaries.regression(self, response)

    @property
    def coef(self) -> DataFrame:
        rows = [(n, *map(float, r)) for n, *r in zip(self.plan.names, self.params, self.bse, self.tvalues, self.pvalues, *self.conf_int().T)]
        return self.frame.sparkSession.createDataFrame(rows, COEF)

    @property
    def model_stats(self) -> DataFrame:
        return self.frame.sparkSession.createDataFrame([{k: float(v) for k, v in self.stats.items()}])


def inverse(x: np.ndarray) -> np.ndarray:
    """Inverse of a Gram matrix, scaled to a unit diagonal first; the pseudo-inverse where it is singular."""
    s = 1 / np.sqrt(np.where(np.diag(x) > 0, np.diag(x), 1))
    return np.linalg.pinv(x * np.outer(s, s), hermitian=True) * np.outer(s, s)


def rank_of(x: np.ndarray) -> int:
    """Rank of a Gram matrix, scaled to a unit diagonal."""
    d = np.sqrt(np.maximum(np.diag(x), 1e-300))
    return int(np.linalg.matrix_rank(x / np.outer(d, d), hermitian=True)) if len(x) else 0


def wide_gram(frame: DataFrame, k: int, mean: dict[str, float], extra: tuple[str, ...] = ()) -> np.ndarray:
    """Weighted products of (x0, ..., y) less their means, as one matrix of k + 1 columns, by Arrow batches."""
    names = [*(f"x{i}" for i in range(k)), "y"]
    centre = np.array([mean[c] for c in names])

    def step(batch: pa.RecordBatch) -> np.ndarray:
        z, w = matrix(batch, names) - centre, matrix(batch, ["w"])[:, 0]
        return (z.T @ (z * w[:, None])).ravel()

    return totals(frame, step, (k + 1) ** 2).reshape(k + 1, k + 1)


def linear(df: DataFrame, formula: str, weights: str | None = None, cov: str = "nonrobust", groups: str | None = None, order_by: str | None = None, maxlags: int = 0, correction: bool = True, partition_by: list[str] = ()) -> Fit:
    """Least squares, weighted by a column's values, with covariance nonrobust, HC0, HC1, HC2, HC3, HAC (Bartlett weights up to
    maxlags; needs order_by, and partition_by for panels) or cluster (by groups; correction for few of them).

    Columns are centred at their means before their products are summed, which keeps precision for data far
    from zero. Three aggregates over the data, whatever its size; wide designs are multiplied in Arrow batches. With as
    many coefficients as rows the variances are NaN. Rows with a null or NaN are left out; none left is a ValueError.
    """
    plan = design(df, formula)
    k = len(plan.names)
    more = [(F.col(weights).cast("double") if weights else F.lit(1.0)).alias("w")]
    more += [F.col(groups).cast("string").alias("g_")] if groups else []
    more += [F.col(order_by).alias("o_"), F.struct(*(F.col(c) for c in partition_by), F.lit(0)).alias("s_")] if order_by else []
    frame = plan.frame(df, *more)
    centre = plan.names[:1] == ["Intercept"]
    w = F.col("w")
    first = frame.agg(F.count("*").alias("n"), F.sum("w").alias("w"), F.sum(F.log("w")).alias("lw"), F.sum(w * F.col("y")).alias("y"), *(F.sum(w * F.col(f"x{i}")).alias(f"x{i}") for i in range(k))).first()
    n, total = first["n"], first["w"]
    if not n:
        raise ValueError("no complete row")
    mean = {c: (first[c] / total if centre and c != "x0" else 0.0) for c in ["y", *(f"x{i}" for i in range(k))]}
    moved = frame.select(*(c for c in frame.columns if c not in mean), *((F.col(c) - F.lit(mean[c])).alias(c) for c in mean))
    if k > WIDE:
        both = wide_gram(frame, k, mean)
        x, xy = both[:k, :k], both[:k, k]
    else:
        x, xy, _ = gram(moved, k, w)
    inv = inverse(x)
    beta = inv @ xy
    rank = rank_of(x)
    back = np.eye(k)  # from centred to given columns: only the intercept changes
    if centre:
        back[0, 1:] = [-mean[f"x{i}"] for i in range(1, k)]
    dof = n - rank
    e = F.col("y") - dot(beta)
    ssr, tss = moved.agg(F.sum(w * e * e), F.sum(w * F.col("y") * F.col("y"))).first()
    scale = ssr / dof if dof > 0 else math.nan
    if cov == "nonrobust":
        table = inv * scale
    elif cov in ("HC0", "HC1", "HC2", "HC3"):
        table = inv @ heteroscedastic(moved, k, beta, inv, {"HC0": 0, "HC1": 0, "HC2": 1, "HC3": 2}[cov]) @ inv * (n / dof if cov == "HC1" and dof > 0 else 1)
    elif cov == "HAC":
        if not order_by:
            raise ValueError("HAC needs order_by")
        table = inv @ autocorrelated(moved, k, beta, maxlags) @ inv
    elif cov == "cluster":
        if not groups:
            raise ValueError("cluster needs groups")
        meat, g = clustered(moved, k, beta)
        table = inv @ meat @ inv * (g / (g - 1) * (n - 1) / dof if correction and g > 1 and dof > 0 else 1)
    else:
        raise ValueError(f"covariance {cov} isn't known")
    params = back @ beta
    if centre:
        params[0] += mean["y"]
    llf = -n / 2 * math.log(ssr) - n / 2 * (1 + math.log(2 * math.pi / n)) + 0.5 * (first["lw"] or 0.0) if ssr > 0 else math.inf
    dfm = rank - centre
    stats = {"nobs": n, "df_model": dfm, "df_resid": dof, "ssr": ssr, "scale": scale, "ess": tss - ssr, "centered_tss": tss, "rsquared": 1 - ssr / tss if tss else math.nan, "llf": llf, "aic": 2 * rank - 2 * llf, "bic": math.log(n) * rank - 2 * llf}
    stats["rsquared_adj"] = 1 - (n - centre) / dof * (1 - stats["rsquared"]) if dof > 0 else math.nan
    stats["mse_model"], stats["mse_resid"], stats["mse_total"] = (tss - ssr) / dfm if dfm else math.nan, scale, tss / (n - centre) if n > centre else math.nan
    stats["fvalue"] = (tss - ssr) / dfm / scale if dfm and ssr and dof > 0 else math.nan
    stats["f_pvalue"] = dist.f_sf(stats["fvalue"], dfm, dof) if math.isfinite(stats["fvalue"]) else math.nan
    d = np.sqrt(np.maximum(np.diag(x), 1e-300))
    values = np.linalg.eigvalsh(x / np.outer(d, d)) if k else np.ones(1)
    stats["condition_number"] = math.sqrt(max(values[-1], 0) / values[0]) if values[0] > 0 else math.inf
    fit = Fit(frame, plan, params, back @ table @ back.T, dof, stats)
    fit.kind = "WLS" if weights else "OLS"
    return fit


def heteroscedastic(moved: DataFrame, k: int, beta: np.ndarray, inv: np.ndarray, power: int) -> np.ndarray:
    """Sum of w^2 e^2 x x' / (1 - leverage)^power."""

    def step(batch: pa.RecordBatch) -> np.ndarray:
        x, (y, w) = matrix(batch, [f"x{i}" for i in range(k)]), matrix(batch, ["y", "w"]).T
        lever = np.einsum("ij,jk,ik->i", x, inv, x) * w
        with np.errstate(divide="ignore", invalid="ignore"):
            s = (w * (y - x @ beta)) ** 2 / (1 - lever) ** power
        return (x.T @ (x * s[:, None])).ravel()

    return totals(moved.select("y", "w", *(f"x{i}" for i in range(k))), step, k * k).reshape(k, k)


def scores(moved: DataFrame, k: int, beta: np.ndarray) -> list[Column]:
    e = F.col("w") * (F.col("y") - dot(beta))
    return [(e * F.col(f"x{i}")).alias(f"u{i}") for i in range(k)]


def autocorrelated(moved: DataFrame, k: int, beta: np.ndarray, maxlags: int) -> np.ndarray:
    """Sum over lags of Bartlett-weighted products of the scores."""
    u = moved.select("s_", "o_", *scores(moved, k, beta))
    row = Window.partitionBy("s_").orderBy("o_")
    names = [f"u{i}" for i in range(k)]
    lagged = u.select(*names, *(F.lag(c, m).over(row).alias(f"{c}_{m}") for m in range(1, maxlags + 1) for c in names))

    def step(batch: pa.RecordBatch) -> np.ndarray:
        now = matrix(batch, names)
        out = now.T @ now
        for m in range(1, maxlags + 1):
            then = np.nan_to_num(matrix(batch, [f"{c}_{m}" for c in names]))
            part = now.T @ then * (1 - m / (maxlags + 1))
            out += part + part.T
        return out.ravel()

    return totals(lagged, step, k * k).reshape(k, k)


def clustered(moved: DataFrame, k: int, beta: np.ndarray) -> tuple[np.ndarray, int]:
    """Sum over groups of the products of summed scores, and the number of groups."""
    u = moved.select("g_", *scores(moved, k, beta)).groupBy("g_").agg(*(F.sum(f"u{i}").alias(f"u{i}") for i in range(k)))

    def step(batch: pa.RecordBatch) -> np.ndarray:
        z = matrix(batch, [f"u{i}" for i in range(k)])
        return np.append((z.T @ z).ravel(), len(z))

    got = totals(u.drop("g_"), step, k * k + 1)
    return got[:-1].reshape(k, k), int(got[-1])


def gls(df: DataFrame, formula: str, sigma: np.ndarray, order_by: str, blocks: list[str] = ()) -> Fit:
    """Generalised least squares: errors of a block's rows, in order, have covariance sigma (its leading part where a block is
    shorter); blocks are independent. Without blocks all rows are one, and sigma must have a row for each of them.

    Each block is whitened in its own group by the inverse of sigma's Cholesky factor.
    """
    sigma = np.asarray(sigma, float)
    plan = design(df, formula)
    k = len(plan.names)
    names = ["y", *(f"x{i}" for i in range(k))]
    frame = plan.frame(df, F.col(order_by).alias("o_"), *(F.col(c).alias(f"b{i}_") for i, c in enumerate(blocks)))

    def whiten(table: pa.Table) -> pa.Table:
        z = np.column_stack([table.column(c).to_numpy() for c in names])[np.argsort(table.column("o_").to_pandas().to_numpy(), kind="stable")]
        if len(z) > len(sigma):
            raise ValueError("sigma has fewer rows than a block")
        low = np.linalg.cholesky(sigma[: len(z), : len(z)])
        z = np.linalg.solve(low, z)
        return pa.table({**{c: z[:, i] for i, c in enumerate(names)}, "half": np.full(len(z), np.log(np.diag(low)).sum() / len(z))})

    white = frame.groupBy(*(f"b{i}_" for i in range(len(blocks)))).applyInArrow(whiten, ", ".join(f"{c} double" for c in [*names, "half"])).persist()
    try:
        x, xy, (n, half) = gram(white, k, more=[F.count("*"), F.sum("half")])
        if not n:
            raise ValueError("no complete row")
        inv, rank = inverse(x), rank_of(x)
        beta = inv @ xy
        e = F.col("y") - dot(beta)
        ssr = white.agg(F.sum(e * e)).first()[0]
    finally:
        white.unpersist()
    dof = n - rank
    scale = ssr / dof if dof > 0 else math.nan
    llf = -n / 2 * math.log(ssr) - n / 2 * (1 + math.log(2 * math.pi / n)) - half if ssr > 0 else math.inf
    fit = Fit(frame, plan, beta, inv * scale, dof, {"nobs": n, "df_model": rank - 1, "df_resid": dof, "ssr": ssr, "scale": scale, "llf": llf, "aic": 2 * rank - 2 * llf, "bic": math.log(n) * rank - 2 * llf})
    fit.kind = "GLS"
    return fit


def glsar(df: DataFrame, formula: str, order: int, order_by: str, partition_by: list[str] = (), rounds: int = 50, tolerance: float = 1e-8) -> tuple[Fit, np.ndarray, bool, int]:
    """Least squares with autoregressive errors: coefficients from lag-whitened rows (each series loses its first order rows) and
    Yule-Walker coefficients of the residuals by turns, until they rest. Returns fit, rho, converged, rounds."""
    if order < 1:
        raise ValueError("the order must be 1 or more")
    plan = design(df, formula)
    k = len(plan.names)
    names = ["y", *(f"x{i}" for i in range(k))]
    frame = plan.frame(df, F.col(order_by).alias("o_"), F.struct(*(F.col(c) for c in partition_by), F.lit(0)).alias("s_"))
    row = Window.partitionBy("s_").orderBy("o_")
    lagged = frame.select("s_", "o_", *names, *(F.lag(c, m).over(row).alias(f"{c}_{m}") for m in range(1, order + 1) for c in names)).persist()
    rho, beta, done, i = np.zeros(order), None, False, 0
    try:
        for i in range(1, rounds + 1):
            rest = lagged if not rho.any() else lagged.where(f"y_{order} is not null").select(*((F.col(c) - sum(F.lit(float(r)) * F.col(f"{c}_{m + 1}") for m, r in enumerate(rho))).alias(c) for c in names))
            x, xy, (n, yy) = gram(rest, k, more=[F.count("*"), F.sum(F.col("y") * F.col("y"))])
            inv = inverse(x)
            new = inv @ xy
            done = beta is not None and np.abs(new - beta).max() <= tolerance * (1 + np.abs(new).max())
            beta = new
            if done or i == rounds:
                break
            e = lambda m: F.col(f"y_{m}" if m else "y") - sum((F.lit(float(b)) * F.col(f"x{j}_{m}" if m else f"x{j}") for j, b in enumerate(beta)), F.lit(0.0))  # noqa: E731, B023
            got = lagged.agg(F.count("*"), *(F.sum(e(0) * e(m)) for m in range(order + 1))).first()
            r = np.array([(v or 0.0) / (got[0] - m) for m, v in enumerate(got[1:])])
            rho = np.linalg.solve(r[np.abs(np.subtract.outer(range(order), range(order)))], r[1:])
    finally:
        lagged.unpersist()
    rank = rank_of(x)
    ssr = yy - 2 * beta @ xy + beta @ x @ beta
    fit = Fit(frame, plan, beta, inv * ssr / (n - rank), n - rank, {"nobs": n, "df_resid": n - rank, "ssr": ssr, "scale": ssr / (n - rank)})
    return fit, rho, bool(done), i


def quantreg(df: DataFrame, formula: str, q: float = 0.5, rounds: int = 1000, tolerance: float = 1e-6) -> Fit:
    """Conditional quantile by iteratively reweighted least squares on the check loss; robust covariance from an Epanechnikov
    kernel with Hall and Sheather's bandwidth. stats has sparsity, bandwidth, iterations and converged."""
    if not 0 < q < 1:
        raise ValueError("q must lie between 0 and 1")
    plan = design(df, formula)
    k = len(plan.names)
    columns = [f"x{i}" for i in range(k)]
    frame = plan.frame(df).persist()
    try:
        x, xy, (n,) = gram(frame, k, more=[F.count("*")])
        if not n:
            raise ValueError("no complete row")
        beta, done, i = inverse(x) @ xy, False, 0
        weight = None
        for i in range(1, rounds + 1):

            def step(batch: pa.RecordBatch) -> np.ndarray:
                z, y = matrix(batch, columns), matrix(batch, ["y"])[:, 0]
                e = y - z @ beta
                e = np.where(np.abs(e) < 1e-6, np.where(e >= 0, 1e-6, -1e-6), e)
                s = np.where(e < 0, 1 - q, q) / np.abs(e)
                zs = z * s[:, None]
                return np.concatenate([(z.T @ zs).ravel(), zs.T @ y])

            got = totals(frame, step, k * k + k)
            weight = got[: k * k].reshape(k, k)
            new = np.linalg.solve(weight, got[k * k :]) if np.linalg.matrix_rank(weight) == k else np.linalg.pinv(weight) @ got[k * k :]
            done = np.abs(new - beta).max() <= tolerance
            beta = new
            if done:
                break
        e = F.col("y") - dot(beta)
        spread = frame.agg(F.percentile(e, F.array(F.lit(0.25), F.lit(0.75))), F.stddev_pop(e)).first()
        z = dist.norm_ppf(q)
        h = n ** (-1 / 3) * dist.norm_ppf(0.975) ** (2 / 3) * (1.5 * dist.norm_pdf(z) ** 2 / (2 * z * z + 1)) ** (1 / 3)
        iqr = spread[0][1] - spread[0][0]
        h = min(spread[1], iqr / 1.34 if iqr > 0 else spread[1]) * (dist.norm_ppf(min(q + h, 1 - 1e-12)) - dist.norm_ppf(max(q - h, 1e-12)))

        def kernel(batch: pa.RecordBatch) -> np.ndarray:
            z, y = matrix(batch, columns), matrix(batch, ["y"])[:, 0]
            u = y - z @ beta
            f = np.where(np.abs(u / h) <= 1, 0.75 * (1 - (u / h) ** 2), 0.0)
            d = np.where(u > 0, (q / 1.0) ** 2, (1 - q) ** 2)
            return np.concatenate([(z.T @ (z * d[:, None])).ravel(), (z.T @ z).ravel(), [f.sum()]])

        got = totals(frame, kernel, 2 * k * k + 1)
        f0 = got[-1] / (n * h)
        d = got[: k * k].reshape(k, k) / f0**2
        xtx = inverse(got[k * k : 2 * k * k].reshape(k, k))
        rank = rank_of(got[k * k : 2 * k * k].reshape(k, k))
    finally:
        frame.unpersist()
    return Fit(frame, plan, beta, xtx @ d @ xtx, n - rank, {"nobs": n, "df_resid": n - rank, "sparsity": 1 / f0, "bandwidth": h, "iterations": i, "converged": float(done)})


def sliced_inverse(df: DataFrame, response: str, columns: list[str], slices: int = 20) -> tuple[np.ndarray, np.ndarray]:
    """Sliced inverse regression: directions (columns of the first result) and eigenvalues, largest first. Slices hold equal numbers
    of rows in order of the response, cut at exact quantiles."""
    names = ["y", *(f"x{i}" for i in range(len(columns)))]
    frame = df.select(F.col(response).cast("double").alias("y"), *(F.col(c).cast("double").alias(n) for c, n in zip(columns, names[1:]))).na.drop("any")
    cuts = frame.agg(F.percentile("y", F.array(*(F.lit(i / slices) for i in range(1, slices))))).first()[0] or []
    n, *mean = frame.agg(F.count("*"), *(F.avg(c) for c in names[1:])).first()
    k = len(columns)
    centred = frame.select("y", *((F.col(c) - F.lit(m)).alias(c) for c, m in zip(names[1:], mean)))
    x, _, _ = gram(centred, k)
    cov = x / n
    at = F.size(F.filter(F.array(*(F.lit(float(c)) for c in cuts)), lambda c: c < F.col("y")))
    groups = centred.groupBy(at.alias("s")).agg(F.count("*").alias("n"), *(F.avg(c).alias(c) for c in names[1:])).collect()
    low = np.linalg.cholesky(np.linalg.inv(cov))
    means = np.array([[r[c] for c in names[1:]] for r in groups]) @ low
    sizes = np.array([r["n"] for r in groups])
    values, vectors = np.linalg.eigh((means * sizes[:, None]).T @ means / n)
    order = np.argsort(-values)
    return low @ vectors[:, order], values[order]


def influence(fit: Fit, df: DataFrame, keep: list[str] = ()) -> DataFrame:
    """df's kept columns with fitted, resid, leverage, studentised (internal), cooks_distance and dffits of an unweighted linear fit."""
    inv = fit.cov / fit.stats["scale"]
    x = [c.cast("double") for c in fit.plan.columns]
    fitted = sum((F.lit(float(b)) * c for b, c in zip(fit.params, x)), F.lit(0.0))
    lever = sum((F.lit(float(inv[i, j])) * x[i] * x[j] for i in range(len(x)) for j in range(len(x))), F.lit(0.0))
    out = df.select(*keep, fitted.alias("fitted"), (fit.plan.response.cast("double") - fitted).alias("resid"), lever.alias("leverage"))
    s, k = math.sqrt(fit.stats["scale"]), len(x)
    student = F.col("resid") / (s * F.sqrt(1 - F.col("leverage")))
    out = out.withColumn("studentised", student).withColumn("cooks_distance", F.pow("studentised", 2) * F.col("leverage") / (1 - F.col("leverage")) / k)
    dof = fit.df_resid
    outer = F.col("studentised") * F.sqrt((dof - 1) / (dof - F.pow("studentised", 2)))
    return out.withColumn("dffits", outer * F.sqrt(F.col("leverage") / (1 - F.col("leverage"))))
