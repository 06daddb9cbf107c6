"""Fixed-width text tables of fitted models."""

from __future__ import annotations

import math

WIDTH = 78


def format_fixed(x: float, places: int = 3) -> str:
    return "nan" if x is None or math.isnan(x) else f"{x:.{places}f}"


def format_g(x: float, digits: int = 4) -> str:
    """Up to digits significant digits, without trailing zeros."""
    return "nan" if x is None or math.isnan(x) else f"{x:.{digits}g}"


def format_pvalue(p: float) -> str:
    return "nan" if p is None or math.isnan(p) else "<0.001" if p < 0.001 else f"{p:.3f}"


class SummaryTable:
    """Rows of text in columns as wide as their widest cell; the first column is set left, others right."""

    def __init__(self, header: list[str], rows: list[list[str]], title: str = ""):
        self.header, self.rows, self.title = header, rows, title

    def __str__(self) -> str:
        cells = [self.header, *self.rows]
        widths = [max(len(r[i]) for r in cells) for i in range(len(self.header))]
        line = lambda r: "  ".join(c.ljust(w) if i == 0 else c.rjust(w) for i, (c, w) in enumerate(zip(r, widths)))
        total = sum(widths) + 2 * (len(widths) - 1)
        head = [self.title.center(total).rstrip()] if self.title else []
        return "\n".join([*head, "=" * total, line(self.header), "-" * total, *map(line, self.rows), "=" * total])


def header(stats: list[tuple[str, str]]) -> str:
    """Pairs of label and value in two columns."""
    half = (WIDTH - 2) // 2
    cell = lambda p: f"{p[0]}:".ljust(half - len(p[1])) + p[1]
    left, right = stats[::2], [*stats[1::2], ("", "")]
    return "\n".join((cell(a) + "  " + (cell(b) if b[0] else "")).rstrip() for a, b in zip(left, right))


def coefficients(names, params, bse, stats, pvalues, interval, normal: bool) -> SummaryTable:
    z = "z" if normal else "t"
    rows = [[n, format_fixed(b, 4), format_fixed(s), format_fixed(t), format_fixed(p), format_fixed(lo), format_fixed(hi)] for n, b, s, t, p, (lo, hi) in zip(names, params, bse, stats, pvalues, interval)]
    return SummaryTable(["", "coef", "std err", z, f"P>|{z}|", "[0.025", "0.975]"], rows)


def regression(fit, response: str) -> str:
    """Head and coefficients of a linear or generalised linear fit."""
    s = fit.stats
    shown = [("Dep. variable", response), ("Model", fit.kind), ("Observations", f"{s['nobs']:.0f}"), ("Df residuals", f"{fit.df_resid}")]
    for key, label in (("rsquared", "R-squared"), ("rsquared_adj", "Adj. R-squared"), ("fvalue", "F-statistic"), ("f_pvalue", "Prob (F)"), ("deviance", "Deviance"), ("pearson_chi2", "Pearson chi2"), ("pseudo_rsquared_cs", "Pseudo R-squ. (CS)"), ("scale", "Scale"), ("llf", "Log-likelihood"), ("aic", "AIC"), ("bic", "BIC"), ("condition_number", "Cond. no.")):
        if key in s:
            shown.append((label, format_g(s[key], 6)))
    table = coefficients(fit.plan.names, fit.params, fit.bse, fit.tvalues, fit.pvalues, fit.conf_int(), fit.normal)
    return f"{(fit.kind + ' results').center(WIDTH).rstrip()}\n{header(shown)}\n{table}"


def estimate(fit, response: str, model: str) -> str:
    """Head and coefficients of a maximum likelihood estimate."""
    shown = [("Dep. variable", response), ("Model", model), ("Observations", str(fit.nobs)), ("Log-likelihood", format_g(fit.llf, 8)), ("AIC", format_g(fit.aic, 8)), ("BIC", format_g(fit.bic, 8)), ("Converged", str(fit.converged)), ("Iterations", str(fit.iterations))]
    shown += [(k, format_g(v, 6)) for k, v in fit.stats.items()]
    table = coefficients(fit.names, fit.params, fit.bse, fit.tvalues, fit.pvalues, fit.conf_int(), True)
    return f"{(model + ' results').center(WIDTH).rstrip()}\n{header(shown)}\n{table}"
