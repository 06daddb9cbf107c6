"""Operator 4: a hierarchical empirical-Bayes quality classifier."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.features import MEASURES_SQL, measures
from tallyforge.llm.session import hashed, written

#: Binned evidence; the same text is SQL in Spark and DuckDB. Shares are in steps that widen with the share.
BINS = {
    "marks": "case when n_marks = 0 then 0 when n_marks * 200 < n_chars then 1 when n_marks * 20 < n_chars then 2 else 3 end",
    "upper": "case when n_upper * 200 < n_chars then 0 when n_upper * 20 < n_chars or n_upper <= n_words then 1 when n_upper * 5 < n_chars then 2 else 3 end",
    "bang": "case when n_bang = 0 then 0 when n_bang * 50 < n_chars then 1 else 2 end",
    "same_lines": "case when n_same_lines = 0 then 0 when n_same_lines * 5 < n_lines or n_same_lines < 3 then 1 when n_same_lines * 2 < n_lines then 2 else 3 end",
    "variety": "case when n_words < 20 then 0 when n_distinct * n_distinct < n_words * 2 then 1 when n_distinct * n_distinct < n_words * 8 then 2 when n_distinct * n_distinct < n_words * 25 then 3 else 4 end",
    "size": "case when n_words < 3 then 0 when n_words < 20 then 1 when n_words < 100 then 2 when n_words < 1000 then 3 else 4 end",
}
#: Label counts added to every bin.
SMOOTHING = 1.0
THRESHOLD = 0.5
#: More hosts, or paths, than this are joined by a shuffle instead of a broadcast.
BROADCAST_ROWS = 5_000


def site_counts(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.sum("y").alias("s"))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang", row_hash: bool = False) -> DataFrame:
    """Quality of every document: (doc_id, evidence, site, probability, keep), one row per input row.

    Evidence is the log-likelihood ratio of naive Bayes over binned text measures, fitted on all labelled
    documents (label 1 good, 0 bad). Each document's outcome is its label, or else its probability by
    evidence alone. Grouped sums of outcomes give each host (host_col) a posterior that is shrunk toward the
    global mean with a strength estimated from how much hosts differ, and each path (host_col, path_col) one
    shrunk toward its host, in both cases without the document's own outcome. The path posterior is the
    prior odds of the document's evidence. keep: probability at least threshold. With row_hash, a column of
    that name identifies equal rows (see row_hash in session.py).

    A null text counts as an empty one. Null hosts and paths are each a site of their own. Null ids are
    classified like others, without label. Labels of one id are merged by their largest value; null labels
    are none. Without labels of both kinds evidence is 0. An empty table gives no rows. Other columns are
    ignored, whatever their names.
    """
    given = docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).cast("string").alias("host"), F.col(path_col).cast("string").alias("path"), F.col(text_col).cast("string").alias("text"))
    more = ["row_hash"] if row_hash else []
    given = given.withColumn("row_hash", hashed("doc_id", "host", "path", "text")) if row_hash else given
    bins = [F.expr(sql).cast("int").alias(f"b_{name}") for name, sql in BINS.items()]
    seen = written(given.select("doc_id", *more, F.coalesce("host", F.lit("\0")).alias("host"), F.coalesce("path", F.lit("\0")).alias("path"), *measures()).select("doc_id", *more, "host", "path", *bins), "quality")
    marks = labels.where("quality in (0, 1)").groupBy(F.col("doc_id").alias("doc_id")).agg(F.max("quality").alias("label"))
    seen = written(seen.join(marks, "doc_id", "left"), "quality-labelled")

    # One aggregate row has the counts of every bin by label: their number depends on BINS alone.
    sizes = {name: sql.count("when") + 1 for name, sql in BINS.items()}
    counts = seen.where("label is not null").agg(*(F.count(F.when((F.col(f"b_{f}") == b) & (F.col("label") == y), 1)).alias(f"{f}_{b}_{y}") for f, k in sizes.items() for b in range(k) for y in (0, 1)), *(F.count(F.when(F.col("label") == y, 1)).alias(f"all_{y}") for y in (0, 1))).first()
    n0, n1 = counts["all_0"], counts["all_1"]
    evidence, base = F.lit(0.0), (n1 + 1.0) / (n0 + n1 + 2.0)
    if n0 and n1:
        for f, k in sizes.items():
            term = F.lit(0.0)
            for b in range(k):
                ratio = math.log((counts[f"{f}_{b}_1"] + SMOOTHING) / (n1 + SMOOTHING * k)) - math.log((counts[f"{f}_{b}_0"] + SMOOTHING) / (n0 + SMOOTHING * k))
                term = F.when(F.col(f"b_{f}") == b, F.lit(ratio)).otherwise(term)
            evidence = evidence + term
    odds = F.lit(math.log(base / (1 - base)) if n0 and n1 else 0.0)
    scored = seen.select("doc_id", *more, "host", "path", evidence.alias("evidence"), "label")
    scored = scored.withColumn("y", F.coalesce(F.col("label").cast("double"), 1 / (1 + F.exp(-(F.col("evidence") + odds)))))

    paths = written(site_counts(scored, ["host", "path"]), "quality-sites")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("s").alias("hs"))
    m = paths.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    n, mean = m["n"] or 0, (m["s"] / m["n"]) if m["n"] else 0.5

    def strength(groups: DataFrame, centre: str) -> float:
        """Prior count m whose Beta prior explains the spread of group rates around centre, within [1, 10000]."""
        row = groups.agg(F.sum(F.expr(f"n * pow(s / n - {centre}, 2)")).alias("v"), F.count("*").alias("g")).first()
        if not n or not row["g"]:
            return 1.0
        within = mean * (1 - mean)
        between = max((row["v"] - row["g"] * within) / n, 1e-9)
        return min(max(within / between - 1, 1.0), 10_000.0)

    host_m = strength(hosts.select(F.col("hn").alias("n"), F.col("hs").alias("s")), repr(float(mean)))
    sites = paths.join(hosts, "host")
    path_m = strength(sites.withColumn("centre", F.col("hs") / F.col("hn")), "centre")
    if paths.count() <= BROADCAST_ROWS:
        sites = F.broadcast(sites)
    host_rate = (F.col("hs") - F.col("y") + host_m * mean) / (F.col("hn") - 1 + host_m)
    site = (F.col("s") - F.col("y") + path_m * host_rate) / (F.col("n") - 1 + path_m)
    clipped = F.greatest(F.least(site, F.lit(1 - 1e-6)), F.lit(1e-6))
    probability = 1 / (1 + F.exp(-(F.log(clipped / (1 - clipped)) + F.col("evidence"))))
    out = scored.join(sites, ["host", "path"]).select("doc_id", *more, F.round("evidence", 6).alias("evidence"), F.round(clipped, 6).alias("site"), F.round(probability, 6).alias("probability"))
    return out.withColumn("keep", F.col("probability") >= threshold)


def _sql() -> str:
    bins = ", ".join(f"{sql} b_{name}" for name, sql in BINS.items())
    sizes = {name: sql.count("when") + 1 for name, sql in BINS.items()}
    ratios = " + ".join(
        f"(select ln((count(*) filter (r.b_{f} = x.b_{f} and r.label = 1) + {SMOOTHING}) / (count(*) filter (r.label = 1) + {SMOOTHING * k})) - ln((count(*) filter (r.b_{f} = x.b_{f} and r.label = 0) + {SMOOTHING}) / (count(*) filter (r.label = 0) + {SMOOTHING * k})) from seen r where r.label is not null)"
        for f, k in sizes.items()
    )
    keys = ", ".join(f"b_{f}" for f in BINS)
    same = " and ".join(f"x.b_{f} = seen.b_{f}" for f in BINS)
    strength = "least(greatest(g.mean * (1 - g.mean) / greatest((v - k * g.mean * (1 - g.mean)) / g.n, 1e-9) - 1, 1.0), 10000.0)"
    return f"""with measured as (select doc_id, coalesce(source, chr(1)) host, coalesce(lang, chr(1)) path, {MEASURES_SQL} from documents),
binned as (select doc_id, host, path, {bins} from measured),
marks as (select doc_id, max(quality) label from labels where quality in (0, 1) group by 1),
seen as materialized (select binned.*, label from binned left join marks using (doc_id)),
kinds as (select distinct {keys} from seen),
ratio as materialized (select x.*, {ratios} evidence from kinds x),
base as (select ln((count(*) filter (label = 1) + 1.0) / (count(*) filter (label = 0) + 1.0)) odds from seen),
scored as materialized (select doc_id, host, path, evidence, coalesce(label::double, 1 / (1 + exp(-(evidence + odds)))) y from seen join ratio x on {same}, base),
paths as (select host, path, count(*) n, sum(y) s from scored group by all),
hosts as (select host, sum(n) hn, sum(s) hs from paths group by all),
g as (select sum(n) n, sum(s) / sum(n) mean from paths),
hm as (select {strength} m from (select sum(hn * pow(hs / hn - mean, 2)) v, count(*) k from hosts, g) z, g),
pm as (select {strength} m from (select sum(n * pow(s / n - hs / hn, 2)) v, count(*) k from paths join hosts using (host)) z, g),
placed as (select doc_id, evidence, greatest(least((s - y + pm.m * ((hs - y + hm.m * mean) / (hn - 1 + hm.m))) / (paths.n - 1 + pm.m), 1 - 1e-6), 1e-6) site
 from scored join paths using (host, path) join hosts using (host), hm, pm, g)
select doc_id, round(evidence, 6) evidence, round(site, 6) site, round(1 / (1 + exp(-(ln(site / (1 - site)) + evidence))), 6) probability,
 round(1 / (1 + exp(-(ln(site / (1 - site)) + evidence))), 6) >= {THRESHOLD} keep from placed"""


ORACLE = _sql()
