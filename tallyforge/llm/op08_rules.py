"""Operator 8: quality rules as weak supervision."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.features import BLANK, MARKS, MEASURES_SQL, measures

#: Each rule votes 1 (good), -1 (bad) or abstains (0); the same text is SQL in Spark and DuckDB. Several rules look at each kind of
#: defect in different ways, so that they can confirm or outvote each other.
RULES = {
    "marks": "case when n_marks * 10 > n_chars then -1 when n_marks * 100 <= n_chars then 1 else 0 end",
    "mark_runs": "case when n_words < 3 then 0 when n_runs * 4 > n_words then -1 when n_runs * 20 <= n_words then 1 else 0 end",
    "letters": "case when n_words < 3 then 0 when n_letters * 100 < n_chars * 72 then -1 when n_letters * 100 >= n_chars * 77 then 1 else 0 end",
    "capitals": "case when n_upper * 10 > n_chars * 3 and n_upper > n_words * 2 then -1 when n_upper * 10 <= n_chars or n_upper <= n_words then 1 else 0 end",
    "shouting": "case when n_bang * 20 > n_chars then -1 when n_bang = 0 then 1 else 0 end",
    "lists": "case when n_pipes * 5 > n_words then -1 when n_pipes = 0 then 1 else 0 end",
    "variety": "case when n_words < 30 then 0 when n_distinct * n_distinct < n_words * 4 then -1 when n_distinct * n_distinct > n_words * 16 then 1 else 0 end",
    "fresh": "case when n_words < 12 then 0 when n_distinct * 4 < n_words and n_distinct * n_distinct < n_words * 16 then -1 when n_distinct * 5 > n_words * 2 or n_distinct * n_distinct > n_words * 16 then 1 else 0 end",
    "again": "case when n_words < 4 then 0 when n_again * 5 > n_words then -1 when n_again * 50 <= n_words then 1 else 0 end",
    "same_lines": "case when n_lines < 4 then 0 when n_same_lines * 2 >= n_lines then -1 when n_same_lines = 0 then 1 else 0 end",
    "word_size": "case when n_words < 5 then 0 when n_chars < n_words * 3 or n_chars > n_words * 14 then -1 else 1 end",
    "emptiness": "case when n_words = 0 then -1 else 0 end",
}
ROUNDS = 20
#: P(good) to begin with, by the number of bad votes: none, one, or more. One vote alone is doubted, until others confirm its rule.
START = (0.95, 0.9, 0.05)
SMOOTHING, THRESHOLD = 0.5, 0.5
#: No rule is thought to err in fewer than this share of its votes, or in more than all others, on good or on bad documents.
ERROR = 0.01
NAMES = list(RULES)


def votes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row: str | None = None) -> DataFrame:
    """(doc_id, v_<rule> for each rule), and with row all input columns as one struct of that name."""
    t = F.coalesce(F.col("text").cast("string"), F.lit(""))
    kept = [row] if row else []
    words = F.filter(F.split(F.lower(t), BLANK), lambda w: w != "")
    repeated = lambda w: F.size(F.filter(F.zip_with(w, F.slice(w, 2, F.greatest(F.size(w), F.lit(1))), lambda a, b: a == b), lambda x: x))
    more = [
        (F.length(t) - F.length(F.replace(t, F.lit("|"), F.lit("")))).cast("bigint").alias("n_pipes"),
        (F.length(t) - F.length(F.regexp_replace(t, "\\p{L}+", ""))).cast("bigint").alias("n_letters"),
        F.regexp_count(t, F.lit(MARKS + "+")).cast("bigint").alias("n_runs"),
        repeated(words).cast("bigint").alias("n_again"),
    ]
    whole = [F.struct(*(docs[c] for c in docs.columns)).alias(row)] if row else []
    given = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *whole)
    return given.select("doc_id", *kept, *measures(), *more).select("doc_id", *kept, *(F.expr(sql).cast("int").alias(f"v_{n}") for n, sql in RULES.items()))


def estimate(patterns: list[tuple[tuple[int, ...], int]]) -> tuple[float, list[tuple[float, float]]]:
    """Share of good documents, and for each rule P(vote good | good) and P(vote good | bad) where it votes, by
    expectation-maximisation over distinct vote patterns with one latent variable, good or bad. An abstention says nothing.

    It starts from the number of bad votes (START): what several rules condemn is thought bad, what one alone condemns good, with some doubt. So a
    rule whose bad votes no other shares comes out as inaccurate and is outvoted; one that agrees with others is trusted, but not
    beyond an error rate of ERROR, lest rare votes confirm themselves.
    """
    m = len(RULES)
    q = [START[min(sum(v == -1 for v in p), 2)] for p, _ in patterns]
    total = sum(n for _, n in patterns)
    prior, table = 0.5, [(0.5, 0.5)] * m
    for _ in range(ROUNDS if patterns else 0):
        prior = (sum(n * x for (_, n), x in zip(patterns, q)) + SMOOTHING) / (total + 2 * SMOOTHING)
        table = []
        for j in range(m):
            cells = []
            for weight in (q, [1 - x for x in q]):
                good, cast = (sum(n * x for (p, n), x in zip(patterns, weight) if p[j] in kinds) for kinds in ((1,), (-1, 1)))  # noqa: B023
                cells.append(min(max((good + SMOOTHING) / (cast + 2 * SMOOTHING), ERROR), 1 - ERROR))
            table.append(tuple(cells))
        for i, (p, _) in enumerate(patterns):
            odds = math.log(prior / (1 - prior)) + sum(math.log(a / b) if v == 1 else math.log((1 - a) / (1 - b)) for v, (a, b) in zip(p, table) if v)
            q[i] = 1 / (1 + math.exp(-odds))
    return prior, table


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row: str | None = None) -> DataFrame:
    """Posterior quality of every document: (doc_id, n_good, n_bad, quality, keep), one row per input row.

    Rules vote good or bad or abstain. Expectation-maximisation over the distinct vote patterns (their number depends on the rules,
    not on the data) estimates each rule's accuracies on good and on bad documents, from how rules agree; the posterior
    probability of good, given all votes and accuracies, replaces the demand that all rules pass. A single bad vote of a
    rule that errs is outvoted. The votes are counted over all documents. keep: quality at least 0.5. With row, a first
    column of that name holds the input row, so that a filter needs no join.

    A null text counts as an empty one, on which one rule votes bad and most others good or abstain. Null
    ids, equal ids and repeated rows are judged as rows. An empty table gives no rows. Other columns are
    ignored, whatever their names.
    """
    cast, kept = votes(docs, id_col, text_col, row), [row] if row else []
    columns = [f"v_{n}" for n in NAMES]
    patterns = [(tuple(r[c] for c in columns), r["n"]) for r in cast.groupBy(*columns).agg(F.count("*").alias("n")).collect()]
    prior, table = estimate(sorted(patterns))
    odds = F.lit(math.log(prior / (1 - prior)))
    for c, (a, b) in zip(columns, table):
        odds = odds + F.when(F.col(c) == 1, math.log(a / b)).when(F.col(c) == -1, math.log((1 - a) / (1 - b))).otherwise(0.0)
    count = lambda v: sum((F.col(c) == v).cast("int") for c in columns)
    out = cast.select(*kept, "doc_id", count(1).alias("n_good"), count(-1).alias("n_bad"), F.round(1 / (1 + F.exp(-odds)), 6).alias("quality"))
    return out.withColumn("keep", F.col("quality") >= THRESHOLD)


def _sql() -> str:
    rules = ", ".join(f"{sql} v_{n}" for n, sql in RULES.items())
    cols = [f"v_{n}" for n in NAMES]
    bad = " + ".join(f"({c} = -1)::int" for c in cols)
    steps = [f"q0 as materialized (select *, (case {bad} when 0 then {START[0]} when 1 then {START[1]} else {START[2]} end)::double q from patterns)"]
    for k in range(1, ROUNDS + 1):
        share = lambda w, v: f"least(greatest((coalesce(sum(n * {w}) filter ({v} = 1), 0) + {SMOOTHING}) / (coalesce(sum(n * {w}) filter ({v} <> 0), 0) + {2 * SMOOTHING}), {ERROR}), {1 - ERROR})"
        cells = ", ".join(f"{share('q', v)} a{j}, {share('(1 - q)', v)} b{j}" for j, v in enumerate(cols))
        steps.append(f"m{k} as materialized (select (sum(n * q) + {SMOOTHING}) / (sum(n) + {2 * SMOOTHING}) p, {cells} from q{k - 1})")
        odds = "ln(p / (1 - p)) + " + " + ".join(f"case {v} when 1 then ln(a{j} / b{j}) when -1 then ln((1 - a{j}) / (1 - b{j})) else 0 end" for j, v in enumerate(cols))
        steps.append(f"q{k} as materialized (select {', '.join(cols)}, n, 1 / (1 + exp(-({odds}))) q from q{k - 1}, m{k})")
    t = "coalesce(text, '')"
    words = f"list_filter(string_split_regex(lower({t}), '{BLANK}'), lambda w: w <> '')"
    more = f"""length({t}) - length(replace({t}, '|', '')) n_pipes, length({t}) - length(regexp_replace({t}, '\\p{{L}}+', '', 'g')) n_letters,
 len(regexp_extract_all({t}, '{MARKS}+')) n_runs, len(list_filter(list_zip({words}, ({words})[2:]), lambda z: z[1] = z[2])) n_again"""
    count = lambda v: " + ".join(f"({c} = {v})::int" for c in cols)
    return f"""with cast_ as materialized (select doc_id, {rules} from (select doc_id, {MEASURES_SQL}, {more} from documents)),
patterns as (select {', '.join(cols)}, count(*) n from cast_ group by all), {', '.join(steps)}
select doc_id, ({count(1)})::int n_good, ({count(-1)})::int n_bad, round(q, 6) quality, round(q, 6) >= {THRESHOLD} keep from cast_ join q{ROUNDS} using ({', '.join(cols)})"""

ORACLE = _sql()
