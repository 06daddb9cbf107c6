"""Queries of the operators over their whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallyforge.llm import op01_token_counts, op02_topk, op03_lm, op04_quality, op05_mixing, op06_langid, op07_warc, op08_rules, op09_simhash, op10_bpe


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": lambda s, d: op01_token_counts.token_counts(table(s, d, "documents")),
    "op2_topk": lambda s, d: op02_topk.top_k(table(s, d, "embeddings"), queries=table(s, d, "embeddings").where(op02_topk.ASKED)),
    "op3_lm_scores": lambda s, d: op03_lm.score(table(s, d, "documents"), table(s, d, "labels")),
    "op4_quality": lambda s, d: op04_quality.classify(table(s, d, "documents"), table(s, d, "labels")),
    "op5_mixing": lambda s, d: op05_mixing.schedule(table(s, d, "documents")),
    "op6_langid": lambda s, d: op06_langid.identify(table(s, d, "documents")),
    "op7_warc": lambda s, d: op07_warc.derivatives(op07_warc.responses(table(s, d, "pages"))),
    "op8_rules": lambda s, d: op08_rules.judged(table(s, d, "documents")),
    "op9_simhash": lambda s, d: op09_simhash.groups(table(s, d, "documents")),
    "op10_bpe": lambda s, d: op10_bpe.encode(table(s, d, "documents")),
}

ORACLES: dict[str, str] = {
    "op2_topk": op02_topk.ORACLE,
    "op3_lm_scores": op03_lm.ORACLE,
    "op4_quality": op04_quality.ORACLE,
    "op5_mixing": op05_mixing.ORACLE,
    "op7_warc": op07_warc.ORACLE,
    "op8_rules": op08_rules.ORACLE,
}
