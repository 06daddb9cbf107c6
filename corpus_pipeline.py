"""A training corpus from documents: five stages, each written as Parquet and reread by the next.

Every function takes (spark, docs, sf_dir). All but the last return the columns of docs, whatever others those
have. An empty table passes through all stages as an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyforge.llm import op04_quality, op05_mixing, op08_rules, op09_simhash, op10_bpe
from tallyforge.llm.session import free_name, hashed, small, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the classifier rejects. It decides by row: rows without id or with equal ids, too."""
    h = free_name(docs.columns, "row_hash")
    found = op04_quality.classify(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), row_hash=True)
    gone = small(found.where("not keep").select(F.col("row_hash").alias(h)).distinct())
    keyed = docs.withColumn(h, hashed("doc_id", "source", "lang", "text"))
    return keyed.join(gone, h, "left_anti").select(docs.columns)


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents whose posterior quality is below one half; decided row by row, without a join."""
    return op08_rules.judged(docs, row="row").where("keep").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, that of the smallest id (rows without id come last), and one of equal rows,
    whatever their ids: rows are named by their id and hash. Null texts are near nothing and stay."""
    h, n = free_name(docs.columns, "row_hash"), free_name(docs.columns, "n")
    keyed = docs.withColumn(h, hashed(*docs.columns))
    named = keyed.select(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col(h).alias("h")).alias("doc_id"), "text")
    gone = small(op09_simhash.groups(named).where("not keep").select(F.col("doc_id.h").alias(h)))
    again = small(keyed.groupBy(h).count().where("count > 1").select(h))
    kept = keyed.join(gone, h, "left_anti")
    if not again.count():
        return kept.select(docs.columns)
    first = kept.join(again, h, "left_semi").withColumn(n, F.row_number().over(Window.partitionBy(h).orderBy(h))).where(F.col(n) == 1)
    return kept.join(again, h, "left_anti").select(docs.columns).unionByName(first.select(docs.columns))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the schedule has their first token, so that sources have their target shares.
    Documents without a token (null, empty) have no place in it. Equal rows share their places evenly, rounded up."""
    h, n = free_name(docs.columns, "row_hash"), free_name(docs.columns, "n_places")
    row = hashed("doc_id", "source", "lang", "text")
    named = docs.select(row.alias("doc_id"), "text", "source")
    places = op05_mixing.schedule(named).where("first_token = 0").groupBy("doc_id").count()
    equal = named.groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1")
    times = places.join(equal, "doc_id", "left").select(F.col("doc_id").alias(h), F.ceil(F.col("count") / F.coalesce("rows", F.lit(1))).cast("int").alias(n))
    joined = docs.withColumn(h, row).join(small(times), h)
    return joined.select(*docs.columns, F.explode(F.array_repeat(F.lit(1), F.col(n))).alias(n)).select(docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text: (doc_id, n_tokens, tokens, round_trip)."""
    return op10_bpe.encode(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality),
    ("quality rules", rules),
    ("SimHash near-dedup", near_duplicates),
    ("mixing sources", mixing),
    ("byte-level BPE", tokens),
]

#: SimHash and the ranked merges can't be expressed in SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each to all that its predecessor kept."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = written(stage(spark, docs, sf_dir), f"stage-{k}")
    return docs
