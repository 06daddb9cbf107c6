"""What the operators need from the session: the shared folder, written tables, Arrow batch size."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows per Arrow batch sent to Python; texts are long, so the default of 10,000 is too many.
ARROW_ROWS = 2000


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir of the session; a temporary one only where
    that is unset and the session runs in one process."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="tallyforge-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of df, computed once, from a Parquet table in the shared folder: lineage ends there and
    a lost executor costs nothing but a reread."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tallyforge/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def arrow_batches(spark: SparkSession) -> None:
    """Bounds the Arrow batches of the session by ARROW_ROWS rows."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))


def free_name(columns: list[str], name: str) -> str:
    """name, with as many underscores before it as keep it apart from columns (compared in lower case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


#: More rows than this are joined by a shuffle instead of a broadcast.
BROADCAST_ROWS = 1_000_000


def hashed(*columns: str) -> Column:
    """64-bit hash of a row's columns as strings; a null counts as a value of its own."""
    return F.xxhash64(*(x for c in columns for x in (F.col(c).isNull(), F.col(c).cast("string"))))


def small(df: DataFrame) -> DataFrame:
    """df, written once, and marked for broadcast if it has at most BROADCAST_ROWS rows."""
    df = written(df, "small")
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df
