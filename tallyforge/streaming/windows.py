"""Windowed least squares over a stream: additive sums per window, with a watermark for late rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_ols(stream: DataFrame, ts: str, y: str, x: str, window: str = "1 day", late: str = "1 day") -> DataFrame:
    """Slope and intercept of y on x per window; works on streams and tables alike."""
    w = stream.withWatermark(ts, late) if stream.isStreaming else stream
    sums = w.groupBy(F.window(ts, window).alias("w")).agg(F.count("*").alias("n"), F.covar_pop(x, y).alias("sxy"), F.var_pop(x).alias("sxx"), F.avg(x).alias("mx"), F.avg(y).alias("my"))
    slope = F.when(F.col("sxx") > 0, F.col("sxy") / F.col("sxx"))
    return sums.select(F.col("w.start").alias("start"), "n", slope.alias("slope"), (F.col("my") - slope * F.col("mx")).alias("intercept"))
