"""Sliding windows over results and batch progress.

The reference's idle detector sums processed points over a window of 100
batch periods sliding by half of it.  Here that is ``window(time, W, W/2)``
with a watermark, in batch or streaming form alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def sliding_sum(df: DataFrame, time_col: str, value_col: str | None, window: str,
                slide: str, watermark: str | None = None, out: str = "num_points") -> DataFrame:
    """Per sliding window ``[start, end)``: rows and the sum of ``value_col``."""
    if watermark:
        # watermarks need TIMESTAMP; wall-clock NTZ values are read in the
        # session time zone (UTC in weftcore sessions)
        if isinstance(df.schema[time_col].dataType, T.TimestampNTZType):
            df = df.withColumn(time_col, F.col(time_col).cast("timestamp"))
        df = df.withWatermark(time_col, watermark)
    val = F.col(value_col) if value_col else F.lit(1)
    return (df.groupBy(F.window(time_col, window, slide).alias("w"))
            .agg(F.count(F.lit(1)).alias("rows"), F.sum(val).alias(out))
            .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                    "rows", out))


def batch_progress(commits: DataFrame, batch_secs: int | None = None) -> DataFrame:
    """Every committed micro-batch with its points and seconds;
    ``over_time`` marks batches that took their period or longer (the
    prototype asserted on this).  Reads the stream's commit table, so it is
    complete however long the stream has run."""
    over = F.lit(False) if batch_secs is None else F.col("seconds") >= batch_secs
    return commits.select("batch_id", "num_points", "seconds", over.alias("over_time"))
