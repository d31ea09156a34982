"""Monthly sums over a stream, with a watermark for late rows (an addition to the batch series)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.profile import col


def stream_windows(stream: DataFrame, time: str, measure: str, window: str = "1 day", late: str = "2 hours") -> DataFrame:
    """(window_start, rows, value) of fixed windows; rows later than ``late`` are dropped, state is bounded by it."""
    rows = stream.withColumn("__t", col(time).cast("timestamp")).filter(F.col("__t").isNotNull() & col(measure).isNotNull()).withWatermark("__t", late)
    sums = rows.groupBy(F.window("__t", window).alias("w")).agg(F.count(F.lit(1)).alias("rows"), F.sum(col(measure).cast("double")).alias("value"))
    return sums.select(F.col("w.start").alias("window_start"), "rows", "value")


def months_of(windows: DataFrame) -> DataFrame:
    """(period, rows, value) from the finished windows of a sink table."""
    return windows.groupBy(F.date_trunc("month", "window_start").cast("timestamp_ntz").alias("period")).agg(F.sum("rows").alias("rows"), F.sum("value").alias("value"))
