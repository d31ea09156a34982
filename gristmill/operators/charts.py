"""The data behind charts: aggregates and top lists, ties broken by label."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .profile import col

# How much each chart shows.
BARS, SLICES, POINTS_IN_LINE, POINTS, BINS = 15, 8, 100, 500, 12


def bar_data(df: DataFrame, category: str, measure: str, most: int = BARS) -> DataFrame:
    """(label, value): the greatest sums by category."""
    rows = df.filter(col(category).isNotNull() & col(measure).isNotNull())
    sums = rows.groupBy(col(category).cast("string").alias("label")).agg(F.round(F.sum(col(measure).cast("double")), 2).alias("value"))
    return sums.orderBy(F.col("value").desc(), "label").limit(most)


def donut_data(df: DataFrame, category: str, most: int = SLICES) -> DataFrame:
    """(label, value): the commonest values."""
    counts = df.filter(col(category).isNotNull()).groupBy(col(category).cast("string").alias("label")).agg(F.count(F.lit(1)).alias("value"))
    return counts.orderBy(F.col("value").desc(), "label").limit(most)


def line_data(df: DataFrame, x: str, measures: list[str], most: int = POINTS_IN_LINE, digits: int = 2) -> DataFrame:
    """(x, one mean a measure): the earliest points; with several measures a missing mean is 0."""
    rows = df.filter(col(x).isNotNull())
    if len(measures) == 1:
        rows = rows.filter(col(measures[0]).isNotNull())
    means = [F.coalesce(F.round(F.avg(col(m).cast("double")), digits), F.lit(0.0)).alias(m) for m in measures]
    return rows.groupBy(col(x).alias("x")).agg(*means).orderBy(F.col("x").asc_nulls_last()).limit(most)


def scatter_data(df: DataFrame, x: str, y: str, order_by: str, most: int = POINTS) -> DataFrame:
    """(x, y) of the first rows by ``order_by``, both not null."""
    return df.filter(col(x).isNotNull() & col(y).isNotNull()).orderBy(col(order_by), col(x), col(y)).limit(most).select(col(x).cast("double").alias("x"), col(y).cast("double").alias("y"))


def histogram_data(df: DataFrame, measure: str, bins: int = BINS) -> DataFrame:
    """(bin, bin_start, bin_end, count) over all values: at most ``bins`` of equal width, as many as distinct values; empty ones too."""
    v = df.select(col(measure).cast("double").alias("v")).filter("v IS NOT NULL")
    few = v.groupBy("v").agg(F.lit(1).alias("one")).limit(bins).count()
    low, high = v.agg(F.min("v"), F.max("v")).first()
    if low is None:
        return df.sparkSession.createDataFrame([], "bin int, bin_start double, bin_end double, count long")
    n = 1 if low == high else min(bins, few)
    width = (high - low) / n if n > 1 else 0.0
    place = F.least(F.floor((F.col("v") - low) / width), F.lit(n - 1)).cast("int") if width else F.lit(0)
    counts = v.groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    every = df.sparkSession.range(n).select(F.col("id").cast("int").alias("bin"))
    full = every.join(counts, "bin", "left").withColumn("count", F.coalesce("count", F.lit(0)))
    return full.select("bin", (F.lit(low) + F.col("bin") * F.lit(width)).alias("bin_start"), (F.lit(low) + (F.col("bin") + 1) * F.lit(width)).alias("bin_end"), "count")
