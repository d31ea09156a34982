"""Monthly series of measures: sums, spikes and linear forecasts; the aggregate is small, whatever the table."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .profile import col

# Fixed values of the spike rule and the forecast.
SPIKE_FROM, MOST_SPIKES = 2.5, 2
LEAST_MONTHS = 3
HORIZONS = (("next_month", 1), ("next_quarter", 3), ("next_year", 12))


def monthly_series(df: DataFrame, date: str, measure: str) -> DataFrame:
    """(period, value): the measure's sum by month, both not null."""
    rows = df.filter(col(date).isNotNull() & col(measure).isNotNull())
    return rows.groupBy(F.date_trunc("month", col(date)).cast("timestamp_ntz").alias("period")).agg(F.sum(col(measure).cast("double")).alias("value"))


def with_moments(df: DataFrame, value: str) -> DataFrame:
    """Every row with avg_value and std_value (sample) of all rows, from a one-row aggregate."""
    one = df.agg(F.avg(value).alias("avg_value"), F.stddev_samp(value).alias("std_value"))
    return df.withColumn("__k", F.lit(1)).join(F.broadcast(one.withColumn("__k", F.lit(1))), "__k").drop("__k")


def monthly_spikes(df: DataFrame, date: str, measure: str, least: float = SPIKE_FROM, most: int = MOST_SPIKES) -> DataFrame:
    """(period, value, z_score) of the months farthest from the mean, from ``least`` deviations on."""
    return spikes_and_mean(df, date, measure, least, most).select("period", "value", "z_score")


def spikes_and_mean(df: DataFrame, date: str, measure: str, least: float = SPIKE_FROM, most: int = MOST_SPIKES) -> DataFrame:
    """As monthly_spikes, with avg_value, the mean of all months."""
    scored = with_moments(monthly_series(df, date, measure), "value").filter("std_value > 0")
    scored = scored.withColumn("z_score", F.abs((F.col("value") - F.col("avg_value")) / F.col("std_value"))).filter(F.col("z_score") >= least)
    return scored.orderBy(F.col("z_score").desc(), "period").limit(most).select("period", "value", "avg_value", "z_score")


def linear_forecast(df: DataFrame, date: str, measure: str) -> DataFrame:
    """One row for a series of three months or more: fit, forecasts with bounds, change in percent, confidence.

    Months are numbered 0, 1, ... as they stand (gaps aren't filled); the half width of a bound is
    1.96 population deviations of the residuals times the root of the months ahead.
    """
    months = monthly_series(df, date, measure)
    numbered = months.withColumn("x", (F.row_number().over(Window.orderBy("period")) - 1).cast("double"))
    fit = numbered.agg(
        F.count(F.lit(1)).alias("observations"), F.max_by("value", "period").alias("latest"), F.avg("value").alias("mean"), F.regr_slope("value", "x").alias("slope"), F.regr_intercept("value", "x").alias("intercept"),
        F.regr_sxx("value", "x").alias("sxx"), F.regr_sxy("value", "x").alias("sxy"), F.regr_syy("value", "x").alias("syy"),
    ).filter(F.col("observations") >= LEAST_MONTHS)
    n = F.col("observations")
    fit = fit.withColumn("deviation", F.sqrt(F.greatest((F.col("syy") - F.col("sxy") * F.col("sxy") / F.col("sxx")) / n, F.lit(0.0))))
    parts: list[Column] = []
    for name, ahead in HORIZONS:
        value = F.col("intercept") + F.col("slope") * (n + ahead - 1)
        half = 1.96 * F.col("deviation") * math.sqrt(ahead)
        parts += [F.round(value, 2).alias(name), F.round(value - half, 2).alias(f"{name}_low"), F.round(value + half, 2).alias(f"{name}_high")]
    fit = fit.select("*", *parts)
    change = F.when(F.col("latest") != 0, (F.col("next_month") - F.col("latest")) / F.col("latest") * 100).otherwise(0.0)
    noise = F.when(F.col("mean") != 0, F.least(F.col("deviation") / F.abs("mean"), F.lit(0.8))).otherwise(F.lit(0.8))
    confidence = 0.45 + 0.45 * F.least(n / 12, F.lit(1.0)) * F.greatest(F.lit(0.2), 1 - noise)
    names = [f"{name}{end}" for name, _ in HORIZONS for end in ("", "_low", "_high")]
    return fit.select(F.lit(measure).alias("metric"), "observations", F.round("latest", 2).alias("latest_value"), F.round("slope", 2).alias("monthly_slope"), *names, F.round(change, 2).alias("change_percent"), F.round(confidence, 2).alias("confidence"))
