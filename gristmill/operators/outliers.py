"""Outliers: the farthest value of a measure, capping to fences, excluding rows outside them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import is_identifier, is_year
from .profile import as_rows, col, columns_of, exact_quantiles

# Fixed values of the rules.
OUTLIER_FROM, LEAST_VALUES = 3.0, 8


def distribution_outliers(df: DataFrame, columns: list[str], least: float = OUTLIER_FROM) -> DataFrame:
    """(column_name, value, mean, std, z_score): of each column the value farthest from its mean, if that is ``least`` deviations or more.

    The farthest value is the least or the greatest, so one aggregate over all columns suffices.
    """
    def one(c: str):
        v = col(c).cast("double")
        return F.struct(F.lit(c).alias("column_name"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("low"), F.max(v).alias("high"))

    rows = as_rows(df.agg(*[one(c).alias(f"c{i}") for i, c in enumerate(columns)]), [f"c{i}" for i in range(len(columns))]).filter("std > 0")
    value = F.when(F.col("high") - F.col("mean") >= F.col("mean") - F.col("low"), F.col("high")).otherwise(F.col("low"))
    rows = rows.withColumn("value", value).withColumn("z_score", F.abs((F.col("value") - F.col("mean")) / F.col("std")))
    return rows.filter(F.col("z_score") >= least).select("column_name", "value", "mean", "std", "z_score")


def fences(df: DataFrame, columns: list[str] | None = None) -> dict[str, tuple[float, float, float, float]]:
    """By column: lower and upper fence, and the values that stand for what is outside (1st and 99th percentile, or the fence).

    Columns are numeric ones that are no identifier or year, with eight values or more and quartiles
    apart; quantiles are those of the nearest rank.
    """
    columns = columns or [c for c in columns_of(df, "numeric") if not is_identifier(c) and not is_year(c)]
    if not columns:
        return {}
    counts = df.agg(*[F.count(col(c)).alias(f"c{i}") for i, c in enumerate(columns)]).first()
    columns = [c for i, c in enumerate(columns) if counts[f"c{i}"] >= LEAST_VALUES]
    out = {}
    for c, (p01, q1, q3, p99) in exact_quantiles(df, columns, (0.01, 0.25, 0.75, 0.99), nearest=True).items():
        if q3 > q1:
            low, high = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
            out[c] = low, high, max(p01, low), min(p99, high)
    return out


def cap_outliers(df: DataFrame, columns: list[str] | None = None, known: dict | None = None) -> tuple[DataFrame, dict[str, tuple[float, float, float, float]]]:
    """Values outside the fences replaced, and the fences used; capped columns become doubles."""
    known = fences(df, columns) if known is None else known
    changed = {}
    for c, (low, high, least, most) in known.items():
        v = col(c).cast("double")
        changed[c] = F.when(v < low, F.lit(float(least))).when(v > high, F.lit(float(most))).otherwise(v)
    return df.withColumns(changed) if changed else df, known


def exclude_outliers(df: DataFrame, columns: list[str] | None = None, known: dict | None = None) -> DataFrame:
    """Rows whose values are all inside the fences (``known`` or computed) or null."""
    known = fences(df, columns) if known is None else known
    tests = [col(c).isNull() | col(c).between(low, high) for c, (low, high, _, _) in known.items()]
    return df.filter(reduce(lambda a, b: a & b, tests)) if tests else df
