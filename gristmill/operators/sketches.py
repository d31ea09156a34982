"""Profiles that grow with a table: sketches of each file, merged.

An alternative to the exact profiles where a table grows by files: the sketches of files that are
already known stay as they are, and only new files are read. Counts, nulls, least and greatest values and sums
merge exactly; distinct counts come from HyperLogLog sketches and quantiles from KLL sketches, within their error
bounds. A sketch's size doesn't depend on the number of rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import source_place
from .profile import col, columns_of, data_columns, union

#: Registers of the distinct counts (a relative error of 1.04 / 2**(LOG_REGISTERS / 2)), and the accuracy of quantiles (an error of rank of about 1.7 % at 200).
LOG_REGISTERS, ACCURACY = 14, 400
SCHEMA = "file string, column_name string, row_count long, missing long, low double, high double, total double, distinct binary, quantiles binary"


def file_sketches(df: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """A row for each file and column of a table that is read from files; files in ``known`` (earlier sketches) are left out unread.

    One aggregate over all columns; tasks send a sketch for each file they read. A table that isn't a file scan
    counts as one file without a name.
    """
    file, _ = source_place(df)
    rows = df.withColumn("__file", file)
    if known is not None:
        done = [r.file for r in known.select("file").distinct().collect()]  # a name a file
        rows = rows.filter(~F.col("__file").isin(done)) if done else rows
    numeric = set(columns_of(df, "numeric"))
    none = F.lit(None).cast("double")

    def facts(c: str):
        value = col(c)
        number = value.cast("double") if c in numeric else none
        sketch = F.kll_sketch_agg_double(number, ACCURACY) if c in numeric else F.lit(None).cast("binary")
        parts = {"row_count": F.count(F.lit(1)), "missing": F.count_if(value.isNull()), "low": F.min(number), "high": F.max(number), "total": F.sum(number), "distinct": F.hll_sketch_agg(F.md5(value.cast("string").cast("binary")), LOG_REGISTERS), "quantiles": sketch}
        return F.struct(F.lit(c).alias("column_name"), *[x.alias(n) for n, x in parts.items()])

    columns = data_columns(df)
    wide = rows.groupBy(F.col("__file").alias("file")).agg(*[facts(c).alias(f"c{i}") for i, c in enumerate(columns)])
    return wide.select("file", F.explode(F.array(*[F.col(f"c{i}") for i in range(len(columns))])).alias("r")).select("file", "r.*")


def merged_profile(sketches: DataFrame, probabilities: tuple[float, ...] = (0.25, 0.5, 0.75)) -> DataFrame:
    """(column_name, row_count, missing, min, max, mean, distinct_count, quantiles) of all files together."""
    one = sketches.groupBy("column_name").agg(
        F.sum("row_count").alias("row_count"), F.sum("missing").alias("missing"), F.min("low").alias("min"), F.max("high").alias("max"), F.sum("total").alias("total"),
        F.hll_sketch_estimate(F.hll_union_agg("distinct")).alias("distinct_count"), F.kll_merge_agg_double("quantiles").alias("all"), F.count("quantiles").alias("sketched"),
    )
    held = F.col("row_count") - F.col("missing")
    mean = F.when((F.col("sketched") > 0) & (held > 0), F.col("total") / held)
    ranks = F.array(*[F.lit(float(p)) for p in probabilities])
    found = F.when((F.col("sketched") > 0) & (held > 0), F.kll_sketch_get_quantile_double("all", ranks))
    return one.select("column_name", "row_count", "missing", "min", "max", mean.alias("mean"), "distinct_count", found.alias("quantiles"))


def grown_profile(df: DataFrame, known: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """The profile of a grown table from its known sketches and those of its new files; and all sketches, to keep."""
    new = file_sketches(df, known)
    sketches = new if known is None else union([known, new])
    return merged_profile(sketches), sketches
