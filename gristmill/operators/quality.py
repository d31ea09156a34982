"""Data quality: duplicates, missing-value issues, the score, and optional deeper checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .profile import as_rows, col, columns_of, exact_quantiles

# What an issue of a severity takes off the score, at the whole and at the least share of rows.
SEVERITY_WEIGHTS = {"low": 1.5, "medium": 4.0, "high": 8.0, "critical": 14.0}
LEAST_SHARE, MOST_ISSUES, MOST_FIXES = 0.05, 25, 10
MONEY_WORDS = ("revenue", "sales", "price", "amount", "cost", "profit")


def duplicate_rows(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row: duplicate_groups, affected_rows (copies beyond the first of equal rows)."""
    groups = df.groupBy(*[col(c) for c in columns or df.columns]).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > 1)
    return groups.agg(F.count(F.lit(1)).alias("duplicate_groups"), F.coalesce(F.sum(F.col("__n") - 1), F.lit(0)).cast("long").alias("affected_rows"))


def missing_issues(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column_name, severity, affected_rows, row_count) for columns with nulls."""
    columns = columns or df.columns
    parts = [F.struct(F.lit(c).alias("column_name"), F.count_if(col(c).isNull()).alias("affected_rows"), F.count(F.lit(1)).alias("row_count")).alias(f"c{i}") for i, c in enumerate(columns)]
    rows = as_rows(df.agg(*parts), [f"c{i}" for i in range(len(columns))]).filter("affected_rows > 0")
    share = F.col("affected_rows") / F.col("row_count")
    return rows.withColumn("severity", F.when(share > 0.5, "critical").when(share > 0.2, "high").otherwise("low"))


def quality_issues(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column_name, issue_type, severity, affected_rows, row_count): missing values, then duplicate rows (no column)."""
    missing = missing_issues(df, columns).select("column_name", F.lit("missing_values").alias("issue_type"), "severity", "affected_rows", "row_count")
    copies = duplicate_rows(df, columns).filter("affected_rows > 0")
    total = df.agg(F.count(F.lit(1)).alias("row_count"))
    copies = copies.withColumn("k", F.lit(1)).join(total.withColumn("k", F.lit(1)), "k")
    return missing.union(copies.select(F.lit(None).cast("string"), F.lit("duplicate_rows"), F.lit("medium"), "affected_rows", "row_count"))


def quality_score(issues: DataFrame, row_count: int) -> DataFrame:
    """One row: quality_score (0 to 100, halves to even; 0 for an empty table), issue_count."""
    weight = F.element_at(F.create_map(*[F.lit(x) for pair in SEVERITY_WEIGHTS.items() for x in pair]), F.col("severity"))
    share = F.greatest(F.least(F.col("affected_rows") / F.lit(max(row_count, 1)), F.lit(1.0)), F.lit(LEAST_SHARE))
    lost = F.coalesce(F.sum(weight * share), F.lit(0.0))
    score = F.greatest(F.least(F.bround(100 - lost, 0), F.lit(100.0)), F.lit(0.0)).cast("int") if row_count else F.lit(0)
    return issues.agg(score.alias("quality_score"), F.count(F.lit(1)).alias("issue_count"))


def score_of(issues: list[dict], row_count: int) -> int:
    """The score of quality_score from collected issues."""
    lost = sum(SEVERITY_WEIGHTS[i["severity"]] * max(min(i["affected_rows"] / max(row_count, 1), 1.0), LEAST_SHARE) for i in issues)
    return int(max(min(round(100 - lost), 100), 0)) if row_count else 0


def deep_quality(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column_name, negative_money, outside_fences): negative amounts in money columns, values outside the quartile fences."""
    columns = columns or columns_of(df, "numeric")
    quartiles = exact_quantiles(df, columns, (0.25, 0.75))
    parts = []
    for i, c in enumerate(columns):
        a, b = quartiles[c]
        money = any(w in c.lower() for w in MONEY_WORDS)
        outside = F.lit(0).cast("long") if a is None or a == b else F.count_if(~col(c).between(a - 1.5 * (b - a), b + 1.5 * (b - a)))
        parts.append(F.struct(F.lit(c).alias("column_name"), (F.count_if(col(c) < 0) if money else F.lit(0).cast("long")).alias("negative_money"), outside.alias("outside_fences")).alias(f"c{i}"))
    return as_rows(df.agg(*parts), [f"c{i}" for i in range(len(columns))])
