"""Lists over stored results: filtered pages, roll-ups, conversation turns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .profile import col


def filtered(df: DataFrame, search: dict[str, str] | None = None, equal: dict[str, object] | None = None, among: dict[str, list] | None = None) -> DataFrame:
    """Rows whose columns contain texts (any case), equal values, or are among lists."""
    for c, text in (search or {}).items():
        pattern = text.replace("\\", "\\\\").replace("%", r"\%").replace("_", r"\_")
        df = df.filter(col(c).ilike(f"%{pattern}%"))
    for c, value in (equal or {}).items():
        df = df.filter(col(c) == value)
    for c, values in (among or {}).items():
        df = df.filter(col(c).isin(values))
    return df


def page(df: DataFrame, order_by: str, ties: list[str], number: int = 1, size: int = 20) -> DataFrame:
    """A page of the newest first, with the total of all rows."""
    total = df.agg(F.count(F.lit(1)).alias("total_count")).withColumn("__k", F.lit(1))
    rows = df.orderBy(col(order_by).desc(), *[col(t) for t in ties]).offset((number - 1) * size).limit(size)
    return rows.withColumn("__k", F.lit(1)).join(F.broadcast(total), "__k").drop("__k")


def page_after(df: DataFrame, order_by: str, ties: list[str], after: dict | None = None, size: int = 20) -> DataFrame:
    """The ``size`` rows that follow the row ``after`` (its values of the order's columns), the newest first.

    Only rows behind the key are compared, and each task sends on ``size`` of them: no page, however late, sorts the
    table. Rows without the order's column aren't listed.
    """
    rows = df.filter(col(order_by).isNotNull())
    if after is not None:
        same, behind = col(order_by) == F.lit(after[order_by]), col(order_by) < F.lit(after[order_by])
        for t in ties:
            behind, same = behind | (same & (col(t) > F.lit(after[t]))), same & (col(t) == F.lit(after[t]))
        rows = rows.filter(behind)
    return rows.orderBy(col(order_by).desc(), *[col(t) for t in ties]).limit(size)


def write_results(df: DataFrame, path: str, analysis: str = "analysis_id") -> None:
    """Store the rows of analyses, one folder each; those of an analysis that is stored already are replaced, others stay.

    A rerun or a retried job leaves the rows of its last success: Spark commits the folders when all tasks are done.
    """
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(analysis).parquet(path)


def roll_up(df: DataFrame, status: str, size: str, done: str, active: list[str]) -> DataFrame:
    """One row: total, completed, active, row_sum."""
    return df.agg(F.count(F.lit(1)).alias("total"), F.count_if(col(status) == done).alias("completed"), F.count_if(col(status).isin(active)).alias("active"), F.coalesce(F.sum(col(size)), F.lit(0)).alias("row_sum"))


def last_turns(df: DataFrame, conversation: str, turn: str, most: int = 10) -> DataFrame:
    """Of each conversation the last turns, oldest first."""
    from pyspark.sql import Window

    newest = F.row_number().over(Window.partitionBy(col(conversation)).orderBy(col(turn).desc()))
    return df.withColumn("__n", newest).filter(F.col("__n") <= most).drop("__n").orderBy(col(conversation), col(turn))
