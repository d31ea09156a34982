"""Row order: contiguous row numbers, and filling values along them, without a global window.

The order is that of the files as they are: by path, by the place of a split in its file, and by the
place of a row in its split. Spark reads splits in the order of their sizes and packs several in a task,
so neither partition numbers nor ascending ids tell it; the hidden columns of a file scan do. Rows are numbered in blocks
(pieces of at most BLOCK_ROWS rows of a split of a file, or of a partition of other tables); the few block totals are accumulated apart and
joined back, so a table of any size is ordered by its blocks in parallel. Once numbered, rows carry
``__row`` and ``__block`` through the steps that need the order, and tables may be written and read in between.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialized
from .profile import BLOCK, ROW, col

#: Plan nodes that keep the rows of a scan in their order.
_KEEPS_ORDER = ("Project", "Filter", "SubqueryAlias")
#: Rows of a block at most, however large a split is: a window over a block is sorted and held by one task.
BLOCK_ROWS = 1 << 16


def reads_files(df: DataFrame) -> bool:
    """Whether the rows of ``df`` are those of one file scan, in its order: selected, renamed or filtered only."""
    node = df._jdf.queryExecution().analyzed()
    while node.nodeName() in _KEEPS_ORDER:
        node = node.children().head()
    return node.getClass().getSimpleName() == "LogicalRelation" and node.metadataOutput().nonEmpty()


def source_place(df: DataFrame) -> tuple[Column, Column]:
    """The file and the start of the split that a row was read from; constants for tables that aren't file scans."""
    if not reads_files(df):
        return F.lit(""), F.lit(0).cast("long")
    hidden = df.metadataColumn("_metadata")
    return hidden["file_path"], hidden["file_block_start"]


def with_row_number(df: DataFrame, order_by: list[str] | None = None) -> DataFrame:
    """``df`` with ``__row`` (0, 1, ...) in its order, or that of columns; and ``__block``, an ascending part of it.

    The order of a file scan is that of its files (by path) and rows; of other tables that of their
    partitions. A table that has its numbers already is numbered anew in their order, without gaps.
    """
    if ROW in df.columns and BLOCK in df.columns and not order_by:
        return _renumbered(df)
    file, start = (F.lit(""), F.lit(0).cast("long")) if order_by else source_place(df)
    rows = df.orderBy(*[col(c).asc_nulls_last() for c in order_by]) if order_by else df
    # Rows of a split follow each other in one task, so their ids have no gaps.
    rows = rows.drop(ROW, BLOCK).select("*", file.alias("__file"), start.alias("__start"), F.monotonically_increasing_id().alias("__id"))
    marked = materialized(rows.withColumn("__part", F.floor(F.col("__id") / BLOCK_ROWS)))  # ids of a partition start at a multiple of 2^33
    split = ["__file", "__start", "__part"]
    sizes = marked.groupBy(*split).agg(F.count(F.lit(1)).alias("__size"), F.min("__id").alias("__first"))
    along = Window.orderBy(*split)  # a row a block
    before = F.coalesce(F.sum("__size").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = materialized(sizes.select(*split, (before - F.col("__first")).alias("__shift"), (F.row_number().over(along) - 1).cast("long").alias(BLOCK)))
    return marked.join(starts, split).withColumn(ROW, F.col("__id") + F.col("__shift")).drop(*split, "__id", "__shift")


def _renumbered(df: DataFrame) -> DataFrame:
    """Numbers without gaps after rows have left; blocks stay."""
    sizes = df.groupBy(BLOCK).agg(F.count(F.lit(1)).alias("__size"))
    before = Window.orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    starts = materialized(sizes.select(BLOCK, F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__shift")))
    inside = F.row_number().over(Window.partitionBy(BLOCK).orderBy(ROW))
    return df.withColumn(ROW, inside).join(starts, BLOCK).withColumn(ROW, F.col(ROW) + F.col("__shift") - 1).drop("__shift")


def interpolate(df: DataFrame, columns: list[str]) -> DataFrame:
    """Inner nulls of numeric columns from their neighbours by row number, trailing ones from the last value; leading ones stay."""
    # What follows is what precedes in descending order: frames that grow cost one step a row.
    growing = lambda w: w.rowsBetween(Window.unboundedPreceding, 0)
    past, next_ = (growing(Window.partitionBy(BLOCK).orderBy(o)) for o in (F.col(ROW).asc(), F.col(ROW).desc()))
    point = {c: F.when(col(c).isNotNull(), F.struct(F.col(ROW).alias("at"), col(c).cast("double").alias("v"))) for c in columns}
    ends = df.groupBy(BLOCK).agg(*[f(point[c]).alias(f"{n}{i}") for i, c in enumerate(columns) for n, f in (("first", F.min), ("last", F.max))])
    earlier, later = (Window.orderBy(o).rowsBetween(Window.unboundedPreceding, -1) for o in (F.col(BLOCK).asc(), F.col(BLOCK).desc()))
    carried = []
    for i in range(len(columns)):
        carried.append(F.last(f"last{i}", True).over(earlier).alias(f"__p{i}"))
        carried.append(F.last(f"first{i}", True).over(later).alias(f"__n{i}"))
    wide = df.join(materialized(ends.select(F.col(BLOCK), *carried)), BLOCK)
    for i, c in enumerate(columns):
        wide = wide.withColumn(f"__p{i}", F.coalesce(F.last(point[c], True).over(past), F.col(f"__p{i}"))).withColumn(f"__n{i}", F.coalesce(F.last(point[c], True).over(next_), F.col(f"__n{i}")))
    filled = {}
    for i, c in enumerate(columns):
        p, n = F.col(f"__p{i}"), F.col(f"__n{i}")
        line = p["v"] + (n["v"] - p["v"]) * ((F.col(ROW) - p["at"]) / (n["at"] - p["at"]))
        filled[c] = F.coalesce(col(c).cast("double"), F.when(p.isNotNull() & n.isNotNull(), line), p["v"])
    return wide.withColumns(filled).drop(*[f"__{k}{i}" for i in range(len(columns)) for k in "pn"])
