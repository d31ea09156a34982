"""Missing values: rows without measures go, measures are filled, texts read "Unknown"."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.names import is_identifier, is_year
from .ordered import interpolate, with_row_number
from .profile import BLOCK, ROW, col, columns_of, data_columns, exact_quantiles

UNKNOWN = "Unknown"


def drop_empty(df: DataFrame) -> DataFrame:
    """Without columns and rows that are all null."""
    columns = data_columns(df)
    held = df.agg(F.count(F.lit(1)), *[F.count(col(c)).alias(f"c{i}") for i, c in enumerate(columns)]).first()
    kept = [c for i, c in enumerate(columns) if held[f"c{i}"]]
    order = [c for c in (BLOCK, ROW) if c in df.columns]
    return df.select(*[col(c) for c in [*kept, *order]]).dropna("all", subset=kept) if kept else df.limit(0)


def fill_missing(df: DataFrame, order_by: list[str] | None = None) -> tuple[DataFrame, dict]:
    """Fill nulls: measures by interpolation in row order where the table has dates (else, and at the start, by the median), texts by "Unknown".

    The order is that of ``order_by``, of the numbers that the table carries, or of the files it is read from. Rows whose measures (numeric columns but identifiers and years) are all null go first. Medians
    are those of the rows left. Dates, booleans and identifiers stay as they are.
    """
    numbers = [c for c in columns_of(df, "numeric") if not is_identifier(c)]
    measures = [c for c in numbers if not is_year(c)]
    report = {"filled": [], "unknown": []}
    if measures:
        df = df.dropna("all", subset=measures)
    nulls = df.agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(col(c).isNull()).alias(f"c{i}") for i, c in enumerate(df.columns)]).first()
    gaps = {c: nulls[f"c{i}"] for i, c in enumerate(df.columns) if nulls[f"c{i}"]}
    open_ = [c for c in numbers if c in gaps]
    medians = exact_quantiles(df, open_, (0.5,))
    if open_ and columns_of(df, "temporal") and nulls["rows"] >= 3:
        names = df.columns
        df = interpolate(with_row_number(df, order_by), open_).select(*[col(c) for c in names])
        report["filled"] = [{"column": c, "strategy": "interpolate", "cells": gaps[c]} for c in open_]
    else:
        report["filled"] = [{"column": c, "strategy": "median", "cells": gaps[c]} for c in open_]
    known = {c: v for c, (v,) in medians.items() if v is not None}
    if known:
        df = df.withColumns({c: F.coalesce(col(c).cast("double"), F.lit(float(v))) for c, v in known.items()})
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, StringType) and f.name in gaps]
    if texts:
        df = df.withColumns({c: F.coalesce(col(c), F.lit(UNKNOWN)) for c in texts})
        report["unknown"] = [{"column": c, "cells": gaps[c]} for c in texts]
    return df, report


__all__ = ["BLOCK", "ROW", "UNKNOWN", "drop_empty", "fill_missing"]
