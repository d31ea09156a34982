"""One reader for each format, chosen by the file's ending, and the sinks."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import MapType, VariantType

from .grid import read_delimited
from .json_text import read_json
from .xlsx import read_workbook

FORMATS = ("csv", "tsv", "xlsx", "xls", "json", "parquet")
#: Options that read what ``write_outputs`` wrote as CSV back whole: nothing about its form is guessed.
WRITTEN_CSV = {"delimiter": ",", "encoding": "utf-8", "header": True, "as_written": True}


def read_dataset(spark: SparkSession, path: str, fmt: str | None = None, max_rows: int | None = None, **options) -> tuple[DataFrame, dict]:
    """A table and what is known of its parsing; the format by ``fmt`` or the ending."""
    fmt = (fmt or path.rstrip("/").rsplit(".", 1)[-1]).lower()
    if fmt in ("csv", "tsv"):
        return read_delimited(spark, path, max_rows=max_rows, **options)
    if fmt in ("xlsx", "xls"):
        df, info = read_workbook(spark, path, old=fmt == "xls"), {"type": "workbook"}
    elif fmt == "json":
        return read_json(spark, path, max_rows=max_rows, **options)
    elif fmt == "parquet":
        df, info = spark.read.parquet(path), {"type": "parquet"}
    else:
        raise ValueError(f"unsupported format {fmt!r}; known: {', '.join(FORMATS)}")
    return (df.limit(max_rows) if max_rows else df), info


def write_outputs(df: DataFrame, parquet_path: str | None = None, csv_path: str | None = None) -> None:
    """Cleaned or combined rows as Parquet and as CSV with a header; nested columns as JSON text in CSV, texts whole."""
    from pyspark.sql import functions as F

    if parquet_path:
        df.write.mode("overwrite").parquet(parquet_path)
    if csv_path:
        nested = [f.name for f in df.schema.fields if f.dataType.typeName() in ("array", "struct") or isinstance(f.dataType, (MapType, VariantType))]
        flat = df.withColumns({c: F.to_json(c) for c in nested}) if nested else df
        # Quotes are doubled, as other readers expect; Spark trims texts unless told.
        flat.write.mode("overwrite").options(header=True, escape='"', encoding="UTF-8", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(csv_path)


def profile_json(document: dict) -> str:
    """A report as JSON: indented, keys sorted, other values as text."""
    return json.dumps(document, indent=2, sort_keys=True, ensure_ascii=False, default=str)
