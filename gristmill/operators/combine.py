"""Several tables as one: unions by name with common types, full joins on shared keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, DoubleType, LongType, NumericType, StringType

from .profile import col

SOURCE, SHEET = "Source file", "Sheet"
MOST_KEYS = 3


def common_type(a, b):
    """The type that holds both: equal, wider number, else text."""
    if a == b:
        return a
    if isinstance(a, NumericType) and isinstance(b, NumericType):
        whole = not any(isinstance(t, (DoubleType, DecimalType)) or t.simpleString() == "float" for t in (a, b))
        return LongType() if whole else DoubleType()
    return StringType()


def diagonal_union(frames: dict[str, DataFrame], label: str | None = SOURCE) -> DataFrame:
    """All rows by column name; missing columns are null, types meet in the common one; ``label`` names the table of a row."""
    types: dict[str, object] = {}
    for df in frames.values():
        for f in df.schema.fields:
            types[f.name] = common_type(types.get(f.name, f.dataType), f.dataType)
    parts = []
    for name, df in frames.items():
        cells = [(col(c).cast(t) if c in df.columns else F.lit(None).cast(t)).alias(c) for c, t in types.items()]
        parts.append(df.select(*cells, *([F.lit(name).alias(label)] if label else [])))
    return reduce(DataFrame.unionAll, parts)


def one_row_per_key(df: DataFrame, keys: list[str], order_by: str | None = None) -> DataFrame:
    """Sums of numbers (0 where all are null) and first non-null of the rest, by key; ``order_by`` says what is first."""
    order = col(order_by) if order_by else F.monotonically_increasing_id()
    rest = [f for f in df.schema.fields if f.name not in keys and f.name != order_by]
    if not rest:
        return df.select(*[col(k) for k in keys]).distinct()
    marked = df.withColumn("__order", order)
    cells = []
    for f in rest:
        if isinstance(f.dataType, NumericType):
            cells.append(F.coalesce(F.sum(col(f.name)), F.lit(0)).alias(f.name))
        else:
            cells.append(F.min_by(col(f.name), F.when(col(f.name).isNotNull(), F.col("__order"))).alias(f.name))
    return marked.groupBy(*[col(k) for k in keys]).agg(*cells)


def join_keys(frames: list[DataFrame], suggested: list[str] = ()) -> list[str]:
    """Suggested columns that all tables have, else up to three common columns that aren't numbers."""
    shared = [c for c in frames[0].columns if c != SOURCE and all(c in df.columns for df in frames)]
    wanted = [c for c in suggested if c in shared]
    if wanted:
        return wanted
    texts = [c for c in shared if not any(isinstance(df.schema[c].dataType, NumericType) for df in frames)]
    return texts[:MOST_KEYS]


def _full(frames: list[DataFrame], keys: list[str]) -> DataFrame:
    return reduce(lambda a, b: a.join(b, keys, "full"), frames)


def full_join(frames: list[DataFrame], keys: list[str] | None = None, suggested: list[str] = (), order_by: str | None = None) -> DataFrame:
    """One row a key over all tables; a column that a former table has is called "<column> related <place>"."""
    frames = [df.drop(SOURCE) for df in frames]
    keys = keys or join_keys(frames, list(suggested))
    if not keys:
        raise ValueError("no common key")
    seen, ready = set(keys), []
    for place, df in enumerate(frames, 1):
        df = one_row_per_key(df, keys, order_by)
        for c in df.columns:
            if c not in keys and c in seen:
                df = df.withColumnRenamed(c, f"{c} related {place}")
        seen |= set(df.columns)
        ready.append(df)
    return _full(ready, keys)


def combine_sheets(sheets: dict[str, DataFrame]) -> DataFrame:
    """Sheets with common dimensions and different measures joined, measures 0 where missing; others stacked with their names."""
    held = {n: df for n, df in sheets.items() if df.columns}
    frames = list(held.values())
    if len(frames) == 1:
        return frames[0]
    numbers = [{f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)} for df in frames]
    keys = [c for c in frames[0].columns if all(c in df.columns for df in frames) and not any(c in n for n in numbers)]
    measures = set().union(*numbers)
    if keys and measures and any(n != numbers[0] for n in numbers):
        joined = full_join(frames, keys)
        return joined.fillna(0, subset=[f.name for f in joined.schema.fields if f.name not in keys and isinstance(f.dataType, NumericType)])
    return diagonal_union(held, SHEET)


def combine_files(files: dict[str, DataFrame], strategy: str = "portfolio", suggestion: dict | None = None) -> DataFrame:
    """A full join if that is the strategy and the first suggestion, and a key is found; else a union labelled by file."""
    if strategy == "join" and (suggestion or {}).get("type") == "join":
        keys = join_keys(list(files.values()), suggestion.get("columns", []))
        if keys:
            return full_join(list(files.values()), keys)
    return diagonal_union(files)
