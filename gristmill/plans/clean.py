"""The cleaning pipeline: fixed order, each step lazy but for one aggregate over all its candidates."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import names as N
from ..functions import text as T
from ..operators.categories import canonical_categories
from ..operators.dedup import exact_distinct, fuzzy_report
from ..operators.missing import drop_empty, fill_missing
from ..operators.ordered import with_row_number
from ..operators.outliers import cap_outliers, exclude_outliers, fences
from ..operators.profile import BLOCK, ROW, col
from ..session import counted, materialized

# Shares of a column's values that must read as dates or numbers.
DATE_SHARE, NUMBER_SHARE = 0.7, 0.85
#: Changes of spelling that the report lists, the commonest first; it tells their number.
LISTED_CHANGES = 100
#: Rows dropped as near copies that the report lists.
LISTED_EXAMPLES = 5


@dataclass(frozen=True)
class CleaningOptions:
    remove_duplicates: bool = True
    fuzzy_deduplicate: bool = False
    standardize_columns: bool = True
    normalize_dates: bool = True
    clean_text: bool = True
    parse_currency_percent: bool = True
    drop_empty: bool = True
    missing_data_strategy: str = "smart"  # or "none"
    outlier_policy: str = "keep"  # or "cap", "exclude"
    semantic_categorical_merging: bool = True

    def __post_init__(self):
        if self.outlier_policy not in ("keep", "cap", "exclude"):
            object.__setattr__(self, "outlier_policy", "keep")
        if self.missing_data_strategy not in ("smart", "none"):
            object.__setattr__(self, "missing_data_strategy", "smart")


def _texts(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, StringType)]


def normalize_dates(df: DataFrame) -> tuple[DataFrame, list[dict]]:
    """Text columns that are dates by name or look, and of which 70 % parse, as dates or UTC timestamps.

    One aggregate over all values tells which columns look like dates, another counts what parses. A
    number over 12 is a day wherever it stands, so both orders of day and month read the same cells; where
    both are possible the month comes first.
    """
    columns = _texts(df)
    if not columns:
        return df, []
    clean = {c: T.without_missing(col(c)) for c in columns}
    open_ = [c for c in columns if not N.is_date_like(c)]
    shares = df.agg(*[F.avg(T.looks_like_date(clean[c]).cast("int")).alias(f"s{i}") for i, c in enumerate(open_)]).first() if open_ else {}
    wanted = [c for c in columns if c not in open_ or (shares[f"s{open_.index(c)}"] or 0) >= DATE_SHARE]
    if not wanted:
        return df, []
    moments = {c: T.moment_in(clean[c]) for c in wanted}
    cells = [F.col(f"v{i}") for i in range(len(wanted))]  # cleaned once
    counts = df.select(*[clean[c].alias(f"v{i}") for i, c in enumerate(wanted)]).agg(*[F.struct(F.count(v).alias("filled"), F.count(T.moment_in(v)).alias("parsed"), F.coalesce(F.max(T.has_clock(v)), F.lit(False)).alias("clock")).alias(f"c{i}") for i, v in enumerate(cells)]).first()
    changed, report = {}, []
    for i, c in enumerate(wanted):
        n = counts[f"c{i}"]
        if n["filled"] and n["parsed"] >= DATE_SHARE * n["filled"]:
            changed[c] = moments[c] if n["clock"] else F.to_date(moments[c])
            report.append({"column": c, "strategy": "month_first", "parsed_values": n["parsed"], "failed_values": n["filled"] - n["parsed"], "standard": "UTC datetime" if n["clock"] else "YYYY-MM-DD"})
    return (df.withColumns(changed) if changed else df), report


def parse_numbers(df: DataFrame, strict: bool = False) -> tuple[DataFrame, list[dict]]:
    """Text columns of which 85 % show a number as doubles; flags say whether they look like money or shares."""
    columns = [c for c in _texts(df) if not N.is_date_like(c)]
    if not columns:
        return df, []
    clean = {c: T.without_missing(col(c)) for c in columns}
    cells = [F.col(f"v{i}") for i in range(len(columns))]  # cleaned once
    counts = df.select(*[clean[c].alias(f"v{i}") for i, c in enumerate(columns)]).agg(*[F.struct(F.count(v).alias("filled"), F.count(T.number_in(v, strict)).alias("parsed"), F.coalesce(F.max(T.shows_currency(v)), F.lit(False)).alias("currency"), F.coalesce(F.max(v.contains("%")), F.lit(False)).alias("percent")).alias(f"c{i}") for i, v in enumerate(cells)]).first()
    changed, report = {}, []
    for i, c in enumerate(columns):
        n, name = counts[f"c{i}"], N.standard_name(c)
        if n["filled"] and n["parsed"] >= NUMBER_SHARE * n["filled"]:
            changed[c] = T.number_in(clean[c], strict)
            report.append({"column": c, "parsed_values": n["parsed"], "failed_values": n["filled"] - n["parsed"], "detected_currency": n["currency"] or any(w in name for w in N.CURRENCY_NAME_WORDS), "detected_percent": n["percent"] or any(w in name for w in N.PERCENT_NAME_WORDS)})
    return (df.withColumns(changed) if changed else df), report


def clean(df: DataFrame, options: CleaningOptions | None = None, order_by: list[str] | None = None, row_column: str | None = None) -> tuple[DataFrame, dict]:
    """Names, text, empties, dates, numbers, missing values, duplicates, outliers, categories, in this order; with a report.

    Every step that decides by the data is preceded by a written table, so that its input isn't
    computed again for each decision. ``order_by`` gives the row order that filling and both
    deduplications follow; without it that is the order of the rows in the files that ``df`` reads, which are
    numbered first and carry their numbers through all steps. ``row_column`` keeps the numbers
    under that name, ascending in the order of the rows. The report's counts come with the writes that happen anyway.
    """
    o = options or CleaningOptions()
    report: dict = {"columns_before": len(df.columns), "steps": []}
    rows = {"rows": F.count(F.lit(1))}
    if o.standardize_columns:
        new = N.standard_names(df.columns)
        report["renamed"] = {a: b for a, b in zip(df.columns, new, strict=True) if a != b}
        if order_by:
            order_by = [new[df.columns.index(c)] for c in order_by]
        df = df.toDF(*new)
        report["steps"].append("standardize_columns")
    if o.clean_text and _texts(df):
        df = df.withColumns({c: T.without_missing(col(c)) for c in _texts(df)})
        report["steps"].append("clean_text")
    df = with_row_number(df, order_by)
    report["rows_before"] = df.count()
    if o.drop_empty:
        df = drop_empty(df)
        report["steps"].append("drop_empty")
    if o.normalize_dates:
        df, report["dates"] = normalize_dates(df)
        report["steps"].append("normalize_dates")
    if o.parse_currency_percent:
        df, report["numbers"] = parse_numbers(df)
        report["steps"].append("parse_currency_percent")
    df, seen = counted(df, rows)
    df = materialized(df)
    report["empty_rows_dropped"] = report["rows_before"] - seen.get["rows"]
    kept = seen.get["rows"]
    if o.missing_data_strategy == "smart":
        df, report["missing"] = fill_missing(df)
        report["steps"].append("missing_values")
    df, filled = counted(df, rows)
    if o.remove_duplicates:
        df = exact_distinct(df)
        report["steps"].append("remove_duplicates")
    df, distinct = counted(df, rows)
    df = materialized(df)
    report["rows_without_measures_dropped"] = kept - filled.get["rows"]
    report["duplicates_removed"] = filled.get["rows"] - distinct.get["rows"]
    kept = distinct.get["rows"]
    if o.fuzzy_deduplicate:
        df, gone = fuzzy_report(df)
        df, near = counted(df, rows)
        df = materialized(df)
        examples = gone.orderBy("dropped_row").limit(LISTED_EXAMPLES).collect()
        report["fuzzy"] = {"removed_rows": kept - near.get["rows"], "examples": [r.asDict() for r in examples]}
        kept = near.get["rows"]
        report["steps"].append("fuzzy_deduplicate")
    capped = None
    if o.outlier_policy != "keep":
        known = fences(df)
        outside = {c: F.count_if((col(c) < low) | (col(c) > high)) for c, (low, high, _, _) in known.items()}
        if known:
            df, capped = counted(df, {f"c{i}": x for i, x in enumerate(outside.values())})
        df = cap_outliers(df, known=known)[0] if o.outlier_policy == "cap" else exclude_outliers(df, known=known)
        report["steps"].append(f"{o.outlier_policy}_outliers")
    if o.semantic_categorical_merging:
        df, mapping = canonical_categories(df)
        report["categories"], report["category_changes"] = {}, mapping.count() if mapping is not None else 0
        for r in mapping.orderBy(F.col("rows").desc(), "column_name", "value").limit(LISTED_CHANGES).collect() if mapping is not None else ():
            report["categories"].setdefault(r.column_name, {})[r.value] = r.canonical
        report["steps"].append("semantic_categorical_merging")
    df, last = counted(df, rows)
    df = materialized(df)
    if capped is not None:
        by_column = {c: capped.get[f"c{i}"] for i, c in enumerate(outside)}
        report["outliers"] = {"policy": o.outlier_policy, "fences": known, "values_outside": by_column, "rows_excluded": kept - last.get["rows"]}
    df = df.withColumnRenamed(ROW, row_column).drop(BLOCK) if row_column else df.drop(ROW, BLOCK)
    report |= {"rows_after": last.get["rows"], "columns_after": len(df.columns) - bool(row_column)}
    return df, report
