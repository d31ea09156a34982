"""The registered queries over the test tables, each with its DuckDB SQL where SQL expresses it."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import names
from .functions import text as T
from .operators import categories, charts, combine, dedup, missing, ordered, outliers, profile, quality, ranking, series, sketches, store
from .plans import analyze as analysis
from .plans import clean as cleaning
from .plans.chart_plan import select_charts
from .plans.kpis import detect_kpis
from .plans.relate import relationship_suggestions as related
from .session import materialized, shared_path
from .sources import grid, readers, xlsx

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register the function under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _each(columns: list[str], sql: str) -> str:
    return "\nUNION ALL\n".join(sql.format(c=c) for c in columns)


LINEITEM_NUMBERS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(_each(LINEITEM_NUMBERS, "SELECT '{c}' AS column_name, count({c}) AS count, count(*) - count({c}) AS null_count, round(min({c})::DOUBLE + 0.0, 4) AS min, round(max({c})::DOUBLE + 0.0, 4) AS max, round(avg({c}::DOUBLE), 4) AS mean, round(stddev_samp({c}::DOUBLE), 4) AS std, round(percentile_cont(0.25) WITHIN GROUP (ORDER BY {c}::DOUBLE), 4) AS p25, round(percentile_cont(0.5) WITHIN GROUP (ORDER BY {c}::DOUBLE), 4) AS p50, round(percentile_cont(0.75) WITHIN GROUP (ORDER BY {c}::DOUBLE), 4) AS p75, round(sum({c}::DOUBLE), 2) AS total FROM lineitem"))
def numeric_profile_lineitem(spark, sf_dir):
    out = profile.numeric_profile(read(spark, sf_dir, "lineitem"))
    return out.select("column_name", "count", "null_count", *[F.round(c, 4).alias(c) for c in ("min", "max", "mean", "std", "p25", "p50", "p75")], F.round("total", 2).alias("total"))


DOCUMENT_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars", "quality", "toxic"]


def _marked(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id", "left")


@query("WITH t AS (SELECT * FROM documents LEFT JOIN labels USING (doc_id))\n" + _each(DOCUMENT_COLUMNS, "SELECT '{c}' AS column_name, count(*) AS row_count, count(*) - count({c}) AS missing, count(DISTINCT {c}) AS distinct_count FROM t"))
def missing_and_distinct_profile(spark, sf_dir):
    return profile.missing_and_distinct(_marked(spark, sf_dir), DOCUMENT_COLUMNS)


@query("WITH c AS (" + _each(["o_orderstatus", "o_orderpriority"], "SELECT '{c}' AS column_name, {c} AS value, count(*) AS count FROM orders WHERE {c} IS NOT NULL GROUP BY 2") + ") SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY count DESC, value)::INTEGER AS place FROM c) WHERE place <= 10")
def top_values_by_column(spark, sf_dir):
    return profile.top_values(read(spark, sf_dir, "orders"))


SKETCHED = ["o_custkey", "o_totalprice", "o_orderstatus"]


@query(_each(SKETCHED, "SELECT '{c}' AS column_name, count(*) AS row_count, count(*) - count({c}) AS missing, true AS near, true AS unread FROM orders"))
def grown_profile(spark, sf_dir):
    """Orders written as two files, the second after the first was profiled: merged sketches against exact values, within their bounds."""
    path, rows = shared_path(spark), read(spark, sf_dir, "orders").select(*SKETCHED)
    rows.filter("o_custkey % 3 > 0").repartition(3).write.parquet(path)
    _, known = sketches.grown_profile(spark.read.parquet(path), None)
    known = materialized(known)
    rows.filter("o_custkey % 3 = 0").repartition(2).write.mode("append").parquet(path)
    grown = spark.read.parquet(path)
    new = sketches.file_sketches(grown, known)
    found = sketches.merged_profile(profile.union([known, new]), (0.5,))
    exact = profile.missing_and_distinct(rows, SKETCHED).select("column_name", "distinct_count")
    numbers = profile.numeric_profile(rows).select("column_name", "p25", "p75")
    both = found.withColumnRenamed("distinct_count", "estimate").join(exact, "column_name").join(numbers, "column_name", "left")
    near = (F.abs(F.col("estimate") - F.col("distinct_count")) <= 0.03 * F.col("distinct_count")) & F.coalesce(F.get("quantiles", F.lit(0)).between(F.col("p25"), F.col("p75")), F.lit(True))
    unread = F.lit(new.select("file").distinct().count() == 2)
    return both.select("column_name", "row_count", "missing", near.alias("near"), unread.alias("unread"))


@query("SELECT 'l_shipdate' AS column_name, min(l_shipdate) AS min_date, max(l_shipdate) AS max_date FROM lineitem UNION ALL SELECT 'o_orderdate', min(o_orderdate), max(o_orderdate) FROM orders")
def date_range_profile(spark, sf_dir):
    return profile.date_range_profile(read(spark, sf_dir, "lineitem")).union(profile.date_range_profile(read(spark, sf_dir, "orders")))


PART_NUMBERS = ["p_partkey", "p_size", "p_retailprice"]


@query("SELECT * FROM (" + "\nUNION ALL\n".join(f"SELECT '{a}' AS left_column, '{b}' AS right_column, round(corr({a}, {b}), 3) AS correlation FROM part" for i, a in enumerate(PART_NUMBERS) for b in PART_NUMBERS[i + 1 :]) + ") WHERE abs(correlation) > 0.3 AND NOT isnan(correlation)")
def correlation_pairs(spark, sf_dir):
    return profile.correlation_pairs(read(spark, sf_dir, "part"), PART_NUMBERS)


@query("SELECT count(*) AS duplicate_groups, coalesce(sum(n - 1), 0)::BIGINT AS affected_rows FROM (SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1)")
def duplicate_rows(spark, sf_dir):
    return quality.duplicate_rows(read(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


_ISSUES_SQL = "t AS (SELECT lang, source, quality, toxic FROM documents LEFT JOIN labels USING (doc_id)), m AS (" + _each(["lang", "source", "quality", "toxic"], "SELECT '{c}' AS column_name, count(*) - count({c}) AS affected_rows, count(*) AS row_count FROM t") + "), issues AS (SELECT column_name, 'missing_values' AS issue_type, CASE WHEN affected_rows > 0.5 * row_count THEN 'critical' WHEN affected_rows > 0.2 * row_count THEN 'high' ELSE 'low' END AS severity, affected_rows, row_count FROM m WHERE affected_rows > 0 UNION ALL SELECT NULL, 'duplicate_rows', 'medium', sum(n - 1)::BIGINT, (SELECT count(*) FROM t) FROM (SELECT count(*) AS n FROM t GROUP BY lang, source, quality, toxic HAVING count(*) > 1) HAVING sum(n - 1) > 0)"


@query(f"WITH {_ISSUES_SQL} SELECT * FROM issues")
def data_quality_issues(spark, sf_dir):
    return quality.quality_issues(_marked(spark, sf_dir).select("lang", "source", "quality", "toxic"))


@query(f"WITH {_ISSUES_SQL} SELECT greatest(least(round_even(100 - coalesce(sum((CASE severity WHEN 'low' THEN 1.5 WHEN 'medium' THEN 4.0 WHEN 'high' THEN 8.0 ELSE 14.0 END)::DOUBLE * greatest(least(affected_rows / row_count, 1), 0.05)), 0), 0), 100), 0)::INTEGER AS quality_score, count(*) AS issue_count FROM issues")
def data_quality_score(spark, sf_dir):
    rows = _marked(spark, sf_dir).select("lang", "source", "quality", "toxic")
    return quality.quality_score(quality.quality_issues(rows), rows.count())


@query("WITH q AS (SELECT quantile_cont(value::DOUBLE, 0.25) AS a, quantile_cont(value::DOUBLE, 0.75) AS b FROM events) SELECT 'value' AS column_name, 0::BIGINT AS negative_money, count(*) FILTER (NOT value BETWEEN a - 1.5 * (b - a) AND b + 1.5 * (b - a)) AS outside_fences FROM events, q")
def deep_quality_events(spark, sf_dir):
    return quality.deep_quality(read(spark, sf_dir, "events"), ["value"])


_SERIES_SQL = "s AS (SELECT date_trunc('month', o_orderdate)::TIMESTAMP AS period, sum(o_totalprice) AS value FROM orders WHERE o_orderdate IS NOT NULL AND o_totalprice IS NOT NULL GROUP BY 1)"


@query(f"WITH {_SERIES_SQL} SELECT period, round(value, 2) AS value FROM s")
def monthly_series(spark, sf_dir):
    return series.monthly_series(read(spark, sf_dir, "orders"), "o_orderdate", "o_totalprice").withColumn("value", F.round("value", 2))


@query(f"WITH {_SERIES_SQL}, z AS (SELECT period, value, abs((value - avg(value) OVER ()) / nullif(stddev_samp(value) OVER (), 0)) AS z_score FROM s) SELECT period, round(value, 2) AS value, round(z_score, 4) AS z_score FROM z WHERE z_score >= 2.5 ORDER BY z_score DESC, period LIMIT 2")
def monthly_spikes(spark, sf_dir):
    return series.monthly_spikes(read(spark, sf_dir, "orders"), "o_orderdate", "o_totalprice").select("period", F.round("value", 2).alias("value"), F.round("z_score", 4).alias("z_score"))


@query("WITH s AS (SELECT avg(value) AS mean, stddev_samp(value) AS std FROM events) SELECT 'value' AS column_name, round(value, 4) AS value, round(mean, 4) AS mean, round(std, 4) AS std, round(abs((value - mean) / std), 4) AS z_score FROM events, s WHERE abs((value - mean) / std) >= 3 ORDER BY abs((value - mean) / std) DESC LIMIT 1")
def distribution_outliers(spark, sf_dir):
    return outliers.distribution_outliers(read(spark, sf_dir, "events"), ["value"]).select("column_name", *[F.round(c, 4).alias(c) for c in ("value", "mean", "std", "z_score")])


def _forecast_sql(table: str, date: str, measure: str) -> str:
    sides = ", ".join(f"round(intercept + slope * (n + {k} - 1), 2) AS {name}, round(intercept + slope * (n + {k} - 1) - 1.96 * dev * sqrt({k}), 2) AS {name}_low, round(intercept + slope * (n + {k} - 1) + 1.96 * dev * sqrt({k}), 2) AS {name}_high" for name, k in series.HORIZONS)
    return f"""
WITH m AS (SELECT date_trunc('month', {date}) AS period, sum({measure}) AS y FROM {table} WHERE {date} IS NOT NULL AND {measure} IS NOT NULL GROUP BY 1),
x AS (SELECT *, (row_number() OVER (ORDER BY period) - 1)::DOUBLE AS x FROM m),
f AS (SELECT count(*) AS n, arg_max(y, period) AS latest, avg(y) AS mean, regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept,
             sqrt(greatest((regr_syy(y, x) - regr_sxy(y, x) * regr_sxy(y, x) / regr_sxx(y, x)) / count(*), 0)) AS dev FROM x HAVING count(*) >= 3),
g AS (SELECT *, {sides} FROM f)
SELECT '{measure}' AS metric, n AS observations, round(latest, 2) AS latest_value, round(slope, 2) AS monthly_slope,
       {", ".join(f"{name}{end}" for name, _ in series.HORIZONS for end in ("", "_low", "_high"))},
       round(CASE WHEN latest <> 0 THEN (next_month - latest) / latest * 100 ELSE 0 END, 2) AS change_percent,
       round(0.45::DOUBLE + 0.45::DOUBLE * least(n / 12, 1) * greatest(0.2, 1 - CASE WHEN mean <> 0 THEN least(dev / abs(mean), 0.8) ELSE 0.8 END), 2) AS confidence
FROM g"""


@query(_forecast_sql("orders", "o_orderdate", "o_totalprice"))
def linear_forecast_orders(spark, sf_dir):
    return series.linear_forecast(read(spark, sf_dir, "orders"), "o_orderdate", "o_totalprice")


@query(_forecast_sql("lineitem", "l_shipdate", "l_quantity"))
def linear_forecast_lineitem(spark, sf_dir):
    return series.linear_forecast(read(spark, sf_dir, "lineitem"), "l_shipdate", "l_quantity")


@query("SELECT o_orderdate AS x, coalesce(round(avg(o_totalprice), 4), 0) AS o_totalprice FROM orders WHERE o_orderdate IS NOT NULL AND o_totalprice IS NOT NULL GROUP BY 1 ORDER BY 1 LIMIT 100")
def chart_line(spark, sf_dir):
    return charts.line_data(read(spark, sf_dir, "orders"), "o_orderdate", ["o_totalprice"], digits=4)


@query("SELECT l_shipdate AS x, coalesce(round(avg(l_quantity), 4), 0) AS l_quantity, coalesce(round(avg(l_extendedprice), 4), 0) AS l_extendedprice, coalesce(round(avg(l_tax), 4), 0) AS l_tax FROM lineitem WHERE l_shipdate IS NOT NULL GROUP BY 1 ORDER BY 1 LIMIT 100")
def chart_multi_line(spark, sf_dir):
    return charts.line_data(read(spark, sf_dir, "lineitem"), "l_shipdate", ["l_quantity", "l_extendedprice", "l_tax"], digits=4)


@query("SELECT o_orderpriority AS label, round(sum(o_totalprice), 2) AS value FROM orders WHERE o_orderpriority IS NOT NULL AND o_totalprice IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15")
def chart_bar(spark, sf_dir):
    return charts.bar_data(read(spark, sf_dir, "orders"), "o_orderpriority", "o_totalprice")


@query("SELECT event_type AS label, count(*) AS value FROM events WHERE event_type IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8")
def chart_donut(spark, sf_dir):
    return charts.donut_data(read(spark, sf_dir, "events"), "event_type")


@query("WITH v AS (SELECT l_extendedprice AS v FROM lineitem WHERE l_extendedprice IS NOT NULL), e AS (SELECT min(v) AS low, max(v) AS high, least(12, count(DISTINCT v)) AS n FROM v), w AS (SELECT low, n, (high - low) / n AS width FROM e), b AS (SELECT least(floor((v - low) / width), n - 1)::INTEGER AS bin, count(*) AS count FROM v, w GROUP BY 1) SELECT r::INTEGER AS bin, round(low + r * width, 4) AS bin_start, round(low + (r + 1) * width, 4) AS bin_end, coalesce(count, 0) AS count FROM w, range(12) AS t(r) LEFT JOIN b ON b.bin = r WHERE r < n")
def chart_histogram(spark, sf_dir):
    out = charts.histogram_data(read(spark, sf_dir, "lineitem"), "l_extendedprice")
    return out.select("bin", F.round("bin_start", 4).alias("bin_start"), F.round("bin_end", 4).alias("bin_end"), "count")


@query("SELECT p_size::DOUBLE AS x, p_retailprice::DOUBLE AS y FROM part WHERE p_size IS NOT NULL AND p_retailprice IS NOT NULL ORDER BY p_partkey, p_size, p_retailprice LIMIT 500")
def chart_scatter(spark, sf_dir):
    return charts.scatter_data(read(spark, sf_dir, "part"), "p_size", "p_retailprice", "p_partkey")


@query("WITH a AS (SELECT n_name, count(*) AS customers, sum(c_acctbal) AS c_acctbal FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1), b AS (SELECT n_name, sum(s_acctbal) AS s_acctbal FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1) SELECT n_name, round(coalesce(c_acctbal, 0), 2) AS c_acctbal, round(coalesce(s_acctbal, 0), 2) AS s_acctbal FROM a FULL JOIN b USING (n_name)")
def sheet_full_join(spark, sf_dir):
    nation = read(spark, sf_dir, "nation")
    a = read(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("n_name", "c_acctbal")
    b = read(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select("n_name", "s_acctbal")
    out = combine.combine_sheets({"Customers": a, "Suppliers": b})
    return out.select("n_name", F.round("c_acctbal", 2).alias("c_acctbal"), F.round("s_acctbal", 2).alias("s_acctbal"))


@query("WITH a AS (SELECT o_custkey AS custkey, sum(o_totalprice) AS amount, arg_min(o_orderpriority, o_orderkey) AS note FROM orders GROUP BY 1), b AS (SELECT c_custkey AS custkey, sum(c_acctbal) AS amount, arg_min(c_mktsegment, c_custkey) AS note FROM customer GROUP BY 1) SELECT custkey, round(a.amount, 2) AS amount, a.note AS note, round(b.amount, 2) AS amount_related, b.note AS note_related FROM a FULL JOIN b USING (custkey)")
def file_full_join(spark, sf_dir):
    a = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("custkey"), F.col("o_totalprice").alias("amount"), F.col("o_orderpriority").alias("note"), F.col("o_orderkey").alias("row"))
    b = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("custkey"), F.col("c_acctbal").alias("amount"), F.col("c_mktsegment").alias("note"), F.col("c_custkey").alias("row"))
    out = combine.full_join([a, b], ["custkey"], order_by="row")
    return out.select("custkey", F.round("amount", 2).alias("amount"), "note", F.round("amount related 2", 2).alias("amount_related"), F.col("note related 2").alias("note_related"))


@query("SELECT c_custkey AS key, c_name AS name, c_acctbal AS balance, c_mktsegment AS segment, 'customer' AS source_file FROM customer UNION ALL SELECT s_suppkey, s_name, s_acctbal, NULL, 'supplier' FROM supplier")
def diagonal_union(spark, sf_dir):
    a = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    b = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    return combine.combine_files({"customer": a, "supplier": b}).withColumnRenamed(combine.SOURCE, "source_file")


@query("SELECT DISTINCT o_orderstatus, o_orderpriority, date_trunc('month', o_orderdate)::TIMESTAMP AS month FROM orders")
def exact_distinct(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").select("o_orderstatus", "o_orderpriority", F.date_trunc("month", "o_orderdate").cast("timestamp_ntz").alias("month"))
    return dedup.exact_distinct(rows)


@query("SELECT lang, source, min(doc_id) AS doc_id, arg_min(n_chars, doc_id) AS n_chars FROM documents GROUP BY 1, 2")
def keep_first_by_key(spark, sf_dir):
    return dedup.first_by_key(read(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang", "source"), ["lang", "source"], "doc_id")


@query("SELECT conv_id, turn, CASE WHEN lower(t) NOT IN ('', '-', '--', 'n/a', 'na', 'nan', 'none', 'null', 'nil', 'unknown', 'missing', '#n/a', '#na') THEN t END AS text FROM (SELECT conv_id, turn, trim(regexp_replace(CASE WHEN turn % 5 = 0 THEN ' N/A ' WHEN turn % 5 = 1 THEN 'unknown' ELSE '  ' || role || chr(9) || ' ' || text || ' ' END, '\\s+', ' ', 'g')) AS t FROM conversations)")
def clean_text_missing(spark, sf_dir):
    cell = F.when(F.col("turn") % 5 == 0, " N/A ").when(F.col("turn") % 5 == 1, "unknown").otherwise(F.concat(F.lit("  "), "role", F.lit("\t "), "text", F.lit(" ")))
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", T.without_missing(cell).alias("text"))


_SHOWN = "CASE o_orderkey % 6 WHEN 0 THEN '$' || n || '.50' WHEN 1 THEN '(' || n || ')' WHEN 2 THEN n || 'k' WHEN 3 THEN 'USD ' || n || '.25 m' WHEN 4 THEN n || '%' ELSE 'order #' || n END"


@query(f"WITH t AS (SELECT o_orderkey, lower({_SHOWN}) AS s FROM (SELECT o_orderkey, floor(o_totalprice)::BIGINT::VARCHAR AS n FROM orders)), u AS (SELECT o_orderkey, s, regexp_extract(replace(regexp_replace(s, '[^0-9.]', '', 'g'), ' ', ''), '[0-9]*\\.?[0-9]+')::DOUBLE * CASE WHEN s LIKE '%k' THEN 1e3 WHEN s LIKE '% m' THEN 1e6 ELSE 1 END AS v FROM t) SELECT o_orderkey, CASE WHEN s LIKE '(%' THEN -v ELSE v END AS number, s LIKE '%$%' OR s LIKE 'usd%' AS currency FROM u")
def parse_number_text(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").select("o_orderkey", F.floor("o_totalprice").cast("long").cast("string").alias("n"))
    rows = rows.withColumn("s", F.expr(_SHOWN))
    return rows.select("o_orderkey", T.number_in(F.col("s")).alias("number"), T.shows_currency(F.col("s")).alias("currency"))


@query("SELECT o_orderkey, o_orderdate::TIMESTAMP AS moment FROM orders")
def normalize_dates(spark, sf_dir):
    """Dates written in five forms and read back."""
    forms = ("yyyy-MM-dd'T'HH:mm:ss'Z'", "dd MMM yyyy HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy/MM/dd HH:mm:ss")
    d = F.col("o_orderdate")
    shown = F.when(F.col("o_orderkey") % 4 == 0, F.date_format(d, forms[0]))
    shown = shown.when(F.col("o_orderkey") % 4 == 1, F.date_format(d, forms[2])).when(F.col("o_orderkey") % 4 == 2, F.date_format(d, forms[3])).otherwise(F.date_format(d, "M/d/yyyy H:m:s"))
    return read(spark, sf_dir, "orders").select("o_orderkey", T.moment_in(shown, day_first=False).cast("timestamp_ntz").alias("moment"))


_HOLED = "SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS price, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderpriority END AS priority FROM orders"


def _holed(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice")).alias("price"), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderpriority")).alias("priority"), "o_orderdate")


@query(f"WITH t AS ({_HOLED}) SELECT o_orderkey, round(coalesce(price, (SELECT median(price) FROM t)), 4) AS price, coalesce(priority, 'Unknown') AS priority FROM t")
def impute_median(spark, sf_dir):
    out, _ = missing.fill_missing(_holed(spark, sf_dir).drop("o_orderdate"))
    return out.withColumn("price", F.round("price", 4))


@query(f"WITH t AS (SELECT *, row_number() OVER (ORDER BY o_orderkey) AS r FROM ({_HOLED})), u AS (SELECT *, max(CASE WHEN price IS NOT NULL THEN r END) OVER (ORDER BY r) AS pr, min(CASE WHEN price IS NOT NULL THEN r END) OVER (ORDER BY r DESC) AS nr FROM t) SELECT u.o_orderkey, round(coalesce(u.price, p.price + (n.price - p.price) * ((u.r - u.pr) / (u.nr - u.pr)), p.price, (SELECT median(price) FROM t)), 4) AS price, coalesce(u.priority, 'Unknown') AS priority FROM u LEFT JOIN t p ON p.r = u.pr LEFT JOIN t n ON n.r = u.nr")
def impute_interpolate(spark, sf_dir):
    out, _ = missing.fill_missing(_holed(spark, sf_dir), order_by=["o_orderkey"])
    return out.select("o_orderkey", F.round("price", 4).alias("price"), "priority")


@query(ORACLE_SQL["impute_interpolate"])
def impute_in_file_order(spark, sf_dir):
    """Files of very different sizes, written in the order of the keys: filling follows paths and rows, no column."""
    path = shared_path(spark)
    edges = _holed(spark, sf_dir).groupBy((F.col("o_orderkey") / 100).cast("long").alias("k")).count().select("k", F.expr("CAST(9 * pow(percent_rank() OVER (ORDER BY k), 3) AS INT)").alias("part"))
    rows = _holed(spark, sf_dir).join(edges, (F.col("o_orderkey") / 100).cast("long") == F.col("k")).drop("k")
    rows.repartitionByRange("part", "o_orderkey").sortWithinPartitions("part", "o_orderkey").write.partitionBy("part").parquet(path)
    out, _ = cleaning.clean(spark.read.parquet(path).drop("part"), cleaning.CleaningOptions(remove_duplicates=False, semantic_categorical_merging=False, standardize_columns=False, normalize_dates=False, parse_currency_percent=False))
    return out.select("o_orderkey", F.round("price", 4).alias("price"), "priority")


_EVENTS_SQL = "SELECT event_id, event_type, round(value, 6) AS value, props FROM events"


@query(_EVENTS_SQL)
def json_lines(spark, sf_dir):
    """Written as an object a line; one column holds JSON text itself."""
    path = shared_path(spark)
    read(spark, sf_dir, "events").select("event_id", "event_type", "value", "props").write.json(path)
    return readers.read_dataset(spark, path, "json")[0].select("event_id", "event_type", F.round("value", 6).alias("value"), "props")


@query(_EVENTS_SQL)
def json_objects(spark, sf_dir):
    """Written as objects over several lines, one after the other, and cut by quotes and depths."""
    path = shared_path(spark)
    rows = read(spark, sf_dir, "events").select("event_id", "event_type", "value", "props")
    rows.select(F.to_json(F.struct("*"), {"pretty": "true"}).alias("value")).write.text(path)
    return readers.read_dataset(spark, path, "json")[0].select("event_id", "event_type", F.round("value", 6).alias("value"), "props")


@query("SELECT doc_id, lang, source, md5(regexp_replace(text, '[\\x09-\\x0D\\x20]+', '', 'g')) AS letters FROM documents")
def delimited_folder(spark, sf_dir):
    """Whole texts with line breaks and quotes through the CSV sink and back; every part has its header."""
    path = shared_path(spark)
    readers.write_outputs(read(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text").repartition(8, "doc_id"), csv_path=path)
    back, _ = readers.read_dataset(spark, path, "csv", **readers.WRITTEN_CSV)
    letters = F.regexp_replace("text", r"[\x09-\x0D\x20]+", "")
    return back.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "source", F.md5(letters.cast("binary")).alias("letters"))


@query("SELECT 'nation ' || s_nationkey AS book, 'Balances' AS sheet, s_name AS name, s_acctbal AS amount, s_acctbal < 0 AS flag FROM supplier UNION ALL SELECT 'nation ' || s_nationkey, 'Keys & <Names>', s_name, s_suppkey::DOUBLE, NULL FROM supplier")
def workbook_rows(spark, sf_dir):
    """Suppliers as a workbook a nation, with two sheets each, cut in small pieces and read back."""

    def books(rows):
        first = [["Name", "Amount", "Flag"], *[[n, float(a), bool(a < 0)] for n, a in zip(rows["s_name"], rows["s_acctbal"], strict=True)]]
        second = [["Name", "Key"], *[[n, int(k)] for n, k in zip(rows["s_name"], rows["s_suppkey"], strict=True)]]
        return pd.DataFrame({"path": [f"nation {rows['s_nationkey'].iloc[0]}"], "content": [xlsx.workbook_bytes({"Balances": first, "Keys & <Names>": second})]})

    cells = xlsx.workbook_cells(read(spark, sf_dir, "supplier").groupBy("s_nationkey").applyInPandas(books, "path string, content binary"), 4096)
    rows = cells.filter("row > 0").select(F.col("file").alias("book"), "sheet", F.get("cells", F.lit(0)).alias("name"), F.get("cells", F.lit(1)).cast("double").alias("amount"), F.get("cells", F.lit(2)).cast("boolean").alias("flag"))
    return rows


_FENCES = "r AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS i, count(*) OVER () AS n FROM events WHERE value IS NOT NULL), q AS (SELECT max(value) FILTER (i = round_even((n - 1) * 0.01::DOUBLE, 0)) AS p01, max(value) FILTER (i = round_even((n - 1) * 0.25::DOUBLE, 0)) AS q1, max(value) FILTER (i = round_even((n - 1) * 0.75::DOUBLE, 0)) AS q3, max(value) FILTER (i = round_even((n - 1) * 0.99::DOUBLE, 0)) AS p99 FROM r), f AS (SELECT q1 - 1.5 * (q3 - q1) AS low, q3 + 1.5 * (q3 - q1) AS high, greatest(p01, q1 - 1.5 * (q3 - q1)) AS least_v, least(p99, q3 + 1.5 * (q3 - q1)) AS most_v FROM q)"


@query(f"WITH {_FENCES} SELECT event_id, round(CASE WHEN value < low THEN least_v WHEN value > high THEN most_v ELSE value END, 6) AS value FROM events, f")
def cap_outliers(spark, sf_dir):
    out, _ = outliers.cap_outliers(read(spark, sf_dir, "events").select("event_id", "value"))
    return out.withColumn("value", F.round("value", 6))


@query(f"WITH {_FENCES} SELECT event_id, value FROM events, f WHERE value IS NULL OR value BETWEEN low AND high")
def exclude_outliers(spark, sf_dir):
    return outliers.exclude_outliers(read(spark, sf_dir, "events").select("event_id", "value"))


_SPELLED = "CASE c_custkey % 6 WHEN 0 THEN 'USA' WHEN 1 THEN 'U.S.A.' WHEN 2 THEN 'us' WHEN 3 THEN 'Great Britain' WHEN 4 THEN 'Canada' ELSE 'canada' END"


@query(f"SELECT c_custkey, CASE WHEN c_custkey % 6 <= 2 THEN 'United States' WHEN c_custkey % 6 = 3 THEN 'Great Britain' ELSE (SELECT CASE WHEN count(*) FILTER (c_custkey % 6 = 4) >= count(*) FILTER (c_custkey % 6 = 5) THEN 'Canada' ELSE 'canada' END FROM customer) END AS country FROM customer")
def canonical_categories(spark, sf_dir):
    out, _ = categories.canonical_categories(read(spark, sf_dir, "customer").select("c_custkey", F.expr(_SPELLED).alias("country")))
    return out


@query()
def fuzzy_distinct(spark, sf_dir):
    rows = read(spark, sf_dir, "nation").crossJoin(F.broadcast(spark.range(4).toDF("k"))).select("n_regionkey", F.concat("n_name", F.lit(" trading company"), F.expr("repeat('s', int(k % 2))")).alias("name"))
    return dedup.fuzzy_distinct(rows, order_by=["name", "n_regionkey"])


@query("SELECT l_linestatus AS label, count(*) AS row_count, round(avg(l_quantity), 4) AS avg_for, round(sum(l_quantity), 2) AS total_for, round(avg(l_linenumber), 4) AS avg_against, round(sum(l_linenumber), 2)::DOUBLE AS total_against, round(avg(l_quantity - l_linenumber), 4) AS avg_difference, sum((l_returnflag = 'A')::INTEGER)::BIGINT AS wins, count(*) FILTER (l_returnflag = 'N') AS draws, count(*) FILTER (l_returnflag = 'R') AS losses, round(avg((l_returnflag = 'A')::INTEGER) * 100, 4) AS win_rate FROM lineitem WHERE l_linestatus IS NOT NULL GROUP BY 1 ORDER BY win_rate DESC, avg_difference DESC, row_count DESC, label LIMIT 10")
def team_style_ranking(spark, sf_dir):
    return ranking.performance(read(spark, sf_dir, "lineitem"), "l_linestatus", "l_quantity", "l_linenumber", "l_returnflag", ("a",), ("n",), ("r",))


@query("SELECT c_mktsegment AS label, round(sum(c_acctbal), 2) AS total FROM customer WHERE c_mktsegment IS NOT NULL GROUP BY 1 ORDER BY 2 DESC NULLS LAST, 1 LIMIT 5")
def top_groups(spark, sf_dir):
    return ranking.top_groups(read(spark, sf_dir, "customer"), "c_mktsegment", "c_acctbal").withColumn("total", F.round("total", 2))


_NEWEST = "SELECT conv_id, turn, role FROM conversations ORDER BY conv_id DESC, turn, role"


@query(f"{_NEWEST} OFFSET 50 LIMIT 25")
def page_after_key(spark, sf_dir):
    """The third page of 25 rows, each found by the last row of the one before."""
    rows, after = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), None
    for _ in range(2):
        after = store.page_after(rows, "conv_id", ["turn", "role"], after, 25).collect()[-1].asDict()
    return store.page_after(rows, "conv_id", ["turn", "role"], after, 25)


@query("SELECT o_orderstatus AS analysis_id, o_orderpriority AS priority, count(*) AS orders FROM orders GROUP BY ALL")
def stored_results(spark, sf_dir):
    """Results by analysis, of which one was first stored wrong and is replaced by its rerun."""
    path = shared_path(spark)
    rows = read(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("analysis_id"), F.col("o_orderpriority").alias("priority")).agg(F.count(F.lit(1)).alias("orders"))
    store.write_results(rows.withColumn("orders", F.expr("if(analysis_id = 'F', -1, orders)")), path)
    store.write_results(rows.filter("analysis_id = 'F'"), path)
    return spark.read.parquet(path).select("analysis_id", "priority", "orders")


@query("SELECT conv_id, turn, role, (SELECT count(*) FROM conversations WHERE text ILIKE '%the%' AND role IN ('user', 'assistant')) AS total_count FROM conversations WHERE text ILIKE '%the%' AND role IN ('user', 'assistant') ORDER BY conv_id DESC, turn, role OFFSET 20 LIMIT 20")
def metadata_page(spark, sf_dir):
    rows = store.filtered(read(spark, sf_dir, "conversations"), search={"text": "the"}, among={"role": ["user", "assistant"]}).select("conv_id", "turn", "role")
    return store.page(rows, "conv_id", ["turn", "role"], number=2)


@query("SELECT count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS completed, count(*) FILTER (o_orderstatus IN ('O', 'P')) AS active, coalesce(sum(o_orderkey), 0)::BIGINT AS row_sum FROM orders")
def metadata_roll_up(spark, sf_dir):
    return store.roll_up(read(spark, sf_dir, "orders"), "o_orderstatus", "o_orderkey", "F", ["O", "P"])


@query("SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 10")
def last_turns(spark, sf_dir):
    return store.last_turns(read(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), "conv_id", "turn")


@query("SELECT vec_id, round(list_dot_product(embedding::DOUBLE[], c) / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_dot_product(c, c))), 6) AS similarity FROM embeddings, (SELECT embedding::DOUBLE[] AS c FROM embeddings ORDER BY vec_id LIMIT 1)")
def cosine_to_first(spark, sf_dir):
    vectors = read(spark, sf_dir, "embeddings")
    first = F.broadcast(vectors.orderBy("vec_id").limit(1).select(F.col("embedding").alias("c"), F.lit(1).alias("k")))
    return vectors.withColumn("k", F.lit(1)).join(first, "k").select("vec_id", F.round(T.cosine(F.col("embedding"), F.col("c")), 6).alias("similarity"))


@query("SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1)::BIGINT AS row_number FROM orders")
def row_numbers(spark, sf_dir):
    out = ordered.with_row_number(read(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"])
    return out.select("o_orderkey", F.col(ordered.ROW).alias("row_number"))


@query("SELECT 'l_extendedprice' AS column_name, 'revenue' AS kpi_type, round(sum(l_extendedprice), 2) AS value, true AS is_total, true AS is_currency FROM lineitem UNION ALL SELECT 'l_quantity', 'orders', round(sum(l_quantity), 2), true, false FROM lineitem")
def kpi_detection(spark, sf_dir):
    columns, _ = analysis.describe(read(spark, sf_dir, "lineitem"))
    rows = [(k["column"], k["kpi_type"], float(k["value"]), k["is_total"], k["is_currency"]) for k in detect_kpis(columns)]
    return spark.createDataFrame(rows, "column_name string, kpi_type string, value double, is_total boolean, is_currency boolean").withColumn("value", F.round("value", 2))


@query("SELECT * FROM (VALUES ('o_orderkey', 'numeric_metric', 'metric'), ('o_custkey', 'numeric_metric', 'metric'), ('o_orderstatus', 'categorical_dimension', 'dimension'), ('o_totalprice', 'currency', 'metric'), ('o_orderdate', 'date', 'temporal_dimension'), ('o_orderpriority', 'categorical_dimension', 'dimension')) AS t(column_name, meaning, role)")
def column_semantics(spark, sf_dir):
    columns, _ = analysis.describe(read(spark, sf_dir, "orders"))
    return spark.createDataFrame([(c.name, c.meaning, c.role) for c in columns], "column_name string, meaning string, role string")


@query()
def relationship_suggestions(spark, sf_dir):
    files = {t: [r.asDict() for r in profile.frame_profile(read(spark, sf_dir, t)).collect()] for t in ("labels", "documents", "conversations")}
    rows = [(s["type"], s["confidence"], s["columns"], s["files"]) for s in related(files)]
    return spark.createDataFrame(rows, "type string, confidence double, columns array<string>, files array<string>")


CUSTOMER_TYPES = {"c_custkey": "bigint", "c_name": "string", "c_nationkey": "int", "c_acctbal": "double", "c_mktsegment": "string"}


@query("\nUNION ALL\n".join(f"SELECT '{c}' AS column_name, '{t}' AS dtype, count({c}) AS non_null_count, count(*) - count({c}) AS null_count, count(DISTINCT {c}) + (count(*) > count({c}))::INTEGER AS unique_count, (SELECT string_agg(v, '|' ORDER BY n) FROM (SELECT {c}::VARCHAR AS v, row_number() OVER () AS n FROM customer WHERE {c} IS NOT NULL LIMIT 5)) AS samples FROM customer" for c, t in CUSTOMER_TYPES.items()))
def frame_profile(spark, sf_dir):
    return profile.frame_profile(read(spark, sf_dir, "customer")).withColumn("samples", F.array_join("sample_values", "|")).drop("sample_values")


@query()
def insight_rows(spark, sf_dir):
    return analysis.insight_rows(spark, analysis.analyze(read(spark, sf_dir, "orders"), "orders"))


@query("SELECT o_orderkey::DOUBLE AS order_number, round(o_totalprice, 2) AS total_price, CASE WHEN o_orderkey % 5 = 0 THEN 'Unknown' ELSE o_orderstatus END AS status, o_orderdate::DATE AS order_date FROM orders")
def clean_pipeline(spark, sf_dir):
    """Orders written as texts with currency signs, missing tokens and padded names, cleaned back."""
    d = read(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderkey") % 5 == 0, "n/a").otherwise(F.concat(F.lit("  "), "o_orderstatus", F.lit(" ")))
    raw = d.select(F.col("o_orderkey").cast("string").alias("Order Number"), F.concat(F.lit("$"), F.format_number("o_totalprice", 2)).alias("Total Price"), status.alias("Status"), F.date_format("o_orderdate", "dd MMM yyyy").alias("Order Date"))
    out, _ = cleaning.clean(raw, cleaning.CleaningOptions(semantic_categorical_merging=False))
    return out.withColumn("total_price", F.round("total_price", 2))


@query("SELECT o_orderkey, o_orderdate, o_totalprice FROM orders WHERE o_totalprice IS NOT NULL AND o_orderpriority IN ('1-URGENT', '2-HIGH') AND lower(o_orderstatus) LIKE '%f%'")
def filters(spark, sf_dir):
    return store.filtered(read(spark, sf_dir, "orders"), search={"o_orderstatus": "f"}, among={"o_orderpriority": ["1-URGENT", "2-HIGH"]}).filter("o_totalprice IS NOT NULL").select("o_orderkey", "o_orderdate", "o_totalprice")


@query("SELECT r_regionkey::DOUBLE AS \"Region Id\", r_name AS \"Region Name\" FROM region")
def promoted_header(spark, sf_dir):
    """A grid of texts with a title row and an empty one above the header."""
    region = read(spark, sf_dir, "region").select((F.col("r_regionkey") + 10).cast("long").alias("row"), F.col("r_regionkey").cast("string").alias("column_1"), F.col("r_name").alias("column_2"))
    above = spark.createDataFrame([(0, "Report of regions", None), (1, None, None), (2, "Region  Id", "Region Name")], "row long, column_1 string, column_2 string")
    return grid.cast_numeric_like(grid.promote_header(above.union(region), "row"))


@query("SELECT c_name AS customer_name, c_acctbal AS acct_bal_currency, c_mktsegment AS market_and_segment, c_custkey AS column_4, c_nationkey AS column_4_2 FROM customer")
def standard_column_names(spark, sf_dir):
    d = read(spark, sf_dir, "customer").select("c_name", "c_acctbal", "c_mktsegment", "c_custkey", "c_nationkey")
    return d.toDF(*names.standard_names([" Customer  Name", "Acct.Bal $", "Market&Segment", "??", "column 4"]))


@query("SELECT 'orders' AS table_name, count(*) - count(o_orderdate) AS missing_dates, count(*) FILTER (o_totalprice < 0) AS negative, count(DISTINCT o_custkey) AS customers FROM orders")
def counted_conditions(spark, sf_dir):
    return read(spark, sf_dir, "orders").agg(F.lit("orders").alias("table_name"), F.count_if(F.col("o_orderdate").isNull()).alias("missing_dates"), F.count_if(F.col("o_totalprice") < 0).alias("negative"), F.count_distinct("o_custkey").alias("customers"))


@query("SELECT c_mktsegment AS label, round(sum(c_acctbal), 2) AS total FROM customer GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
def ask_ranking(spark, sf_dir):
    d = read(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("market_segment"), F.col("c_acctbal").alias("account_balance"))
    return analysis.ask(d, "Which are the top market segments by account balance?").withColumn("total", F.round("total", 2))


_MATCHES = "SELECT s_nationkey % 5 AS n, l_linenumber AS goals_team, l_linenumber % 4 AS goals_opponent, l_returnflag AS f FROM lineitem JOIN supplier ON l_suppkey = s_suppkey"


def _matches(spark, sf_dir) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    result = F.when(F.col("l_returnflag") == "A", "Home win").when(F.col("l_returnflag") == "N", "Drawn").otherwise("lost")
    return rows.select(F.format_string("Team %d", (F.col("s_nationkey") % 5).cast("int")).alias("Club Name"), F.col("l_linenumber").alias("Goals Team"), (F.col("l_linenumber") % 4).alias("Goals Opponent"), result.alias("Match Result"))


@query(f"SELECT 'Team ' || n AS label, count(*) AS row_count, round(avg(goals_team - goals_opponent), 4) AS avg_difference, count(*) FILTER (f = 'A') AS wins, count(*) FILTER (f = 'N') AS draws, count(*) FILTER (f = 'R') AS losses, round(avg((f = 'A')::INTEGER) * 100, 4) AS win_rate FROM ({_MATCHES}) GROUP BY n ORDER BY win_rate DESC, avg_difference DESC, row_count DESC, label LIMIT 10")
def ask_win_rate(spark, sf_dir):
    found = analysis.ask(_matches(spark, sf_dir), "What is the win rate by team?")
    return found.select("label", "row_count", "avg_difference", "wins", "draws", "losses", "win_rate")


@query(f"SELECT 'Team ' || n AS label, round(avg(goals_team - goals_opponent), 4) AS avg_difference, count(*) AS row_count FROM ({_MATCHES}) GROUP BY n ORDER BY 2 DESC, 3 DESC, 1 LIMIT 10")
def ask_performance(spark, sf_dir):
    """Without a column of results the mean difference ranks."""
    return analysis.ask(_matches(spark, sf_dir).drop("Match Result"), "Which team performed best?").select("label", "avg_difference", "row_count")


@query(f"SELECT 'Team ' || n AS label, sum(goals_team)::DOUBLE AS total FROM ({_MATCHES}) GROUP BY n ORDER BY 2 DESC, 1 LIMIT 5")
def ask_goals(spark, sf_dir):
    return analysis.ask(_matches(spark, sf_dir), "Show the top clubs by goals scored")


@query("SELECT c_mktsegment AS label, round(sum(c_acctbal), 2) AS total FROM customer GROUP BY 1 ORDER BY 2, 1 LIMIT 5")
def ask_lowest(spark, sf_dir):
    d = read(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("market_segment"), F.col("c_acctbal").alias("account_balance"))
    return analysis.ask(d, "lowest market segments by account balance").withColumn("total", F.round("total", 2))


_ODD_MEASURES = ["o_orderkey", "o_custkey", "o_totalprice"]
_ODD_SQL = (
    "WITH s AS (" + _each(_ODD_MEASURES, "SELECT '{c}' AS column_name, date_trunc('month', o_orderdate) AS p, sum({c})::DOUBLE AS v FROM orders WHERE o_orderdate IS NOT NULL AND {c} IS NOT NULL GROUP BY 2") + "), "
    "z AS (SELECT column_name, p, v, avg(v) OVER w AS mean, stddev_samp(v) OVER w AS dev FROM s WINDOW w AS (PARTITION BY column_name)), "
    "months AS (SELECT *, abs((v - mean) / dev) AS score, row_number() OVER (PARTITION BY column_name ORDER BY abs((v - mean) / dev) DESC, p) AS place FROM z WHERE dev > 0 AND abs((v - mean) / dev) >= 2.5), "
    "d AS (" + _each(_ODD_MEASURES, "SELECT '{c}' AS column_name, avg({c}::DOUBLE) AS mean, stddev_samp({c}::DOUBLE) AS dev, min({c})::DOUBLE AS low, max({c})::DOUBLE AS high FROM orders") + "), "
    "far AS (SELECT *, CASE WHEN high - mean >= mean - low THEN high ELSE low END AS v FROM d WHERE dev > 0), "
    "every AS (SELECT 'monthly' AS type, column_name, v, mean, score FROM months WHERE place <= 2 UNION ALL SELECT 'distribution', column_name, v, mean, abs((v - mean) / dev) FROM far WHERE abs((v - mean) / dev) >= 3) "
    "SELECT type, column_name, round(v, 2) AS value, round(mean, 2) AS expected, round(score, 4) AS score FROM every ORDER BY every.score DESC LIMIT 8"
)


@query(_ODD_SQL)
def anomaly_report(spark, sf_dir):
    d = read(spark, sf_dir, "orders")
    rows = [(a["type"], a["column"], float(a["value"]), float(a["expected"]), float(a["score"])) for a in analysis.anomalies(d, analysis.describe(d)[0])]
    found = spark.createDataFrame(rows, "type string, column_name string, value double, expected double, score double")
    return found.select("type", "column_name", F.round("value", 2).alias("value"), F.round("expected", 2).alias("expected"), F.round("score", 4).alias("score"))


@query()
def chart_plan(spark, sf_dir):
    columns, facts = analysis.describe(read(spark, sf_dir, "lineitem"))
    return spark.createDataFrame([(c["id"], c["type"], c["x"], c["measures"]) for c in select_charts(columns, facts["correlations"])], "id string, type string, x string, measures array<string>")


@query()
def recommendation_report(spark, sf_dir):
    found = analysis.analyze(read(spark, sf_dir, "orders"), "orders")["recommendations"]
    return spark.createDataFrame([(r["title"], r["problem"], r["evidence"], r["importance"], float(r["confidence"])) for r in found], "title string, problem string, evidence string, importance string, confidence double")
