import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from gristmill.functions import text
from gristmill.operators import categories, dedup, missing, ordered, outliers
from gristmill.plans.clean import CleaningOptions, clean, normalize_dates, parse_numbers

PLAIN = dict(remove_duplicates=False, semantic_categorical_merging=False)


def test_impute_and_drop(spark):
    df = spark.createDataFrame([(10.0, 1.0, "North"), (None, 3.0, None), (None, None, "East"), (30.0, None, None)], "`Total Sales` double, Profit double, Region string")
    out, report = clean(df, CleaningOptions(**PLAIN))
    rows = out.orderBy("total_sales", "profit").collect()
    assert out.columns == ["total_sales", "profit", "region"] and len(rows) == 3
    assert all(v is not None for r in rows for v in r)
    assert sorted(r.region for r in rows) == ["North", "Unknown", "Unknown"]
    assert report["rows_before"] == 4 and report["rows_after"] == 3


def test_whitespace(spark):
    df = spark.createDataFrame([("  North\t America ",), ("Europe\n\nWest",), ("Asia  Pacific",)], "Region string")
    out, _ = clean(df, CleaningOptions(missing_data_strategy="none", **PLAIN))
    assert sorted(r.region for r in out.collect()) == ["Asia Pacific", "Europe West", "North America"]


def test_fuzzy_keeps_equal_names_with_other_measures(spark):
    df = spark.createDataFrame([("Blue Heron Shipping", 7.5), ("BLUE HERON shipping!", 7.5), ("Blue Heron Shipping", 8.5), ("Blue Heron Shippign", 7.5), ("", 7.5), (None, 7.5)], "Shipper string, Weight double")
    out = dedup.fuzzy_distinct(df)
    assert sorted(str((r.Shipper or "-", r.Weight)) for r in out.collect()) == ["('-', 7.5)", "('-', 7.5)", "('Blue Heron Shipping', 7.5)", "('Blue Heron Shipping', 8.5)"]


def test_fuzzy_over_many_rows_matches_plain_comparison(spark):
    """6,000 rows: the same rows stay as by comparing each with all kept ones before it."""
    r = random.Random(4)
    names = ["".join(r.choice("abcdefghij ") for _ in range(r.choice([3, 12, 30, 60]))).strip() or "x" for _ in range(300)]
    rows = []
    for k in range(6000):
        name = list(r.choice(names))
        for _ in range(r.choice([0, 0, 0, 1, 1, 2])):
            name[r.randrange(len(name))] = r.choice("abcxyz")
        rows.append((k, "".join(name), r.randrange(4)))
    df = spark.createDataFrame(rows, "row_id long, name string, size int")
    got = {(x.name, x["size"]) for x in dedup.fuzzy_distinct(df.select("name", "size"), order_by=["name", "size"]).collect()}
    kept: dict = {}
    for _, name, size in sorted(rows, key=lambda x: (x[1], x[2])):
        text = re.sub("[^a-z0-9]+", " ", name.lower()).strip()
        if not text:
            continue
        block = kept.setdefault(size, {})
        if text not in block and not any(dedup._ratio(text, k, 0.94) for k in block):
            block[text] = name
    want = {(re.sub("[^a-z0-9]+", " ", n.lower()).strip(), s) for s, block in kept.items() for n in block.values()}
    assert {(re.sub("[^a-z0-9]+", " ", n.lower()).strip(), s) for n, s in got if n.strip()} == want and len(want) > 300


def test_mixed_dates(spark):
    df = spark.createDataFrame([("2025-01-31", 1), ("31/01/2025", 2), ("02-15-2025", 3), ("15 Feb 2025", 4)], "event_date string, value int")
    out, report = normalize_dates(df)
    assert dict(out.dtypes)["event_date"] == "date" and report[0]["standard"] == "YYYY-MM-DD"
    assert [r.event_date for r in out.orderBy("value").collect()] == [dt.date(2025, 1, 31)] * 2 + [dt.date(2025, 2, 15)] * 2


MOMENTS = {
    "2025-01-31T10:00:00+0200": "2025-01-31 08:00:00", "2025-01-31T10:00:00-05:30": "2025-01-31 15:30:00", "2025-01-31T10:00:00.250Z": "2025-01-31 10:00:00.25", "2025-01-31 10:00:00.5": "2025-01-31 10:00:00.5",
    "2025-1-3": "2025-01-03", "2025/01/31 7:05": "2025-01-31 07:05:00", "2025.01.31": "2025-01-31", "2025-02": "2025-02-01", "20250131": "2025-01-31", "20250131T101500Z": "2025-01-31 10:15:00", "2024-02-29": "2024-02-29",
    "Jan 31st 2025": "2025-01-31", "January 31, 2025": "2025-01-31", "31 January 2025 10:30": "2025-01-31 10:30:00", "31-Jan-2025": "2025-01-31", "Fri, 31 Jan 2025 10:30:15 GMT": "2025-01-31 10:30:15", "Friday, January 31, 2025 at 3:04 pm": "2025-01-31 15:04:00",
    "3rd of Sept. 2024": "2024-09-03", "2025 Feb 3": "2025-02-03", "Feb 2025": "2025-02-01", "5 May 99": "1999-05-05", "1/31/2025 3:04 PM": "2025-01-31 15:04:00", "1/31/2025 12:00 a.m.": "2025-01-31", "31-01-2025 10:00": "2025-01-31 10:00:00",
    "2/3/2025": "2025-02-03", "31.12.24": "2024-12-31", "12/31/68": "2068-12-31", "  31/01/2025\t23:59:59 UTC+1 ": "2025-01-31 22:59:59", "2025-01-31 10am": "2025-01-31 10:00:00", "1/2/2025 0:5:9": "2025-01-02 00:05:09", "2025-01-31 1005": "2025-01-31 10:05:00",
}
NO_MOMENTS = ["2025-13-01", "31/31/2025", "2023-02-29", "2025-01-31 25:00", "2025-01-31 13:00 pm", "hello", "12", "1/2/345", "Janus 3 2025", "31 Foo 2025", "n/a", "", "2025-01-31 10:61", "2025-01-31 100", "1234567", "20251301", "5\" pipe"]


def test_moments_in_many_forms(spark):
    rows = [(k, v) for k, v in MOMENTS.items()] + [(k, None) for k in [*NO_MOMENTS, None]]
    df = spark.createDataFrame(rows, "cell string, want string")
    wrong = df.withColumn("got", text.moment_in(F.col("cell"))).withColumn("want", F.col("want").cast("timestamp_ntz")).filter("NOT (got <=> want)").collect()
    assert wrong == []
    turned = spark.createDataFrame([("2/3/2025", "2025-03-02"), ("13/2/2025", "2025-02-13"), ("2/13/2025", "2025-02-13"), ("2025-02-03", "2025-02-03")], "cell string, want string")
    assert turned.filter(text.moment_in(F.col("cell"), day_first=True) != F.col("want").cast("timestamp_ntz")).count() == 0


def test_dates_come_before_numbers(spark):
    df = spark.createDataFrame([("2024-08-17", "1.5"), ("2024-08-24", "0.9")], "`Match Date` string, `Expected Goals` string")
    out, report = clean(df, CleaningOptions(**PLAIN))
    assert dict(out.dtypes) == {"match_date": "date", "expected_goals": "double"}
    assert [r["column"] for r in report["numbers"]] == ["expected_goals"]


def test_zoned_timestamps(spark):
    df = spark.createDataFrame([("2025-01-01T10:00:00+01:00",), ("2025-01-01T09:00:00Z",)], "created_at string")
    out, report = normalize_dates(df)
    assert {r.created_at for r in out.collect()} == {dt.datetime(2025, 1, 1, 9)} and report[0]["standard"] == "UTC datetime"


def test_cap_and_exclude(spark):
    df = spark.createDataFrame([(float(v), "r") for v in [*range(10, 19), 10000]], "revenue double, region string")
    out, known = outliers.cap_outliers(df)
    rows = [r.revenue for r in out.collect()]
    assert len(rows) == 10 and max(rows) < 10000 and sum(a != b for a, b in zip(sorted(rows), sorted([*range(10, 19), 10000]))) == 1
    assert outliers.exclude_outliers(df).count() == 9 and set(known) == {"revenue"}


def test_fences_use_the_nearest_rank(spark):
    df = spark.createDataFrame([(float(v),) for v in [1, 2, 3, 4, 5, 6, 7, 11]], "v double")
    low, high, _, _ = outliers.fences(df)["v"]
    assert (low, high) == (-1.5, 10.5) and outliers.exclude_outliers(df).count() == 7
    assert outliers.fences(df.limit(7)) == {}


def test_numbers_in_text(spark):
    df = spark.createDataFrame([("$15.00", "12.5%"), ("15€", "10 %"), ("USD 1.2k", "8.25%"), ("(£3,000)", "0%"), ("4,500", "100%")], "price string, conversion_rate string")
    out, report = parse_numbers(df)
    assert [r.price for r in out.collect()] == [15.0, 15.0, 1200.0, -3000.0, 4500.0]
    assert [r.conversion_rate for r in out.collect()] == [12.5, 10.0, 8.25, 0.0, 100.0]
    assert report[0]["detected_currency"] and report[1]["detected_percent"]
    labels = spark.createDataFrame([("Brand#12",), ("Brand#7",)], "brand string")
    assert [r.brand for r in parse_numbers(labels)[0].collect()] == [12.0, 7.0]
    assert [r.brand for r in parse_numbers(labels, strict=True)[0].collect()] == ["Brand#12", "Brand#7"]


def test_fill_in_order(spark):
    rows = [(i, v, dt.date(2025, 1, 1)) for i, v in enumerate([None, None, 10.0, None, None, 40.0, None])]
    df = spark.createDataFrame(rows, "place int, v double, d date").repartition(3)
    out, _ = missing.fill_missing(df.withColumnRenamed("place", "place_id"), order_by=["place_id"])
    got = [r.v for r in out.orderBy("place_id").collect()]
    assert got == [10.0, 40.0]  # rows without any measure go first
    df = spark.createDataFrame([(i, v, 1.0, dt.date(2025, 1, 1)) for i, v in enumerate([None, 10.0, None, None, 40.0, None])], "place_id int, v double, w double, d date").repartition(4)
    out, _ = missing.fill_missing(df, order_by=["place_id"])
    assert [r.v for r in out.orderBy("place_id").collect()] == [25.0, 10.0, 20.0, 30.0, 40.0, 40.0]


@pytest.mark.parametrize(("values", "merged"), [(["u.k.", "Great Britain", "UK", "gb", "Norway"], {"United Kingdom", "Norway"}), (["L.A.", "Los Angeles", "la", "Reno", "RENO", "Reno"], {"Los Angeles", "Reno"}), (["red-ish", "Red ish", "redish", "redish", "12", "2024-01-02"], {"redish", "12", "2024-01-02"})])
def test_category_spellings(spark, values, merged):
    df = spark.createDataFrame([(v, 1) for v in values], "place string, n int")
    out, mapping = categories.canonical_categories(df)
    assert out.columns == df.columns and {r.place for r in out.collect()} == merged
    assert {r.value for r in mapping.collect()} == set(values) - merged


def test_every_category_column_changes(spark):
    """Fourteen columns with spellings to merge: all of them do, unless a limit is given."""
    names = [f"kind_{k}" for k in range(14)]
    df = spark.createDataFrame([["a-b"] * 14, ["A b"] * 14, ["A b"] * 14], names)
    out, _ = categories.canonical_categories(df)
    assert {tuple(r) for r in out.collect()} == {("A b",) * 14}
    few, mapping = categories.canonical_categories(df, most_changed=2)
    assert {r.column_name for r in mapping.collect()} == {"kind_0", "kind_1"} and few.filter("kind_2 = 'a-b'").count() == 1


def test_near_vectors_merge(spark):
    df = spark.createDataFrame([("Laptop",), ("Laptop",), ("Notebook PC",), ("Chair",)], "item string")
    vectors = spark.createDataFrame([("Laptop", [1.0, 0.1]), ("Notebook PC", [1.0, 0.12]), ("Chair", [0.0, 1.0])], "label string, vector array<double>")
    assert {r.item for r in categories.canonical_categories(df, vectors=vectors)[0].collect()} == {"Laptop", "Chair"}


def test_many_labels_with_vectors(spark):
    """A table of vectors for far more labels than the columns have values."""
    df = spark.createDataFrame([("Laptop",), ("Laptop",), ("Notebook PC",), ("Chair",)], "item string")
    others = [(f"label {k}", [float(k % 7), float(k % 11) - 5]) for k in range(500)]
    vectors = spark.createDataFrame([("Laptop", [1.0, 0.1]), ("Notebook PC", [1.0, 0.12]), ("Chair", [0.0, 1.0]), *others], "label string, vector array<double>")
    assert {r.item for r in categories.canonical_categories(df, vectors=vectors)[0].collect()} == {"Laptop", "Chair"}


def test_clean_is_idempotent_and_total(spark):
    df = spark.createDataFrame([("a", "1", None), ("a", "1", None), (None, None, None), ("b", "2", None)], "`Name & Co` string, `Amount %` string, Empty string")
    once, _ = clean(df)
    again, _ = clean(once)
    assert once.columns == ["name_and_co", "amount_pct"]
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, again.collect())) == [("a", 1.0), ("b", 2.0)]
    assert clean(df.limit(0))[0].count() == 0


def test_rows_keep_the_order_of_their_files(spark, tmp_path):
    """Files of very different sizes, which Spark reads largest first: numbers and filling follow paths and rows."""
    for k, n in enumerate((20, 60_000, 20_000)):
        part = [(k * 1_000_000 + i, k * 1_000_000 + i) for i in range(n)]
        spark.createDataFrame(part, "place long, v long").selectExpr("place AS place_id", "if(v IN (19, 1000000, 1059999, 2000000), NULL, double(v)) AS v", "1D AS w", "date'2025-01-01' AS d").coalesce(1).write.option("parquet.block.size", 65_536).parquet(f"{tmp_path}/t/part={k}")
    df = spark.read.parquet(f"{tmp_path}/t").drop("part")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        numbered = ordered.with_row_number(df.filter("place_id % 7 <> 3").select("place_id", F.lit("x").alias("y")))
        rows = sorted((r["__row"], r.place_id, r["__block"]) for r in numbered.collect())
        out, report = clean(df, CleaningOptions(semantic_categorical_merging=False), row_column="n")
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r[0] for r in rows] == list(range(len(rows))) and [r[1] for r in rows] == sorted(r[1] for r in rows) and len({r[2] for r in rows}) > 3
    got = {r.place_id: r.v for r in out.filter("place_id IN (18, 19, 1000000, 1000001, 1059999, 2000000)").collect()}
    step = (1000001 - 18) / 3
    assert got[19] == pytest.approx(18 + step) and got[1000000] == pytest.approx(18 + 2 * step)
    step = (2000001 - 1059998) / 3
    assert got[1059999] == pytest.approx(1059998 + step) and got[2000000] == pytest.approx(1059998 + 2 * step)
    assert [r.place_id for r in out.orderBy("n").limit(25).collect()] == [*range(20), *range(1000000, 1000005)]
    assert report["missing"]["filled"] == [{"column": "v", "strategy": "interpolate", "cells": 4}]


def test_order_survives_dropped_rows(spark):
    """Numbers are made anew after rows leave, as the weights of interpolation count the rows that stay."""
    rows = [(i, v, w) for i, (v, w) in enumerate([(10.0, 1.0), (None, None), (None, 2.0), (None, None), (40.0, 3.0)])]
    df = spark.createDataFrame(rows, "place_id int, v double, w double").withColumn("d", F.lit(dt.date(2025, 1, 1))).repartitionByRange(3, "place_id")
    out, report = clean(df, CleaningOptions(**PLAIN))
    assert sorted((r.place_id, r.v) for r in out.collect()) == [(0, 10.0), (2, 25.0), (4, 40.0)]
    assert report["rows_without_measures_dropped"] == 2 and report["missing"]["filled"] == [{"column": "v", "strategy": "interpolate", "cells": 1}]


def test_report_counts(spark):
    rows = [(chr(97 + i % 20) * (1 + i % 40), float(i % 40), None) for i in range(60)] + [("Blue Heron Shipping", 7.0, None), ("BLUE HERON shippign", 7.0, None), ("far", 9000.0, None), (None, None, None)]
    df = spark.createDataFrame(rows, "name string, amount double, nothing string").coalesce(1)
    out, report = clean(df, CleaningOptions(fuzzy_deduplicate=True, outlier_policy="exclude", semantic_categorical_merging=False, parse_currency_percent=False))
    assert (report["rows_before"], report["empty_rows_dropped"], report["duplicates_removed"]) == (64, 1, 20)
    assert report["fuzzy"] == {"removed_rows": 1, "examples": [{"dropped_row": 41, "matched_row": 40, "text": "blue heron shippign"}]}
    assert report["outliers"]["rows_excluded"] == 1 and report["outliers"]["values_outside"] == {"amount": 1}
    assert report["rows_after"] == out.count() == 41 and "exclude_outliers" in report["steps"] and (report["columns_before"], report["columns_after"]) == (3, 2)
    capped, report = clean(df, CleaningOptions(outlier_policy="cap", semantic_categorical_merging=False, parse_currency_percent=False))
    assert report["outliers"]["values_outside"] == {"amount": 1} and report["outliers"]["rows_excluded"] == 0 and capped.agg({"amount": "max"}).first()[0] < 9000


def test_chains_of_near_rows(spark, monkeypatch):
    """A chain in which each text is near the next only: every second one goes, by rounds as on the driver."""
    chain = ["x" * k + "a" * (40 - k) for k in range(12)]
    df = spark.createDataFrame([(t, 1) for t in chain], "name string, size int").coalesce(1)
    kept: list[str] = []
    for t in chain:
        if not any(dedup._ratio(t, k, 0.94) for k in kept):
            kept.append(t)
    for few in (0, 200_000):
        monkeypatch.setattr(dedup, "FEW_PAIRS", few)
        assert sorted(r.name for r in dedup.fuzzy_distinct(df).collect()) == sorted(kept)
    assert 1 < len(kept) < 12
