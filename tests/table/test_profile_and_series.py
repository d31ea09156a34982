import datetime as dt
import random
import statistics

import numpy as np
import pytest

from gristmill.operators import charts, combine, outliers, profile, quality, ranking, series


@pytest.mark.parametrize("n", [1, 2, 7, 5000])
def test_exact_quantiles(spark, n):
    r = random.Random(n)
    values = [r.choice([r.gauss(0, 1), 1.0, -2.5]) for _ in range(n)]
    df = spark.createDataFrame([(v, i % 3.0 if i % 2 else None) for i, v in enumerate(values)], "a double, b double").repartition(3)
    got = profile.exact_quantiles(df, ["a", "b"], (0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0))
    assert got["a"] == pytest.approx(list(np.percentile(values, [0, 1, 25, 50, 75, 99, 100])))
    near = profile.exact_quantiles(df, ["a"], (0.01, 0.25, 0.5), nearest=True)["a"]
    assert near == [sorted(values)[round((n - 1) * p)] for p in (0.01, 0.25, 0.5)]
    if n == 1:
        assert got["b"] == [None] * 7


def test_quantiles_at_the_edge_of_a_tie(spark, monkeypatch):
    """Half of the values are 0 and the median lies between 0 and the next one: no list of values reaches the driver."""
    monkeypatch.setattr(profile, "MOST_RANKED", 10)
    r = random.Random(2)
    values = [0.0] * 20_000 + [r.random() + 1 for _ in range(15_000)] + [1.5] * 5_000
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(3)
    seen = []
    collect = type(df).toLocalIterator
    monkeypatch.setattr(type(df), "toLocalIterator", lambda self, *a, **b: (seen.append(x) or x for x in collect(self, *a, **b)))
    probabilities = (0.0, 0.1, 0.5, 0.5001, 0.62, 0.7, 0.9, 0.99999, 1.0)
    got = profile.exact_quantiles(df, ["v"], probabilities)["v"]
    assert got == pytest.approx(list(np.percentile(values, [100 * p for p in probabilities]))) and len(seen) <= 10
    near = profile.exact_quantiles(df, ["v"], (0.5, 0.7), nearest=True)["v"]
    assert near == [sorted(values)[round(39_999 * p)] for p in (0.5, 0.7)]


def test_profile_ignores_partitions(spark):
    df = spark.createDataFrame([(float(i % 17), f"c{i % 5}", i % 4 or None) for i in range(300)], "v double, c string, k int")
    plain = lambda d: sorted([round(x, 9) if isinstance(x, float) else x for x in r] for r in profile.numeric_profile(d).collect())
    assert plain(df.repartition(1)) == plain(df.repartition(7))
    one = {r.column_name: r for r in profile.numeric_profile(df).collect()}["v"]
    assert one["mean"] == pytest.approx(statistics.mean(i % 17 for i in range(300))) and one["count"] == 300
    assert {r.column_name: r.distinct_count for r in profile.missing_and_distinct(df).collect()} == {"v": 17, "c": 5, "k": 3}
    assert {(r.value, r["count"]) for r in profile.top_values(df).collect()} == {(f"c{k}", 60) for k in range(5)}
    rows = {r.column_name: r for r in profile.frame_profile(df).collect()}
    assert rows["k"].unique_count == 4 and rows["k"].null_count == 75 and len(rows["c"].sample_values) == 5


def test_correlation_of_constants_is_absent(spark):
    df = spark.createDataFrame([(float(i), 2.0 * i + 1, 5.0, None if i < 3 else -float(i)) for i in range(20)], "a double, b double, c double, d double")
    assert {(r.left_column, r.right_column): r.correlation for r in profile.correlation_pairs(df).collect()} == {("a", "b"): 1.0, ("a", "d"): -1.0, ("b", "d"): -1.0}


def months(values):
    return [(dt.date(2024 + i // 12, i % 12 + 1, 3), v) for i, v in enumerate(values)]


def test_forecast_of_a_line(spark):
    df = spark.createDataFrame(months([10.0 + 2 * i for i in range(12)]), "d date, v double")
    r = series.linear_forecast(df, "d", "v").first()
    assert (r.monthly_slope, r.next_month, r.next_quarter, r.next_year, r.next_month_low) == (2.0, 34.0, 38.0, 56.0, 34.0)
    assert r.change_percent == 6.25 and r.confidence == 0.9
    assert series.linear_forecast(df.limit(2), "d", "v").count() == 0


def test_outliers_and_spikes(spark):
    df = spark.createDataFrame([(100.0 + i % 3, 7.0) for i in range(20)] + [(10000.0, 7.0)], "v double, c double")
    assert [(r.column_name, r.value) for r in outliers.distribution_outliers(df, ["v", "c"]).collect()] == [("v", 10000.0)]
    df = spark.createDataFrame(months([100.0] * 12 + [101.0] * 11 + [900.0]), "d date, v double")
    assert [r.value for r in series.monthly_spikes(df, "d", "v").collect()] == [900.0]


def test_quality_mix(spark):
    rows = [(None if i < 60 else i, None if i < 30 else i, None if i < 10 else i, i) for i in range(100)]
    df = spark.createDataFrame(rows, "a int, b int, c int, id int")
    issues = quality.quality_issues(df)
    assert {r.column_name: r.severity for r in issues.collect()} == {"a": "critical", "b": "high", "c": "low"}
    assert quality.quality_score(issues, 100).first().quality_score == 89 == quality.score_of([r.asDict() for r in issues.collect()], 100)
    assert quality.quality_score(issues.limit(0), 0).first().quality_score == 0
    twice = spark.createDataFrame([("x", 1), ("x", 1), ("y", 2)], "o string, v int")
    assert quality.duplicate_rows(twice).first().affected_rows == 1


def test_histogram_counts_all_rows(spark):
    df = spark.createDataFrame([(float(i % 40),) for i in range(500)] + [(None,)], "v double")
    rows = charts.histogram_data(df, "v").collect()
    assert len(rows) == 12 and sum(r["count"] for r in rows) == 500
    assert [r["count"] for r in charts.histogram_data(df.filter("v = 3"), "v").collect()] == [13]
    assert charts.histogram_data(df.filter("v IS NULL"), "v").count() == 0


def test_sheets_and_files(spark):
    a = spark.createDataFrame([("X", 1.0), ("Y", 2.0)], "`Organisation Name` string, Cases double")
    b = spark.createDataFrame([("Y", 5.0), ("Z", 7.0), ("Z", 1.0)], "`Organisation Name` string, Costs double")
    joined = combine.combine_sheets({"one": a, "two": b, "three": spark.createDataFrame([], "")})
    assert sorted(map(tuple, joined.collect())) == [("X", 1.0, 0.0), ("Y", 2.0, 5.0), ("Z", 0.0, 8.0)]
    stacked = combine.combine_sheets({"Table 1": a, "Table 2": a})
    assert stacked.count() == 4 and {r.Sheet for r in stacked.collect()} == {"Table 1", "Table 2"}
    mixed = combine.combine_files({"p": a, "q": a.withColumn("Cases", a.Cases.cast("string"))})
    assert dict(mixed.dtypes)["Cases"] == "string" and mixed.count() == 4
    related = combine.combine_files({"p": a, "q": a}, "join", {"type": "join", "columns": ["Organisation Name"]})
    assert related.columns == ["Organisation Name", "Cases", "Cases related 2"]


def test_performance_order(spark):
    rows = [("Alpha", 3, 1, "Win"), ("Alpha", 2, 2, "draw"), ("Alpha", 2, 1, "W"), ("Beta", 1, 3, "lost"), ("Beta", 2, 2, "D"), ("Beta", 1, 2, "L")]
    df = spark.createDataFrame(rows, "team string, goals_team int, goals_opponent int, match_result string")
    got = ranking.performance(df, "team", "goals_team", "goals_opponent", "match_result").collect()
    assert [r.label for r in got] == ["Alpha", "Beta"] and round(got[0].win_rate, 1) == 66.7 and got[0].avg_difference == 1.0
    assert (got[0].wins, got[0].draws, got[1].losses) == (2, 1, 2)
