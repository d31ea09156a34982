import pytest

from gristmill.operators import sketches, store
from gristmill.plans.advice import merged, recommendations
from gristmill.plans.analyze import range_label
from gristmill.plans.chart_plan import select_charts, visual_spec
from gristmill.plans.columns import Column, with_meaning
from gristmill.plans.kpis import detect_kpis
from gristmill.plans.relate import relationship_suggestions


def number(name, **stats):
    return Column(name, "double", numeric=True, stats={"mean": 6.7, "total": 100.0, "count": 10, "min": 2.0, "max": 50.0} | stats)


def meaning(column):
    c = with_meaning([column])[0]
    return c.meaning, c.role


def test_meanings():
    assert meaning(number("total_revenue")) == ("currency", "metric")
    assert meaning(Column("contact", distinct=3, top=[("a@b.com", 1), ("c@d.org", 1), ("x", 1)])) == ("email", "identifier")
    assert meaning(number("match_date")) == ("date", "temporal_dimension")
    assert {meaning(number(n))[1] for n in ("age", "height_cm", "weight_kg", "jersey_number")} == {"attribute"}
    assert meaning(number("c_nationkey")) == ("country", "dimension") and meaning(number("event_id"))[1] == "identifier"
    assert meaning(number("l_discount", min=0.0, max=0.1)) == ("percentage", "metric")
    assert meaning(Column("l_linestatus", distinct=2, top=[("O", 5), ("F", 4)])) == ("boolean", "flag")
    assert meaning(number("year", min=2001, max=2020)) == ("year", "temporal_dimension")
    assert meaning(Column("misc")) == ("unknown", "unknown")


def test_kpis():
    found = detect_kpis(with_meaning([number("revenue"), number("o_totalprice")]))
    assert [k["kpi_type"] for k in found] == ["revenue", "revenue"] and found[0]["is_currency"] and found[0]["is_total"]
    only = detect_kpis(with_meaning([number("engagement_index")]))
    assert [k["kpi_type"] for k in only] == ["other"]
    names = ["match_date", "goals_opponent", "height_cm", "weight_kg", "jersey_number", "expected_goals_xg", "player_rating"]
    found = {k["column"]: k for k in detect_kpis(with_meaning([number(n) for n in names]))}
    assert set(found) == {"expected_goals_xg", "player_rating"}
    assert found["player_rating"]["value"] == 6.7 and not found["player_rating"]["is_total"]


def test_charts():
    columns = with_meaning([Column("position", distinct=4, top=[("GK", 3), ("DF", 2)]), number("age"), number("expected_goals_xg")])
    planned = select_charts(columns, {})
    assert {(c["x"], *c["measures"]) for c in planned if c["type"] == "bar"} == {("position", "expected_goals_xg")}
    assert not any("age" in (c["x"], *c["measures"]) for c in planned)
    spec = visual_spec({"type": "bar"}, [{"label": "a", "value": 1}, {"label": "b", "value": 2}])
    assert spec["mark"] == "bar" and len(spec["data"]["values"]) == 2
    assert len(visual_spec({"type": "histogram"}, [{"bin": i, "count": 1} for i in range(1200)])["data"]["values"]) == 1000


def test_recommendations():
    issue = {"column_name": "region", "severity": "high", "affected_rows": 40}
    assert recommendations([], {"score": 80, "issues": [issue]}, [], [])[0]["importance"] == "high"
    kpi = {"column": "revenue", "kpi_type": "revenue", "value": 100000.0, "is_currency": True, "is_total": True}
    forecast = {"metric": "revenue", "change_percent": -12.5, "latest_value": 10.0, "next_month": 8.75, "observations": 12, "confidence": 0.8}
    advice = recommendations([kpi], {"score": 99, "issues": []}, [], [forecast])
    assert advice[0]["financial_opportunity"] == 3000 and "decline" in advice[0]["title"]
    odd = {"type": "distribution", "column": "goals", "value": 9.0, "expected": 1.0, "score": 4.0}
    assert recommendations([], {"score": 99, "issues": []}, [odd], [])[0]["owner"] == "Performance Team"
    assert recommendations([kpi], {"score": 99, "issues": []}, [], [])[0]["financial_opportunity"] == 1000
    assert len(merged(advice, [advice[0] | {"title": advice[0]["title"]}])) == 1


def profile(*names, unique=10, filled=10):
    return [{"column_name": n, "unique_count": unique, "non_null_count": filled} for n in names]


@pytest.mark.parametrize(
    ("files", "kind"),
    [
        ({"a": profile("id", "x", "y"), "b": profile("ID", "X", "y")}, "stack"),
        ({"a": profile("company_id", "x", "y"), "b": profile("Company ID", "p", "q")}, "join"),
        ({"a": profile("area", "x", "y"), "b": profile("area", "p", "q")}, "compare"),
        ({"a": profile("x"), "b": profile("y")}, "separate"),
        ({"a": profile("x")}, "separate"),
        ({"a": profile("sheet", "x")}, "sheets"),
        ({"r 2023": profile("area", "x", "y"), "r 2024": profile("area", "p", "q")}, "compare"),
    ],
)
def test_relations(files, kind):
    assert relationship_suggestions(files)[0]["type"] == kind


def test_sketches_of_files_merge(spark, tmp_path):
    """Sketches of several files against exact values; files that are known aren't read again."""
    path = f"{tmp_path}/t"
    spark.range(30_000).selectExpr("id % 5000 AS k", "sqrt(id) AS v", "if(id % 4 = 0, null, concat('n', id % 77)) AS name").repartition(3).write.parquet(path)
    _, known = sketches.grown_profile(spark.read.parquet(path), None)
    known = spark.createDataFrame(known.collect(), known.schema)
    assert known.select("file").distinct().count() == 3 and known.count() == 9
    spark.range(30_000, 40_000).selectExpr("id AS k", "sqrt(id) AS v", "cast(null AS string) AS name").coalesce(1).write.mode("append").parquet(path)
    found, every = sketches.grown_profile(spark.read.parquet(path), known)
    assert every.select("file").distinct().count() == 4
    rows = {r.column_name: r for r in found.collect()}
    assert (rows["k"].row_count, rows["k"].missing, rows["name"].missing, rows["k"].max) == (40_000, 0, 17_500, 39_999.0)
    assert abs(rows["k"].distinct_count - 15_000) <= 450 and rows["name"].distinct_count == 77 and rows["name"].quantiles is None
    for q, p in zip(rows["v"].quantiles, (0.25, 0.5, 0.75)):
        assert abs(q * q / 40_000 - p) < 0.02
    empty = {r.column_name: r for r in sketches.merged_profile(sketches.file_sketches(spark.createDataFrame([(None,)], "v double"))).collect()}
    assert (empty["v"].row_count, empty["v"].missing, empty["v"].mean) == (1, 1, None)


def test_pages_by_key_and_stored_results(spark, tmp_path):
    df = spark.createDataFrame([(i % 7 or None, i) for i in range(60)], "k int, n int").repartition(3)
    want = sorted(((r.k, r.n) for r in df.collect() if r.k is not None), key=lambda r: (-r[0], r[1]))
    got, after = [], None
    while rows := store.page_after(df, "k", ["n"], after, 8).collect():
        got, after = got + [tuple(r) for r in rows], rows[-1].asDict()
    assert got == want
    path = f"{tmp_path}/results"
    one = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "analysis_id string, n int")
    store.write_results(one, path)
    store.write_results(one.filter("n = 2"), path)
    store.write_results(one.filter("n = 2"), path)
    assert sorted(tuple(r) for r in spark.read.parquet(path).select("analysis_id", "n").collect()) == [("a", 2), ("b", 3)]


def test_labels_of_ranges():
    assert [range_label(*x) for x in ((0.5, 2.5), (3.0, 3.0), (-10.4, 99.6))] == ["0-2", "3", "-10-100"]


def test_advice_on_volumes_shares_a_key():
    said = [{"title": "Review the High-Volume group", "evidence": "a"}, {"title": "Check concentration", "evidence": "b"}, {"title": "Concentration risk", "evidence": "Skilled  Worker share"}, {"title": " "}, {"title": "Fix 3 gaps"}, {"title": "Fix 12 gaps", "evidence": "other"}]
    assert [x["title"] for x in merged(said[:1], said[1:])] == ["Review the High-Volume group", "Concentration risk", "Fix 3 gaps"]
