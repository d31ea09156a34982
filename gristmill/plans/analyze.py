"""One table in, one report out: profiles, meanings, key measures, charts, forecasts, anomalies, advice."""

from __future__ import annotations

import re

from pyspark import StorageLevel
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Row, SparkSession

from ..functions.names import humanize
from ..operators import charts as C
from ..operators import outliers, profile, quality, ranking, series
from .advice import merged, recommendations, summary
from .chart_plan import select_charts, visual_spec
from .columns import Column, with_meaning
from .kpis import detect_kpis, is_business_measure
from .questions import team_answer

# How much of each a report lists.
MOST_FORECASTS, MOST_ANOMALIES, FORECAST_KINDS = 3, 8, ("revenue", "profit", "orders", "customers")
PROFILE_VERSION = "1.0"
INSIGHT_START = {"kpi": 0, "forecast": 150, "anomaly": 175, "recommendation": 200}
INSIGHT_SCHEMA = "type string, title string, description string, importance string, confidence double, sort_order int, data string"
RATED_MISSING = "missing_values"


def describe(df: DataFrame) -> tuple[list[Column], dict]:
    """Columns with meaning and role, and table facts, from a few jobs over all columns each."""
    numeric, temporal = profile.columns_of(df, "numeric"), profile.columns_of(df, "temporal")
    stats = {r.column_name: r.asDict() for r in profile.numeric_profile(df).collect()} if numeric else {}
    others = profile.columns_of(df, "categorical")
    counts = {r.column_name: r for r in profile.missing_and_distinct(df, others).collect()} if others else {}
    top: dict[str, list] = {}
    if others:
        for r in profile.top_values(df, others, distinct={c: counts[c].distinct_count for c in others}).orderBy("column_name", "place").collect():
            top.setdefault(r.column_name, []).append((r.value, r["count"]))
    columns = [Column(n, t, n in numeric, n in temporal, stats.get(n, {}), counts[n].distinct_count if n in counts else 0, top.get(n, [])) for n, t in df.dtypes]
    rows = df.count()
    issues = [r.asDict() for r in quality.quality_issues(df).collect()]
    facts = {
        "row_count": rows,
        "column_count": len(df.columns),
        "date_range": {r.column_name: (r.min_date, r.max_date) for r in profile.date_range_profile(df).collect()} if temporal else {},
        "correlations": {(r.left_column, r.right_column): r.correlation for r in profile.correlation_pairs(df).collect()},
        "quality": {"score": quality.score_of(issues, rows), "issues": issues[: quality.MOST_ISSUES], "fixes": issues[: quality.MOST_FIXES]},
    }
    return with_meaning(columns), facts


def chart_data(df: DataFrame, chart: dict) -> DataFrame:
    """The small table behind a planned chart."""
    kind, x, measures = chart["type"], chart["x"], chart["measures"]
    if kind in ("line", "multi_line"):
        return C.line_data(df, x, measures)
    if kind == "bar":
        return C.bar_data(df, x, measures[0])
    if kind == "donut":
        return C.donut_data(df, x)
    return C.scatter_data(df, x, measures[0], x) if kind == "scatter" else C.histogram_data(df, x)


def forecasts(df: DataFrame, columns: list[Column], kpis: list[dict]) -> list[dict]:
    """Of the first date column, for the key measures that have a forecast, three at most."""
    date = next((c.name for c in columns if c.temporal), None)
    known = [k["column"] for k in kpis if k["kpi_type"] in FORECAST_KINDS] or _measures(columns)
    return [r.asDict() for m in known[:MOST_FORECASTS] for r in series.linear_forecast(df, date, m).collect()] if date else []


def _measures(columns: list[Column]) -> list[str]:
    return [c.name for c in columns if c.numeric and c.role == "metric" and is_business_measure(c.name)]


def anomalies(df: DataFrame, columns: list[Column], most: int = MOST_ANOMALIES) -> list[dict]:
    """The farthest values and months of each measure, by measure until there are enough, then by score."""
    measures = _measures(columns)
    far = {r.column_name: r for r in outliers.distribution_outliers(df, measures).collect()} if measures else {}
    date = next((c.name for c in columns if c.temporal), None)
    found: list[dict] = []
    for m in measures:
        if len(found) >= most:
            break
        if m in far:
            found.append({"type": "distribution", "column": m, "value": far[m].value, "expected": far[m]["mean"], "score": far[m].z_score})
        if date:
            found += [{"type": "monthly", "column": m, "period": r.period, "value": r.value, "expected": r.avg_value, "score": r.z_score} for r in series.spikes_and_mean(df, date, m).collect()]
    return sorted(found, key=lambda a: -a["score"])[:most]


def combined_quality(found: dict) -> dict:
    """For several tables put together: missing values are expected, and the score is 95 at least."""
    issues = [i for i in found["issues"] if i["issue_type"] != RATED_MISSING]
    return {"score": max(95, found["score"]), "issues": issues, "fixes": issues}


def range_label(start: float, end: float) -> str:
    """The label of a histogram's range; of one value, the value."""
    return f"{start:.0f}" if start == end else f"{start:.0f}-{end:.0f}"


def analyze(df: DataFrame, name: str = "data", combined: bool = False) -> dict:
    """The whole report as a document; ``df`` is cached on executors meanwhile."""
    df = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        columns, facts = describe(df)
        if combined:
            facts["quality"] = combined_quality(facts["quality"])
        kpis = detect_kpis(columns)
        planned = select_charts(columns, facts["correlations"])
        drawn = []
        for chart in planned:
            chart["title"] = " by ".join(filter(None, [" and ".join(map(humanize, chart["measures"])), humanize(chart["x"])]))
            try:
                rows, failed = [r.asDict() for r in chart_data(df, chart).collect()], None
            except PySparkException as error:  # one chart without data doesn't end the report
                rows, failed = [], str(error).splitlines()[0]
            if chart["type"] == "histogram":
                rows = [r | {"label": range_label(r["bin_start"], r["bin_end"])} for r in rows]
            chart["axis_labels"] = {"x": humanize(chart["x"]) if chart["x"] else None, "y": [humanize(m) for m in chart["measures"]]}
            drawn.append(chart | {"spec": visual_spec(chart, rows)} | ({"error": failed} if failed else {}))
        ahead, odd = forecasts(df, columns, kpis), anomalies(df, columns)
    finally:
        df.unpersist()
    return {
        "profile_version": PROFILE_VERSION,
        "dataset": {"name": name, "row_count": facts["row_count"], "column_count": facts["column_count"]},
        "columns": [vars(c) | {"display_label": humanize(c.name)} for c in columns],
        "metrics": {"kpis": kpis, "correlations": {"|".join(p): r for p, r in facts["correlations"].items()}, "forecasts": ahead[:5], "anomalies": odd},
        "categories": {c.name: {"unique_count": c.distinct, "top_values": c.top[:10]} for c in columns if c.distinct},
        "date_range": facts["date_range"],
        "data_quality": facts["quality"],
        "charts": drawn,
        "recommendations": merged(recommendations(kpis, facts["quality"], odd, ahead)),
        "summary": summary(facts["row_count"], facts["column_count"], kpis, facts["quality"]),
    }


def insight_rows(spark: SparkSession, report: dict) -> DataFrame:
    """The findings of a report as rows to store, in order of display."""
    import json

    found = [("kpi", humanize(k["column"]), f"{k['kpi_type']}: {k['value']}", "high", 0.9, k) for k in report["metrics"]["kpis"]]
    found += [("forecast", f"{humanize(f['metric'])} forecast", f"{f['next_month']:,.2f} next month ({f['change_percent']:+.1f}%)", "medium", f["confidence"], f) for f in report["metrics"]["forecasts"][:3]]
    found += [("anomaly", f"{humanize(a['column'])} stands out", f"{a['value']:,.2f}, {a['score']:.1f} deviations off", "high", min(a["score"] / 5, 0.95), a) for a in report["metrics"]["anomalies"][:5]]
    found += [("recommendation", r["title"], r["problem"], r["importance"], r["confidence"], r) for r in report["recommendations"][:8]]
    place: dict[str, int] = {}
    rows = []
    for kind, title, text, importance, confidence, data in found:
        place[kind] = place.get(kind, -1) + 1
        rows.append(Row(kind, title, text, importance, float(confidence), INSIGHT_START[kind] + place[kind], json.dumps(data, default=str, sort_keys=True)))
    return spark.createDataFrame(rows, INSIGHT_SCHEMA)


# Words of a question for a ranking, and those of them that ask for its lower end.
ASK_WORDS = ("top", "best", "most", "highest", "rank", "ranking", "leading", "lowest", "worst", "least", "bottom", "fewest")
LOWEST_WORDS = {"lowest", "worst", "least", "bottom", "fewest"}


def _stems(text: str) -> list[str]:
    return [w.rstrip("s") for w in re.findall(r"[a-z0-9]+", text.lower())]


def named_column(question: str, columns: list[Column]) -> Column | None:
    """The column that a question names: by its whole name, the longest first; else by most of its words, at least one."""
    asked = _stems(question)
    parts = {c.name: _stems(humanize(c.name)) for c in columns}
    whole = [c for c in columns if parts[c.name] and any(asked[k : k + len(parts[c.name])] == parts[c.name] for k in range(len(asked)))]
    if whole:
        return max(whole, key=lambda c: len(parts[c.name]))
    shared = [c for c in columns if set(parts[c.name]) & set(asked)]
    return max(shared, key=lambda c: len(set(parts[c.name]) & set(asked)) / len(parts[c.name])) if shared else None


def answer(df: DataFrame, question: str, columns: list[Column] | None = None) -> dict | None:
    """A ranking question ("top regions by sales", "lowest ...") answered by a text, a bar chart and a table; None where no columns fit.

    Groups are columns that are neither numbers nor dates, measures are numbers; a measure that the
    question doesn't name is the table's first key measure. Questions about teams and their results are
    answered by ``team_answer``.
    """
    found = team_answer(df, question)
    if found:
        return found
    asked = set(re.findall(r"[a-z]+", question.lower()))
    if not asked & set(ASK_WORDS):
        return None
    columns = columns or describe(df)[0]
    group = named_column(question, [c for c in columns if not c.numeric and not c.temporal])
    measures = [c for c in columns if c.numeric]
    measure = named_column(question, measures) or next((c for k in detect_kpis(columns) for c in measures if c.name == k["column"]), None)
    if group is None or measure is None:
        return None
    lowest = bool(asked & LOWEST_WORDS)
    table = ranking.top_groups(df, group.name, measure.name, lowest=lowest)
    rows = [r.asDict() for r in table.collect()]
    chart = {"id": "answer", "type": "bar", "x": group.name, "measures": [measure.name]}
    text = f"{'Lowest' if lowest else 'Top'} {humanize(group.name)} by {humanize(measure.name)}: " + ", ".join(f"{r['label']} ({r['total']:,.2f})" if r["total"] is not None else f"{r['label']} (no values)" for r in rows)
    return {"text": text, "chart": chart | {"title": f"{humanize(measure.name)} by {humanize(group.name)}", "rows": rows}, "table": table}


def ask(df: DataFrame, question: str, columns: list[Column] | None = None) -> DataFrame | None:
    """The table that answers a ranking question; None where no columns fit."""
    found = answer(df, question, columns)
    return found["table"] if found else None
