"""Which charts to draw, and their neutral specifications."""

from __future__ import annotations

from .columns import Column
from .kpis import is_business_measure, measure_name

# Limits, and words that make a dimension worth a chart.
MOST_CHARTS, MOST_DISTINCT, MOST_SPEC_ROWS = 8, 500, 1000
DIMENSION_WORDS = ("company", "organisation", "organization", "sponsor", "therapy", "area", "type", "phase", "status", "country", "category")
MARKS = {"line": "line", "multi_line": "line", "bar": "bar", "donut": "arc", "scatter": "point", "histogram": "bar"}


def _is_dimension(c: Column) -> bool:
    name = measure_name(c.name)
    named_off = name == "id" or name.endswith("_id") or name.startswith("id_") or "description" in name or name in ("summary", "title", "headline")
    return c.role in ("dimension", "temporal_dimension") and not named_off and c.distinct <= MOST_DISTINCT


def dimension_score(c: Column) -> float:
    name = measure_name(c.name)
    return 20 * (name == "source_file") + 10 * any(w in name for w in DIMENSION_WORDS) + 6 * (name == "year" or name.endswith("_year")) + (4 if 2 <= c.distinct <= 30 else 2 if 31 <= c.distinct <= 100 else 0)


def select_charts(columns: list[Column], correlations: dict[tuple[str, str], float]) -> list[dict]:
    """Charts in order of worth, eight at most: lines over time, bars, a donut, a scatter, a histogram."""
    dates = [c.name for c in columns if c.temporal or c.role == "temporal_dimension"]
    measures = [c.name for c in columns if c.numeric and c.role == "metric" and is_business_measure(c.name)]
    dimensions = sorted((c for c in columns if _is_dimension(c)), key=dimension_score, reverse=True)
    charts: list[dict] = []
    if dates and measures:
        if len(measures) > 1:
            charts.append({"type": "multi_line", "x": dates[0], "measures": measures[:3]})
        charts.append({"type": "line", "x": dates[0], "measures": measures[:1]})
    bars = [(dimensions[0].name, m) for m in measures[:3]] if dimensions else []
    bars += [(d.name, measures[0]) for d in dimensions[:3] if measures and len(d.top) > 1]
    charts += [{"type": "bar", "x": d, "measures": [m]} for d, m in dict.fromkeys(bars)]
    donut = next((d for d in dimensions if 2 <= d.distinct <= 8 and len(d.top) > 1), None)
    if donut:
        charts.append({"type": "donut", "x": donut.name, "measures": []})
    pairs = {p: r for p, r in correlations.items() if all(map(is_business_measure, p))}
    if pairs:
        (a, b), _ = max(pairs.items(), key=lambda kv: abs(kv[1]))
        charts.append({"type": "scatter", "x": a, "measures": [b]})
    if measures:
        charts.append({"type": "histogram", "x": measures[0], "measures": []})
    return [c | {"id": f"chart-{k}"} for k, c in enumerate(charts[:MOST_CHARTS], 1)]


def visual_spec(chart: dict, rows: list[dict]) -> dict:
    """A mark with encodings and at most a thousand rows of data."""
    fields = list(rows[0]) if rows else []
    kind = {"x": "temporal" if chart["type"] in ("line", "multi_line") else "quantitative" if chart["type"] in ("scatter", "histogram") else "nominal"}
    encoding = {"x": {"field": fields[0], "type": kind["x"]}, "y": [{"field": f, "type": "quantitative"} for f in fields[1:]]} if fields else {}
    return {"mark": MARKS.get(chart["type"], "bar") if rows else "empty", "encoding": encoding, "data": {"values": rows[:MOST_SPEC_ROWS]}, "title": chart.get("title", "")}
