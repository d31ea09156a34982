"""Recommendations with their evidence, a summary in words, and the merge of several lists."""

from __future__ import annotations

import re

from ..functions.names import humanize
from .kpis import is_currency

# Shares of a value taken as an opportunity, changes that matter, and limits.
FORECAST_SHARE, TRACKING_SHARE = 0.03, 0.01
LEAST_CHANGE, LARGE_CHANGE, MOST_ADVICE = 5, 15, 8
OWNERS = ((("revenue", "sales", "arr", "mrr"), "Revenue Operations"),)
PERFORMANCE_OWNER, OTHER_OWNER = "Performance Team", "Operations"


def _owner(metric: str) -> str:
    return next((who for words, who in OWNERS if any(w in metric.lower() for w in words)), OTHER_OWNER)


def _item(title: str, problem: str, evidence: str, importance: str, confidence: float, owner: str, effort: str, opportunity: float | None = None) -> dict:
    return {"title": title, "problem": problem, "evidence": evidence, "importance": importance, "confidence": confidence, "owner": owner, "estimated_completion": effort, "financial_opportunity": opportunity}


def recommendations(kpis: list[dict], quality: dict, anomalies: list[dict], forecasts: list[dict]) -> list[dict]:
    """Worst quality issue, forecasts that move, the top anomaly; else the first measure to track."""
    out = []
    severe = [i for i in quality.get("issues", []) if i["severity"] in ("high", "critical")]
    if severe:
        what = f"{humanize(severe[0]['column_name'])} lacks {severe[0]['affected_rows']:,} values" if severe[0]["column_name"] else "Rows are repeated"
        out.append(_item("Clean high-impact data quality issues", what, f"Quality score {quality['score']}/100, {len(quality['issues'])} issues", "high", 0.9, "Data Operations", "1-2 weeks"))
    values = {k["column"]: k for k in kpis}
    for f in forecasts:
        change, kpi = f["change_percent"], values.get(f["metric"], {})
        if abs(change) >= LEAST_CHANGE:
            way, name = "increase" if change > 0 else "decline", humanize(f["metric"])
            money = kpi.get("is_currency") or is_currency(f["metric"])
            gain = round(abs(kpi["value"]) * FORECAST_SHARE, 2) if money and kpi.get("value") is not None else None
            out.append(_item(f"Prepare for {name} {way}", f"{name} is projected to {way} by {abs(change):.1f}% next month", f"Latest {f['latest_value']:,.2f}, forecast {f['next_month']:,.2f} from {f['observations']} months", "high" if abs(change) >= LARGE_CHANGE else "medium", f["confidence"], _owner(f["metric"]), "2 weeks", gain))
    if anomalies:
        top = anomalies[0]
        out.append(_item(f"Look into standout {humanize(top['column'])}", f"A value of {humanize(top['column'])} is {top['score']:.1f} deviations from usual", f"{top['value']:,.2f} against {top['expected']:,.2f}", "high", 0.82, PERFORMANCE_OWNER, "3 days"))
    if not out and kpis:
        k = kpis[0]
        gain = round(abs(k["value"]) * TRACKING_SHARE, 2) if k["is_currency"] and k["value"] is not None else None
        out.append(_item(f"Track {humanize(k['column'])} regularly", "A useful measure has no review rhythm yet", f"{humanize(k['column'])} is {k['value']:,.2f}", "medium", 0.72, OTHER_OWNER, "1 week", gain))
    return out[:MOST_ADVICE]


def _masked(title: str) -> str:
    return re.sub(r"\d[\d,.\s]*", "#", title.lower()).strip()


# Words of advice on volumes, of which one is enough, and the subjects that are told apart in it.
VOLUME_WORDS, VOLUME_SUBJECTS = ("high-volume", "high volume", "concentration"), ("global business mobility", "skilled worker")


def _key(item: dict) -> str:
    """What makes two items the same: titles but for numbers, and for advice on volumes its subject, whatever the words."""
    said = " ".join(f"{item.get('title') or ''} {item.get('evidence') or ''}".lower().split())
    if any(w in said for w in VOLUME_WORDS):
        return "volume:" + next((w for w in VOLUME_SUBJECTS if w in said), "")
    return _masked(item["title"])


def merged(*lists: list[dict], most: int = MOST_ADVICE) -> list[dict]:
    """Items with a title in order, of those with one key the first."""
    seen: dict[str, dict] = {}
    for item in (i for items in lists for i in items if (i.get("title") or "").strip()):
        seen.setdefault(_key(item), item)
    return list(seen.values())[:most]


def summary(row_count: int, column_count: int, kpis: list[dict], quality: dict) -> str:
    parts = [f"The table has {row_count:,} rows and {column_count} columns."]
    if kpis:
        parts.append("Key measures: " + ", ".join(f"{humanize(k['column'])} {k['value']:,.2f} ({'total' if k['is_total'] else 'average'})" for k in kpis[:3]) + ".")
    parts.append(f"Data quality is {quality['score']}/100.")
    return " ".join(parts)
