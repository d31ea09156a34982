"""Column names: standard forms, unique forms, and what a name says about its column."""

from __future__ import annotations

import re

# Words that decide how a column is treated while cleaning.
DATE_NAMES = {"month", "period", "timestamp", "datetime"}
CURRENCY_NAME_WORDS = ("price", "revenue", "sales", "cost", "amount", "value", "income", "spend")
PERCENT_NAME_WORDS = ("pct", "percent", "percentage", "rate", "margin")


def standard_name(name: str) -> str:
    """Lower case with ``_`` between words; &, % and currency signs are spelled out."""
    for pattern, word in ((r"&", " and "), (r"%+", " pct "), (r"[$£€¥]+", " currency ")):
        name = re.sub(pattern, word, name)
    return "_".join(re.findall(r"[a-z0-9]+", name.lower()))


def unique_names(names: list[str], fallback: str = "column_{}") -> list[str]:
    """Blank names by place; the second and later of equal names get their number."""
    out, seen = [], {}
    for place, name in enumerate(names, 1):
        name = name or fallback.format(place)
        seen[name] = seen.get(name, 0) + 1
        out.append(name if seen[name] == 1 else f"{name}_{seen[name]}")
    return out


def standard_names(names: list[str]) -> list[str]:
    return unique_names([standard_name(n) for n in names])


def is_identifier(name: str) -> bool:
    return bool(re.search(r"^id$|_id$|^id_|_uuid$|_guid$", standard_name(name)))


def is_year(name: str) -> bool:
    return bool(re.search(r"(^|_)year$", standard_name(name)))


def is_date_like(name: str) -> bool:
    name = standard_name(name)
    return "date" in name or "time" in name or name.endswith("_at") or name in DATE_NAMES


def humanize(name: str) -> str:
    """Words for people: ``total_sales`` reads "Total Sales"; common short forms are written out."""
    long = {"avg": "Average", "pct": "Percentage", "qty": "Quantity", "num": "Number", "id": "ID"}
    return " ".join(long.get(w.lower(), w[:1].upper() + w[1:]) for w in re.split(r"[_\s]+", name.strip()) if w)
