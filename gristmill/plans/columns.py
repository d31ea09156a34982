"""What a column means and which role it plays, from its name, type and collected statistics."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

# Words by meaning, tried in this order, with the confidence of a hit.
MEANING_WORDS = (
    ("currency", ("revenue", "sales", "profit", "price", "amount", "cost", "expense", "gmv", "arr", "mrr"), 0.92),
    ("percentage", ("percent", "percentage", "rate", "margin", "conversion", "churn", "retention"), 0.88),
    ("country", ("country", "nation", "market"), 0.86),
    ("city", ("city", "town", "metro"), 0.84),
    ("product", ("product", "sku", "item", "style", "model"), 0.88),
    ("category", ("category", "segment", "channel", "type", "class"), 0.84),
    ("department", ("department", "team", "division", "function"), 0.84),
    ("employee_name", ("employee", "staff", "rep", "agent", "owner", "manager"), 0.78),
    ("customer_id", ("customer_id", "client_id", "account_id", "user_id", "buyer_id"), 0.92),
    ("invoice_id", ("invoice", "order_id", "transaction_id", "receipt", "booking_id"), 0.9),
    ("email", ("email", "e-mail"), 0.95),
    ("phone", ("phone", "mobile", "telephone"), 0.94),
)
ROLES = {"customer_id": "identifier", "invoice_id": "identifier", "email": "identifier", "phone": "identifier", "employee_name": "identifier", "country": "dimension", "city": "dimension", "product": "dimension", "category": "dimension", "department": "dimension", "currency": "metric", "percentage": "metric"}
ATTRIBUTE_WORDS = ("age", "height", "weight", "jersey", "shirt_number", "squad_number", "number", "latitude", "longitude", "lat", "lon", "lng", "coord")
AVERAGE_WORDS = ("accuracy", "rating", "score", "percentage", "percent", "pct", "rate", "ratio", "speed", "stamina", "impact", "resistance", "creativity", "consistency")
DATE_PARTS, DATE_NAMES = {"date", "time", "timestamp"}, {"period", "month", "datetime"}
TEXT_NAMES = {"summary", "title", "headline"}
EMAIL, PHONE = re.compile(r"[^@\s]+@[^@\s]+\.[^@\s]+"), re.compile(r"\+?[\d\s().-]{7,}")
YEARS = (1900, 2200)


@dataclass
class Column:
    """A column with what is known of it."""

    name: str
    dtype: str = "string"
    numeric: bool = False
    temporal: bool = False
    stats: dict = field(default_factory=dict)  # count, min, max, mean, total, ... of a numeric column
    distinct: int = 0
    top: list[tuple[str, int]] = field(default_factory=list)
    meaning: str = "unknown"
    confidence: float = 0.4
    role: str = "unknown"


def plain(name: str) -> str:
    return re.sub(r"[^a-z0-9_]+", "_", name.lower())


def _no_other_numbers_than_years(column: Column) -> bool:
    return column.stats.get("min") is None or _within(column, *YEARS)


def _by_name(column: Column) -> tuple[str, float, str] | None:
    name = plain(column.name)
    parts = set(name.split("_"))
    if column.temporal:
        return "date", 0.98, "temporal_dimension"
    if parts & DATE_PARTS or name.endswith("_at") or name in DATE_NAMES:
        return "date", 0.9, "temporal_dimension"
    if name in ("source_file", "sheet"):
        return "source", 0.96, "dimension"
    if re.search(r"(^(fiscal_|calendar_)?|_)year$", name) and (not column.numeric or _no_other_numbers_than_years(column)):
        return "year", 0.94, "temporal_dimension"
    if re.search(r"^(id|uuid|guid)$|_(id|uuid|guid)$|^id_", name):
        return "identifier", 0.9, "identifier"
    if name.startswith(("is_", "has_")):
        return "boolean", 0.82, "flag"
    if "description" in name or name in TEXT_NAMES:
        return "text", 0.78, "text"
    for meaning, words, confidence in MEANING_WORDS:
        if any(w in name for w in words):
            return meaning, confidence, ROLES[meaning]
    return None


def _named_like_attribute(column: Column) -> bool:
    name = plain(column.name)
    words = {*name.split("_"), *(w for w in ("shirt_number", "squad_number") if w in name)}
    return "market_value" not in name and bool(words & {*ATTRIBUTE_WORDS, "id"})


def _share_of_values(column: Column, pattern: re.Pattern) -> float:
    """How many of the listed values have a form, of at least two."""
    return sum(bool(pattern.fullmatch(v)) for v, _ in column.top) / max(2, len(column.top) - len(column.top) % 2)


def _within(column: Column, low: float, high: float) -> bool:
    ends = [column.stats.get(k) for k in ("min", "max")]
    return None not in ends and low <= ends[0] and ends[1] <= high


#: Tests in order: of numeric columns, then of others; the first that holds gives meaning, confidence and role.
NUMBER_TESTS = (
    (_named_like_attribute, ("numeric_attribute", 0.84, "attribute")),
    (lambda c: "market_value" not in plain(c.name) and _within(c, *YEARS), ("numeric_attribute", 0.84, "attribute")),
    (lambda c: any(w in plain(c.name) for w in AVERAGE_WORDS), ("average_metric", 0.78, "metric")),
    (lambda c: _within(c, 0, 1), ("percentage", 0.72, "metric")),
    (lambda c: True, ("numeric_metric", 0.7, "metric")),
)
VALUE_TESTS = (
    (lambda c: _share_of_values(c, EMAIL) >= 0.5, ("email", 0.9, "identifier")),
    (lambda c: _share_of_values(c, PHONE) >= 0.5, ("phone", 0.86, "identifier")),
    (lambda c: 1 <= c.distinct <= 2, ("boolean", 0.72, "flag")),
    (lambda c: c.distinct > 0, ("categorical_dimension", 0.66, "dimension")),
    (lambda c: True, ("unknown", 0.4, "unknown")),
)


def with_meaning(columns: list[Column]) -> list[Column]:
    """Set meaning, confidence and role: by name first, then by numbers or values."""
    for c in columns:
        c.meaning, c.confidence, c.role = _by_name(c) or next(found for holds, found in (NUMBER_TESTS if c.numeric else VALUE_TESTS) if holds(c))
    return columns
