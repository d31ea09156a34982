"""Expressions over text cells: white space, missing tokens, numbers, dates, category keys."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Texts that mean a missing value (lower case).
MISSING_TOKENS = ("", "-", "--", "n/a", "na", "nan", "none", "null", "nil", "unknown", "missing", "#n/a", "#na")
# Currency signs and codes, and scale words with their factors.
CURRENCY_SIGNS = "$£€¥₹₦"
CURRENCY_CODES = ("usd", "eur", "gbp", "cad", "aud", "ngn", "jpy", "cny", "inr", "zar")
SCALES = ((r"\b(bn|billion)\b|\d\s*b$", 1e9), (r"\b(m|mn|million)\b|\d\s*m$", 1e6), (r"\b(k|thousand)\b|\d\s*k$", 1e3))
SCALE_WORDS = r"\b(bn|billion|mn|million|thousand|k|m|b)\b"

# Other names of places, by their key.
CATEGORY_ALIASES = {
    "usa": "United States",
    "us": "United States",
    "u_s": "United States",
    "u_s_a": "United States",
    "unitedstates": "United States",
    "united_states": "United States",
    "america": "United States",
    "uk": "United Kingdom",
    "u_k": "United Kingdom",
    "gb": "United Kingdom",
    "gbr": "United Kingdom",
    "greatbritain": "United Kingdom",
    "great_britain": "United Kingdom",
    "unitedkingdom": "United Kingdom",
    "united_kingdom": "United Kingdom",
    "uae": "United Arab Emirates",
    "u_a_e": "United Arab Emirates",
    "ny": "New York",
    "n_y": "New York",
    "nyc": "New York",
    "n_y_c": "New York",
    "newyork": "New York",
    "new_york": "New York",
    "newyorkcity": "New York",
    "new_york_city": "New York",
    "sf": "San Francisco",
    "s_f": "San Francisco",
    "sanfrancisco": "San Francisco",
    "san_francisco": "San Francisco",
    "la": "Los Angeles",
    "l_a": "Los Angeles",
    "losangeles": "Los Angeles",
    "los_angeles": "Los Angeles",
}


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is used: Spark computes what branches share in each of them."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def squeezed(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def without_missing(text: Column) -> Column:
    """Squeezed text; a missing token reads as null."""
    return bound(squeezed(text), lambda clean: F.when(~F.lower(clean).isin(*MISSING_TOKENS), clean))


def number_in(text: Column, strict: bool = False) -> Column:
    """The number that a cell shows: currency, %, thousands, (negative), k/m/bn; null if there is none.

    The first number anywhere in the cell counts; ``strict`` wants nothing but the number.
    """
    return bound(F.lower(F.trim(text)), lambda low: F.when(low.rlike(r"\d"), _number(low, strict)))


def _number(low: Column, strict: bool) -> Column:
    negative = low.startswith("-") | (low.startswith("(") & low.endswith(")"))

    def scaled(inner: Column) -> Column:
        factor = F.lit(1.0)
        for pattern, scale in reversed(SCALES):
            factor = F.when(inner.rlike(pattern), F.lit(scale)).otherwise(factor)
        bare = F.regexp_replace(inner, rf"\b({'|'.join(CURRENCY_CODES)})\b|[,%{CURRENCY_SIGNS}]", "")
        bare = F.replace(F.regexp_replace(bare, SCALE_WORDS, ""), F.lit(" "), F.lit(""))

        def value(bare: Column) -> Column:
            found = F.regexp_extract(bare, r"[-+]?\d*\.?\d+", 0)
            # An empty text isn't tried: each failing try costs an exception.
            return bound(found, lambda x: F.when((x != "") & (x == bare) if strict else x != "", x).try_cast("double") * factor)

        return bound(bare, value)

    number = bound(F.regexp_replace(low, r"^[()]+|[()]+$", ""), scaled)
    return F.when(~low.isin(*MISSING_TOKENS), bound(number, lambda n: F.when(negative, -F.abs(n)).otherwise(n)))


def shows_currency(text: Column) -> Column:
    return text.rlike(rf"(?i)[{CURRENCY_SIGNS}]|\b({'|'.join(CURRENCY_CODES)})\b")


# The grammar of moments: a weekday that is skipped, a date in one of five shapes, a time of day, a zone.
_MONTHS = "jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?"
_WEEKDAY = r"(?:(?:mon|tues?|wed(?:nes)?|thu(?:rs?)?|fri|sat(?:ur)?|sun)(?:day)?\.?,? )?"
_NTH, _GAP = "(?:st|nd|rd|th)?", r"(?: of)?[-/., ]*"
#: By shape: the pattern of the date, and the groups of year, month and day (0: none).
_DATES = {
    "year first": (r"(\d{4})([-/. ])(\d{1,2})(?:\2(\d{1,2}))?", (1, 3, 4)),
    "digits": (r"(\d{4})(\d{2})(\d{2})", (1, 2, 3)),
    "numbers": (r"(\d{1,2})([-/. ])(\d{1,2})\2(\d{4}|\d{2})", (4, 1, 3)),
    "day, name": (rf"(\d{{1,2}}){_NTH}{_GAP}({_MONTHS})\.?{_GAP}'?(\d{{4}}|\d{{2}})", (3, 2, 1)),
    "name, day": (rf"({_MONTHS})\.?[- ]*(\d{{1,2}}){_NTH},?[- ]+(\d{{4}})", (3, 1, 2)),
    "year, name": (rf"(\d{{4}})[-/., ]*({_MONTHS})\.?[-/., ]*(\d{{1,2}}){_NTH}", (1, 2, 3)),
    "name, year": (rf"({_MONTHS})\.?[-/, ]+(\d{{4}})", (2, 1, 0)),
}
_TIME = r"(?:(?: ?t ?|,? (?:at )?)(\d{1,2}(?!\d)|\d{2})(?:(?::|(?=\d\d))(\d{1,2})(?:(?::|(?=\d\d))(\d{1,2})(?:[.,](\d{1,6})\d*)?)?)?(?: ?([ap])\.?m\.?)?)?"
_ZONE = r" ?(?:z|utc|gmt)?(?: ?([+-]\d{1,2}(?::?\d{2})?))?"
_MARK = "\x1f"
#: Two digits name years from 1969 to 2068.
PIVOT = 69


def _fields(cell: Column, shape: str) -> Column:
    """The texts of year, month, day, hour, minute, second, fraction, a or p, zone, and "?" where month and day may change places; null for a cell of another shape."""
    date, groups = _DATES[shape]
    first = sum(c == "(" and date[k + 1] != "?" for k, c in enumerate(date)) + 1
    wanted = [f"${g}" if g else "1" for g in (*groups, *range(first, first + 6))]
    parts = F.split(F.regexp_replace(cell, f"^{_WEEKDAY}{date}{_TIME}{_ZONE}$", _MARK.join([*wanted, "?" if shape == "numbers" else ""])), _MARK)
    return bound(parts, lambda p: F.when(F.size(p) == 10, p))


def moment_in(text: Column, day_first: bool = False) -> Column:
    """The moment that a cell shows, in UTC and without a zone; null if it shows none.

    Dates are year-month(-day), eight digits, three numbers, or have a month's name in any place; a
    time of day with seconds, fractions and am or pm, and a zone's offset may follow. Of three numbers the first two are
    month and day, or as ``day_first`` says; the other way where a month would be over 12.
    """
    return bound(F.lower(without_missing(text)), lambda cell: bound(_found(cell), lambda f: _assembled(f, day_first)))


def _found(cell: Column) -> Column:
    """The fields of a cell in lower case, by the first shape that fits."""
    tried = lambda *shapes: F.coalesce(*[_fields(cell, s) for s in shapes])
    named = cell.rlike(rf"(?:^|[^a-z])(?:{_MONTHS})(?:[^a-z]|$)")
    return F.when(named, tried("day, name", "name, day", "year, name", "name, year")).when(cell.rlike(r"(?:^|[a-z] )\d{4}[-/. ]"), tried("year first")).when(cell.rlike(r"\d{8}"), tried("digits")).otherwise(tried("numbers"))


def _digits(text: Column) -> Column:
    """The number of a field of digits; null for an empty one or a name, without trying: each failing try costs an exception."""
    return F.when((text >= "0") & (text < ":"), text).try_cast("int")


def _assembled(f: Column, day_first: bool) -> Column:
    text = lambda k: F.get(f, F.lit(k))
    number = lambda k: _digits(text(k))
    year = F.when(F.length(text(0)) > 2, number(0)).otherwise(number(0) + F.when(number(0) < PIVOT, 2000).otherwise(1900))
    by_name = ((F.instr(F.lit("janfebmaraprmayjunjulaugsepoctnovdec"), F.substring(text(1), 1, 3)) + 2) / 3).cast("int")
    one, two = F.coalesce(number(1), by_name), F.coalesce(number(2), F.lit(1))
    turned = (text(9) == "?") & (((two <= 12) if day_first else (one > 12)))
    hour, half = F.coalesce(number(3), F.lit(0)), text(7)
    hour = F.when(half == "", hour).when(hour.between(1, 12), hour % 12 + F.when(half == "p", 12).otherwise(0))
    seconds = F.concat(F.coalesce(number(5), F.lit(0)).cast("string"), F.lit("."), text(6), F.lit("0")).try_cast("decimal(16,6)")
    zone = F.replace(text(8), F.lit(":"), F.lit(""))
    minutes = F.coalesce(_digits(F.substring(zone, 2, 2)) * 60 + F.coalesce(_digits(F.substring(zone, 4, 2)), F.lit(0)), F.lit(0))
    made = F.try_make_timestamp_ntz(year, F.when(turned, two).otherwise(one), F.when(turned, one).otherwise(two), hour, F.coalesce(number(4), F.lit(0)), seconds)
    return made - F.make_dt_interval(mins=F.when(zone.startswith("-"), -minutes).otherwise(minutes))


def has_clock(text: Column) -> Column:
    """Whether a cell shows a time of day or a zone."""
    time = text.rlike(r"\d{1,2}:\d{2}")
    zone = text.rlike(r"(?i)(z|[+-]\d{2}:?\d{2})$") | text.rlike("(?i)utc|gmt")
    return time | (zone & text.contains("T"))


def looks_like_date(text: Column) -> Column:
    return F.length(text).between(6, 64) & (text.rlike(r"\d{1,4}[-/]\d{1,2}[-/]\d{1,4}") | text.rlike(r"\d{1,2}\s+[A-Za-z]{3,9}\s+\d{2,4}"))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two arrays of numbers; 0 where a norm is 0."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, dot(a, b) / norms).otherwise(F.lit(0.0))
