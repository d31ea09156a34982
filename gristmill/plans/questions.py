"""Questions about teams and their results: slots for columns, resolved by names and kinds, compiled to ranked tables.

A question asks for goals (a ranking of teams by a measure) or for performance (win rate, then mean
difference). Each needs some slots; a slot takes the first of its names that a column of the right kind has,
then the first that a column's name contains, and never a column that another slot has taken.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..functions.names import humanize
from ..operators import ranking
from ..operators.profile import columns_of

# The names of slots, in the order in which they are tried, and the words of the two kinds of questions.
TEAMS = ("team", "team_name", "player_team", "club", "club_name", "squad", "squad_name", "country", "team_country", "nation", "national_team")
GOALS_FOR = ("goals_team", "team_goals", "goals_for", "goals_scored", "gf")
GOALS_AGAINST = ("goals_opponent", "opponent_goals", "goals_against", "goals_conceded", "ga")
OWN_GOALS = ("goals", "player_goals")
RESULTS = ("match_result", "result", "outcome")
TEAM_WORDS = ("team", "club", "squad")
COMPARING = ("better", "best", "top", "rank", "ranking", "performed", "performance", "winner", "strongest")
GOAL_WORDS = ("goal", "goals", "scored")
SHOWING = ("top", "rank", "ranking", "highest", "show", "chart", "bar", "visual")
#: Words of our own that ask for performance, too.
RATES = ("win rate", "goal difference", "record")


@dataclass(frozen=True)
class Slot:
    names: tuple[str, ...]
    numeric: bool | None  # None: either
    contained: bool = True


SLOTS = {"team": Slot(TEAMS, False), "scored": Slot(GOALS_FOR, True), "conceded": Slot(GOALS_AGAINST, True), "own": Slot(OWN_GOALS, True, contained=False), "result": Slot(RESULTS, None)}


def plain(name: str) -> str:
    return "_".join(re.findall(r"[a-z0-9]+", name.lower()))


def resolved(df: DataFrame) -> dict[str, str]:
    """Column by slot, for the slots that some column fits."""
    numeric, found = set(columns_of(df, "numeric")), {}
    for key, slot in SLOTS.items():
        fits = {c: plain(c) for c in df.columns if c not in found.values() and slot.numeric in (None, c in numeric)}
        tests = [lambda name, wanted: name == wanted, *([lambda name, wanted: wanted in name] if slot.contained else [])]
        hit = next((c for test in tests for wanted in slot.names for c, name in fits.items() if test(name, wanted)), None)
        if hit is not None:
            found[key] = hit
    return found


def asked_for(question: str) -> str | None:
    """"goals", "performance" or None."""
    low = question.lower()
    says = lambda words: any(w in low for w in words)
    if says(TEAM_WORDS):
        if says(GOAL_WORDS) and says(SHOWING) and not says(RATES):
            return "goals"
        if says(COMPARING) or says(RATES):
            return "performance"
    return None


def basis(slots: dict[str, str]) -> str:
    """What the ranking goes by, in words."""
    both = "scored" in slots and "conceded" in slots
    if "result" in slots:
        return "win rate, then mean goal difference" if both else "win rate"
    return "mean goal difference" if both else f"total {humanize(slots['own'])}" if "own" in slots else "number of rows"


def team_answer(df: DataFrame, question: str) -> dict | None:
    """A text, a table and, for goals, a bar chart; the text says what is missing where a slot has no column. None for other questions."""
    kind = asked_for(question)
    if kind is None:
        return None
    slots = resolved(df)
    measure = slots.get("scored") or slots.get("own")
    if kind == "performance" and not slots.keys() - {"team"}:
        return None  # a plain ranking, if anything
    missing = [text for held, text in (("team" in slots, "a column that names the team"), (kind != "goals" or measure, "a column of goals")) if not held]
    if missing:
        return {"kind": kind, "text": f"This can't be answered: {' and '.join(missing)} is missing.", "table": None, "chart": None}
    if kind == "goals":
        table = ranking.top_groups(df, slots["team"], measure)
        rows = [r.asDict() for r in table.collect()]
        text = f"Top {humanize(slots['team'])} by {humanize(measure)}: " + ", ".join(f"{r['label']} ({r['total']:,.0f})" for r in rows if r["total"] is not None)
        chart = {"id": "answer", "type": "bar", "x": slots["team"], "measures": [measure], "title": f"{humanize(measure)} by {humanize(slots['team'])}", "rows": rows}
        return {"kind": kind, "text": text, "table": table, "chart": chart}
    table = ranking.performance(df, slots["team"], slots.get("scored"), slots.get("conceded"), slots.get("result"), own=slots.get("own"), inside=ranking.INSIDE)
    return {"kind": kind, "text": f"Ranked by {basis(slots)}: " + "; ".join(_line(r.asDict()) for r in table.collect()), "table": table, "chart": None}


def _line(r: dict) -> str:
    parts = [f"{r['label']}, {r['row_count']} rows"]
    if r["win_rate"] is not None:
        parts.append(f"win rate {r['win_rate']:.1f}%, {r['wins']}-{r['draws']}-{r['losses']}")
    parts += [f"{words} {r[c]:.2f}" for c, words in (("avg_difference", "mean difference"), ("avg_for", "mean for"), ("avg_against", "mean against"), ("total_own", "total of players")) if r[c] is not None]
    return ", ".join(parts)
