"""Ranked answers: top groups by a measure, and performance of groups by outcomes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .profile import col

# Texts that mean an outcome, and how many groups are listed.
WINS, DRAWS, LOSSES = ("w", "win", "won", "3", "victory"), ("d", "draw", "drawn", "1", "tie"), ("l", "loss", "lost", "0", "defeat")
INSIDE = (("win",), ("draw",), ("loss", "lost"))  # words that mean a win, a draw or a loss wherever they stand
TOP_GROUPS, TOP_PERFORMERS = 5, 10


def top_groups(df: DataFrame, group: str, measure: str, most: int = TOP_GROUPS, lowest: bool = False) -> DataFrame:
    """(label, total): groups with the greatest sums, or the ``lowest``; nulls last, ties by label."""
    sums = df.filter(col(group).isNotNull()).groupBy(col(group).cast("string").alias("label")).agg(F.sum(col(measure).cast("double")).alias("total"))
    return sums.orderBy(F.col("total").asc_nulls_last() if lowest else F.col("total").desc_nulls_last(), "label").limit(most)


def performance(
    df: DataFrame, group: str, scored: str | None, conceded: str | None, result: str | Column | None, wins=WINS, draws=DRAWS, losses=LOSSES, most: int = TOP_PERFORMERS,
    *, own: str | None = None, inside: tuple[tuple[str, ...], ...] = ((), (), ()),
) -> DataFrame:
    """Groups by win rate, then mean difference (without one, the total of ``own``), then rows: counts, sums, means, outcomes.

    What has no column is null and doesn't order. An outcome is one of the given texts, or has one of the words of ``inside``.
    """
    none = F.lit(None).cast("double")
    a, b, c = (col(x).cast("double") if x else none for x in (scored, conceded, own))
    rows = df.filter(col(group).isNotNull())
    if result is None:
        won = drawn = lost = F.lit(None).cast("int")
    else:
        outcome = F.lower(F.trim((col(result) if isinstance(result, str) else result).cast("string")))
        hits = [F.coalesce(reduce(lambda x, w: x | outcome.contains(w), words, outcome.isin(*texts)), F.lit(False)) for texts, words in zip((wins, draws, losses), inside, strict=True)]
        won, drawn, lost = (F.when(h, 1).otherwise(0) for h in hits)
    out = rows.groupBy(col(group).cast("string").alias("label")).agg(
        F.count(F.lit(1)).alias("row_count"), F.round(F.avg(a), 4).alias("avg_for"), F.round(F.sum(a), 2).alias("total_for"), F.round(F.avg(b), 4).alias("avg_against"), F.round(F.sum(b), 2).alias("total_against"),
        F.round(F.avg(a - b), 4).alias("avg_difference"), *([F.round(F.sum(c), 2).alias("total_own")] if own or inside != ((), (), ()) else []), F.sum(won).alias("wins"), F.sum(drawn).alias("draws"), F.sum(lost).alias("losses"), F.round(F.avg(won) * 100, 4).alias("win_rate"),
    )
    keys = ["win_rate", "avg_difference", *(["total_own"] if own and not (scored and conceded) else [])]
    return out.orderBy(*[F.col(k).desc_nulls_last() for k in keys], F.col("row_count").desc(), "label").limit(most)
