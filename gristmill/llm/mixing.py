"""Mixing sources to target weights along a time-varying curriculum, in DataFrame operations only.

Each source has a weight that changes linearly over the training time 0 to 1. Its integral is the
source's weight in the mix; targets share all words by these weights, and stop at ``most`` times the
source's own words, with the excess reshared. A source's documents stand in a fixed random order,
repeated as often as its target asks for; the words before a document's middle, as a share of the
target, are inverted through the integrated schedule, which gives the training position at which
the source's cumulative demand reaches that document. The result is range-sorted by position.

The random order is that of a hash of id and text. Running totals inside a source come from two
levels: totals of about sqrt(rows) ranges of the random order, then the documents of one range of one
source, so that no source, however large, meets in one task. Words are counted once, and only ids,
sizes and hashes move.

Defined cases: a null text has no words and is never taken; null sources are one source, the last;
null ids are ids like others; rows that
repeat id and text stand next to each other in the order; without words all targets are 0. Extra columns are
carried when they are listed in ``carry``; one with the name of a result's column is then called
``document_<name>``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .workspace import Workspace, free_name

WORD = r"[^\x20\x09-\x0D]+"
#: Weights at the start and the end of training, dealt to sources in code point order, repeating: means 1, 2, 3.
SCHEDULES = ((0.5, 1.5), (2.0, 2.0), (4.5, 1.5))


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text.cast("string"), F.lit("")), F.lit(WORD)).cast("long")


def random_order(row_id: Column, text: Column) -> Column:
    """A hash of the id and of the text, so that rows without ids have an order, too; as hexadecimal digits."""
    bare = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return F.md5(F.concat_ws("|", bare(row_id), F.md5(bare(text).cast("binary"))).cast("binary"))


def source_targets(totals: DataFrame, schedules=SCHEDULES, most: int = 3) -> DataFrame:
    """From (source, source_size): rank, schedule (w0, w1, w) and target. One row a source in and out.

    A cap holds where ``most * size <= weight * level``; sources by cap per weight, the level after
    capping all before is what is left of the words by what is left of the weights.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = totals.withColumn("rank", F.row_number().over(by_name))
    for name, pick in (("w0", lambda s: s[0]), ("w1", lambda s: s[1]), ("w", lambda s: (s[0] + s[1]) / 2)):
        ranked = ranked.withColumn(name, F.element_at(F.array(*[F.lit(float(pick(s))) for s in schedules]), (F.col("rank") - 1) % len(schedules) + 1))
    ranked = ranked.withColumn("cap", most * F.col("source_size"))
    by_cap = Window.orderBy(F.col("cap") / F.col("w"), "rank")
    before, whole = by_cap.rowsBetween(Window.unboundedPreceding, -1), by_cap.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    weight = F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    levels = ranked.withColumn("level", left / weight)
    free = F.when(F.col("cap") > F.col("w") * F.col("level"), F.col("level"))
    levels = levels.withColumn("free_level", F.first(free, ignorenulls=True).over(whole))
    return levels.withColumn("target", F.coalesce(F.least(F.col("cap").cast("double"), F.col("w") * F.col("free_level")), F.lit(0.0))).select("source", "rank", "source_size", "w0", "w1", "w", "target")


def curriculum_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", *, schedules=SCHEDULES, most: int = 3, carry: tuple[str, ...] = (), every_copy: bool = False) -> DataFrame:
    """One row per input row: id, size, source_size, target, taken, copies, position, positions; and the columns of ``carry``.

    ``taken`` counts the words the mix takes of the document, repeats counted; the last document
    that a target reaches may be cut. ``position`` (0 to 1) is that of its first copy, null where
    none is taken, and ``positions`` lists those of all copies; rows are in the order of position,
    those without last. With ``every_copy`` each copy has a row instead, in the order of training:
    ``position`` is the copy's, ``copy`` (from 1) its turn and ``copy_taken`` its words; documents of
    which nothing is taken have none.
    """
    if any(min(a, b) < 0 or a + b <= 0 for a, b in schedules):
        raise ValueError("weights must not be negative, nor always 0")
    work = Workspace(docs.sparkSession)
    ranges = max(1, math.isqrt(docs.count()))
    held = {c: free_name(["id", "source", "size", "order", "range", "rank", *carry], f"carried_{k}") for k, c in enumerate(carry)}
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), random_order(F.col(id_col), F.col(text_col)).alias("order"), *[F.col(c).alias(h) for c, h in held.items()])
    rows = rows.withColumn("range", F.floor(F.conv(F.substring("order", 1, 8), 16, 10).cast("long") * F.lit(ranges) / F.lit(float(1 << 32))).cast("long"))

    rows = work.table(rows, "rows")  # words are counted once

    parts = work.table(rows.groupBy("source", "range").agg(F.sum("size").alias("words")), "parts")
    sources = work.table(source_targets(parts.groupBy("source").agg(F.sum("words").alias("source_size")), schedules, most), "sources")
    earlier = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = work.table(parts.select(F.col("source").alias("of"), F.col("range").alias("at"), F.coalesce(F.sum("words").over(earlier), F.lit(0).cast("long")).alias("start")), "starts")

    inside = Window.partitionBy("source", "range").orderBy("order", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    told = sources.withColumnRenamed("source", "named")
    placed = (
        rows.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0).cast("long")))
        .join(starts, F.col("source").eqNullSafe(F.col("of")) & (F.col("range") == F.col("at")))
        .withColumn("before", F.col("start") + F.col("inside"))
        .join(told, F.col("source").eqNullSafe(F.col("named")))
    )
    wanted = F.floor("target").cast("long")
    taken = lambda turn: F.least(F.greatest(wanted - turn * F.col("source_size") - F.col("before"), F.lit(0).cast("long")), F.col("size"))
    each = [taken(turn) for turn in range(most)]
    placed = placed.withColumn("taken", sum(each[1:], each[0]))
    placed = placed.withColumn("copies", sum([(x > 0).cast("int") for x in each[1:]], (each[0] > 0).cast("int")))
    # Later copies follow whole passes over the source; a document without a first copy has no other.
    where = lambda turn: F.when(taken(turn) > 0, schedule_position((F.col("before") + turn * F.col("source_size") + taken(turn) / 2) / F.col("target")))
    turns = [F.struct(F.lit(turn + 1).alias("copy"), words.alias("copy_taken"), where(turn).alias("position")) for turn, words in enumerate(each)]
    placed = placed.withColumn("turns", F.filter(F.array(*turns), lambda t: t["copy_taken"] > 0))
    placed = placed.withColumn("positions", F.col("turns.position"))
    results = ["size", "source_size", "target", "taken", "copies", "position", "positions"]
    if every_copy:
        placed = placed.select("*", F.explode("turns").alias("turn")).select("*", "turn.*")
        results += ["copy", "copy_taken"]
    else:
        placed = placed.withColumn("position", F.get("positions", F.lit(0)))
    taken_names = [id_col, *results]
    called = {c: free_name([*taken_names, *carry], f"document_{c}") if c.lower() in [n.lower() for n in taken_names] else c for c in carry}
    placed = placed.orderBy(F.col("position").asc_nulls_last(), "order", *(["copy"] if every_copy else []))
    work.keep("rows", "starts", "sources")
    return placed.select(F.col("id").alias(id_col), *[F.col(h).alias(called[c]) for c, h in held.items() if c != id_col], *results)


def schedule_position(share: Column) -> Column:
    """The time at which the integral of w0 + (w1 - w0) t reaches ``share`` of its whole."""
    due = F.col("w") * share
    return F.when(due > 0, 2 * due / (F.col("w0") + F.sqrt(F.col("w0") * F.col("w0") + 2 * (F.col("w1") - F.col("w0")) * due))).otherwise(F.lit(0.0))
