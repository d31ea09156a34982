"""Connected components of an edge table, by least labels and pointer jumps over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import Workspace

COPIES = 32


def components(work: Workspace, edges: DataFrame, name: str) -> DataFrame:
    """``(v, root)`` for each vertex of ``edges`` (a, b; both long): root is the least vertex it reaches.

    Each step takes the least label among a vertex and its neighbours, then the label of that label,
    so that the distance that labels travel doubles; a step's labels are written, which cuts lineage.
    """
    links = work.table(edges.select("a", "b").union(edges.select("b", "a")).distinct(), f"{name}-links")
    labels = work.table(links.groupBy(F.col("a").alias("v")).agg(F.least(F.col("a"), F.min("b")).alias("root")), f"{name}-0")
    step = 0
    while True:
        step += 1
        heard = links.join(labels, links["b"] == labels["v"]).groupBy(links["a"].alias("v")).agg(F.min("root").alias("near"))
        least = labels.join(heard, "v", "left").select("v", "root", F.least("root", "near").alias("now"))
        # A label that many vertices have stands in COPIES copies, so that these vertices don't meet in one task.
        held = least.select(F.col("now").alias("at")).distinct()
        jump = held.join(least.select(F.col("v").alias("at"), F.col("now").alias("beyond")), "at").withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(COPIES - 1))))
        spread = least.withColumn("part", F.pmod(F.xxhash64("v"), F.lit(COPIES)).cast("int"))
        after = spread.join(jump, (spread["now"] == jump["at"]) & (spread["part"] == jump["copy"]), "left").select("v", F.col("root").alias("was"), F.least("now", "beyond").alias("root"))
        after = work.table(after, f"{name}-{step}")
        done = after.filter("root <> was").isEmpty()
        work.drop(f"{name}-{step - 1}")
        labels = after.select("v", "root")
        if done:
            work.drop(f"{name}-links")
            return labels
