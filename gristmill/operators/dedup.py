"""Row deduplication: exact, first by key, and fuzzy within equal measures."""

from __future__ import annotations

import difflib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.names import is_identifier
from ..session import materialized
from .ordered import with_row_number
from .profile import BLOCK, ROW, col, data_columns

# Fixed values of the fuzzy rule.
LEAST_RATIO, MOST_TEXT_COLUMNS = 0.94, 8
#: Characters of the pieces by which near texts are found.
GRAM = 4


def exact_distinct(df: DataFrame) -> DataFrame:
    """Of equal rows one; where rows are numbered, the first."""
    columns = data_columns(df)
    if len(columns) == len(df.columns):
        return df.dropDuplicates()
    first = df.groupBy(*[col(c) for c in columns]).agg(F.min(F.struct(ROW, BLOCK)).alias("__first"))
    return first.select(*[col(c) for c in columns], "__first.*")


def first_by_key(df: DataFrame, keys: list[str], order_by: str) -> DataFrame:
    """Of the rows of a key, the one with the least ``order_by``; pre-aggregated, so hot keys don't gather."""
    rest = [c for c in df.columns if c not in keys]
    one = df.groupBy(*[col(k) for k in keys]).agg(F.min_by(F.struct(*[col(c) for c in rest]), col(order_by)).alias("__r"))
    return one.select(*[col(k) if k in keys else F.col("__r")[k].alias(k) for k in df.columns])


def fuzzy_distinct(df: DataFrame, order_by: list[str] | None = None, least_ratio: float = LEAST_RATIO) -> DataFrame:
    """Drop rows whose texts are nearly those of an earlier kept row with equal other columns, in tables of any size.

    Rows with equal texts and other columns leave first. Of the rest, near texts are found by
    ``near_pairs``, and a row goes when an earlier row that stays is near; rows without texts stay.
    """
    return fuzzy_report(df, order_by, least_ratio)[0]


def fuzzy_report(df: DataFrame, order_by: list[str] | None = None, least_ratio: float = LEAST_RATIO) -> tuple[DataFrame, DataFrame]:
    """The rows that ``fuzzy_distinct`` keeps, and (dropped_row, matched_row, text) of the others; rows count from 0 in their order."""
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, StringType) and not is_identifier(f.name)][:MOST_TEXT_COLUMNS]
    if not texts:
        return df, df.sparkSession.createDataFrame([], "dropped_row long, matched_row long, text string")
    others = [c for c in data_columns(df) if c not in texts]
    plain = [F.trim(F.regexp_replace(F.lower(col(c)), "[^a-z0-9]+", " ")) for c in texts]
    text = F.concat_ws(" | ", *[F.when(p != "", p) for p in plain])
    exact = F.md5(F.concat_ws("|", *[F.coalesce(F.lower(F.trim(col(c).cast("string"))), F.lit("<null>")) for c in others], F.lit("")).cast("binary"))
    rows = materialized(with_row_number(df, order_by).withColumn("__text", text).withColumn("__exact", exact))
    nodes = materialized(rows.filter("__text <> ''").groupBy("__exact", "__text").agg(F.min(ROW).alias("node")).toDF("block", "text", "node"))
    pairs = near_pairs(nodes, least_ratio)
    dropped = _after_kept(pairs)
    near = pairs.join(dropped.withColumnRenamed("node", "later"), "later", "left_semi").join(dropped.withColumnRenamed("node", "earlier"), "earlier", "left_anti")
    near = near.groupBy(F.col("later").alias("node")).agg(F.min("earlier").alias("kept"))
    # Each text's first row, and the row that stands for it.
    stands = materialized(nodes.join(near, "node", "left").select(F.col("block").alias("__exact"), F.col("text").alias("__text"), "node", F.coalesce("kept", "node").alias("kept")))
    marked = rows.join(stands, ["__exact", "__text"], "left")
    gone = marked.filter(F.col(ROW) != F.col("kept")).select(F.col(ROW).alias("dropped_row"), F.col("kept").alias("matched_row"), F.col("__text").alias("text"))
    return marked.filter((F.col(ROW) == F.col("kept")) | F.col("kept").isNull()).select(*[col(c) for c in df.columns]), gone


def near_pairs(nodes: DataFrame, least_ratio: float) -> DataFrame:
    """(later, earlier) nodes of one block whose texts reach the ratio, from (block, text, node).

    A ratio r leaves at most ``(1 - r) * (length + length)`` characters unmatched. Each of them
    changes at most GRAM grams, so of the rarest grams of either text, one more than can change, the
    two share one; texts with no more grams than can change share the empty gram. Candidates are
    verified by the matcher itself.
    """
    reach = F.floor((1 - least_ratio) * (1 + (2 - least_ratio) / least_ratio) * F.length("text") + 1e-9).cast("int") * GRAM
    grams = F.expr(f"array_distinct(transform(sequence(1, greatest(1, length(text) - {GRAM - 1})), i -> substring(text, i, {GRAM})))")
    held = nodes.withColumn("grams", grams).withColumn("reach", reach)
    places = held.select("node", "block", "reach", F.length("text").alias("length"), F.size("grams").alias("n"), F.explode("grams").alias("gram"))
    often = places.groupBy("gram").agg(F.count(F.lit(1)).alias("often"))
    order = places.join(often, "gram").groupBy("node", "block", "reach", "length", "n").agg(F.sort_array(F.collect_list(F.struct("often", "gram"))).alias("order"))
    few = F.expr("concat(transform(slice(order, 1, reach + 1), e -> e.gram), if(n <= reach, array(''), cast(array() AS array<string>)))")
    heads = materialized(order.select("node", "block", "length", F.explode(few).alias("gram")))
    a, b = (heads.select(F.col("node").alias(n), "block", "gram", F.col("length").alias(f"{n}_length")) for n in ("later", "earlier"))
    apart = F.abs(F.col("later_length") - F.col("earlier_length")) <= (1 - least_ratio) * (F.col("later_length") + F.col("earlier_length")) + 1e-9
    pairs = a.join(b, ["block", "gram"]).filter((F.col("later") > F.col("earlier")) & apart).select("later", "earlier").distinct()
    both = pairs.join(nodes.select(F.col("node").alias("later"), F.col("text").alias("a")), "later").join(nodes.select(F.col("node").alias("earlier"), F.col("text").alias("b")), "earlier")

    def verified(batches):
        for batch in batches:
            near = [_ratio(x, y, least_ratio) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield batch.select([0, 1]).filter(pa.array(near, pa.bool_()))

    return materialized(both.select("later", "earlier", "a", "b").mapInArrow(verified, "later long, earlier long"))


#: Pairs that are decided at once on the driver; with more, a round of Spark jobs first decides those that can be.
FEW_PAIRS = 200_000


def _after_kept(pairs: DataFrame) -> DataFrame:
    """The nodes with an earlier near one that stays: rounds that decide all nodes without undecided earlier ones, until few pairs are left."""
    spark = pairs.sparkSession
    dropped = spark.createDataFrame([], "node long")
    while pairs.count() > FEW_PAIRS:
        stay = pairs.select(F.col("earlier").alias("node")).distinct().join(pairs.select(F.col("later").alias("node")), "node", "left_anti")
        gone = materialized(pairs.join(stay, pairs["earlier"] == stay["node"], "left_semi").select(F.col("later").alias("node")).distinct())
        dropped = materialized(dropped.union(gone))
        for end in ("later", "earlier"):
            pairs = pairs.join(gone.withColumnRenamed("node", end), end, "left_anti")
        # What has only earlier ones that went, or none, stays and decides in the next round.
        pairs = materialized(pairs)
    rest: set[int] = set()
    for later, earlier in sorted(zip(*(c.to_pylist() for c in pairs.select("later", "earlier").toArrow().columns), strict=True)):
        if earlier not in rest:
            rest.add(later)
    return dropped.union(spark.createDataFrame([(n,) for n in sorted(rest)], "node long"))


def _ratio(a: str, b: str, least: float) -> bool:
    match = difflib.SequenceMatcher(None, a, b)
    return match.real_quick_ratio() >= least and match.quick_ratio() >= least and match.ratio() >= least
