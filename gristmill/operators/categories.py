"""Category spellings: values with one key, or near vectors, become one canonical value.

Keys, groups and canonical values are columns and aggregates; the mapping (column_name, value,
canonical) is a table that is joined to the rows, so its size doesn't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.names import standard_name
from ..functions.text import CATEGORY_ALIASES, cosine
from ..session import materialized
from .profile import col, missing_and_distinct, value_counts

# Which columns are looked at, how near vectors must be, and the lengths of a category.
MOST_VALUES, LEAST_COSINE = 80, 0.91
SKIPPED_NAME_WORDS = ("description", "summary", "email", "phone")
LENGTHS = (2, 80)
#: Rows of a mapping up to which it is broadcast.
BROADCAST_ROWS = 10_000


def category_key(text: Column) -> Column:
    """What spellings of one category have in common: an alias's name, else the letters and digits alone."""
    joined = F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))
    aliases = F.create_map(*[F.lit(x) for pair in CATEGORY_ALIASES.items() for x in pair])
    return F.coalesce(*[F.try_element_at(aliases, F.replace(joined, F.lit(" "), F.lit(by))) for by in ("_", "")], F.replace(joined, F.lit(" "), F.lit("")))


def is_category(text: Column) -> Column:
    """Of a category's length, and neither a number nor a date."""
    return F.length(text).between(*LENGTHS) & ~text.rlike(r"^([-+]?\d+(\.\d+)?|\d{4}[-/]\d{1,2}[-/]\d{1,2})$")


def candidate_columns(df: DataFrame, most: int | None = None) -> list[str]:
    """Text columns with few values whose names tell of no identifiers or prose; the first ``most`` of them, if given."""
    def named(c: str) -> bool:
        name = standard_name(c).replace("_", "")
        return not name.endswith("id") and not any(w in name for w in SKIPPED_NAME_WORDS)

    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, StringType) and named(f.name)]
    if not texts:
        return []
    few = {r.column_name for r in missing_and_distinct(df, texts).filter(F.expr(f"distinct_count + int(missing > 0) BETWEEN 2 AND {MOST_VALUES}")).collect()}
    return [c for c in texts if c in few][:most]


def near_keys(vectors: DataFrame, keys: DataFrame, least: float = LEAST_COSINE) -> dict[str, str]:
    """Key to key for labels (label, vector) whose vectors are near: all of a group to its least key.

    Only labels with a key of ``keys`` (key) are compared, which are those of columns of at most MOST_VALUES values each.
    """
    keyed = vectors.select(category_key(F.trim("label")).alias("key"), "vector").join(keys, "key", "left_semi")
    keyed = materialized(keyed.groupBy("key").agg(F.min("vector").alias("vector")))
    a, b = keyed.toDF("a", "u"), keyed.toDF("b", "v")
    root: dict[str, str] = {}
    for r in a.join(F.broadcast(b), F.col("a") < F.col("b")).filter(cosine(F.col("u"), F.col("v")) >= least).select("a", "b").distinct().collect():
        x, y = root.get(r.a, r.a), root.get(r.b, r.b)
        root |= {k: min(x, y) for k in [r.a, r.b, *[k for k, v in root.items() if v in (x, y)]]}
    return root


def spellings(df: DataFrame, columns: list[str], vectors: DataFrame | None = None) -> DataFrame:
    """(column_name, value, canonical, rows) of the values that change.

    Groups are values with one key, or keys with near ``vectors``. An alias names its group; else
    its commonest value does, of equal ones one with a space, then the longest, then the first.
    """
    counts = value_counts(df.select(*[F.trim(col(c)).alias(c) for c in columns]), columns).filter(is_category(F.col("value")))
    counts = counts.withColumn("own", category_key(F.col("value")))
    near = near_keys(vectors, counts.select(F.col("own").alias("key")).distinct()) if vectors is not None else {}
    merged = F.try_element_at(F.create_map(*[F.lit(x) for pair in near.items() for x in pair]), F.col("own")) if near else F.lit(None).cast("string")
    counts = counts.withColumn("key", F.coalesce(merged, "own"))
    best = F.struct((-F.col("count")).alias("a"), (~F.col("value").contains(" ")).alias("b"), (-F.length("value")).alias("c"), "value")
    alias = F.min(F.when(F.col("own").isin(*sorted(set(CATEGORY_ALIASES.values()))), F.col("own")))
    groups = counts.groupBy("column_name", "key").agg(F.count(F.lit(1)).alias("members"), F.coalesce(alias, F.min_by("value", best)).alias("canonical"))
    return counts.join(groups.filter("members > 1"), ["column_name", "key"]).filter("value <> canonical").select("column_name", "value", "canonical", F.col("count").alias("rows"))


def canonical_categories(df: DataFrame, columns: list[str] | None = None, vectors: DataFrame | None = None, *, most_columns: int | None = None, most_changed: int | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Rewrite the spellings of category columns; also the mapping (see ``spellings``), None without category columns.

    ``most_columns`` and ``most_changed`` limit how many columns are looked at and changed, in the
    order of the table; without them all are.
    """
    columns = columns if columns is not None else candidate_columns(df, most_columns)
    if not columns:
        return df, None
    mapping = materialized(spellings(df, columns, vectors))
    sizes = {r.column_name: r["count"] for r in mapping.groupBy("column_name").count().collect()}
    changed = [c for c in columns if c in sizes][:most_changed]
    mapping, names = mapping.filter(F.col("column_name").isin(changed)), df.columns
    for c in changed:
        own = mapping.filter(F.col("column_name") == c).select(F.col("value").alias("__spelling"), F.col("canonical").alias("__canonical"))
        own = F.broadcast(own) if sizes[c] <= BROADCAST_ROWS else own
        df = df.join(own, F.trim(col(c)) == F.col("__spelling"), "left").withColumn(c, F.coalesce("__canonical", col(c))).drop("__spelling", "__canonical")
    return df.select(*[col(n) for n in names]), mapping
