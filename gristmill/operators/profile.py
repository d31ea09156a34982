"""Column profiles: counts, moments, exact quantiles, date ranges, distinct and top values, correlations.

All columns of a kind share a job. Quantiles are exact without gathering a column: sketches bracket
each wanted rank and are narrowed until a bounded number of distinct values is left to rank.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, NumericType, TimestampNTZType, TimestampType

# What a profile lists of a column, and which correlations.
TOP_VALUES, TOP_VALUES_UP_TO, LEAST_CORRELATION = 10, 50, 0.3
#: Pairs of columns in one aggregate: the code of a larger one is too long for the JVM to compile.
PAIRS_AT_ONCE = 4
#: Share of a column's squares that must be left as spread around the mean, and bounds of the spread, for a correlation from sums.
LEAST_SPREAD, LEAST_SQUARES = 1e-6, 1e-200


#: Columns that carry the row order through a chain of steps; no step takes them for data.
BLOCK, ROW = "__block", "__row"


def data_columns(df: DataFrame) -> list[str]:
    """All columns but those of the row order."""
    return [c for c in df.columns if c not in (BLOCK, ROW)]


def columns_of(df: DataFrame, kind: str) -> list[str]:
    """Names of the "numeric", "temporal" or "categorical" (other) columns, in order."""
    temporal = (DateType, TimestampType, TimestampNTZType)
    return [f.name for f in df.schema.fields if f.name not in (BLOCK, ROW) and kind == ("numeric" if isinstance(f.dataType, NumericType) else "temporal" if isinstance(f.dataType, temporal) else "categorical")]


def col(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def as_rows(one: DataFrame, structs: list[str]) -> DataFrame:
    """A one-row frame of equal structs as one row each."""
    return one.select(F.explode(F.array(*[F.col(s) for s in structs])).alias("r")).select("r.*")


#: Accuracy of the sketches that bracket ranks, and values in all brackets that are ranked at last.
ACCURACY, MOST_RANKED = 1_000, 200_000


def exact_quantiles(df: DataFrame, columns: list[str], probabilities: tuple[float, ...], nearest: bool = False) -> dict[str, list[float | None]]:
    """Exact quantiles of each column: interpolated between ranks, or of the nearest rank (halves to even).

    One sketch a column brackets all its ranks. Passes over the table count what lies below a bracket, at
    its two ends and between them. A rank at an end, or next to one, is known, however many values
    share the end; brackets of other ranks are narrowed by sketches of what lies between, until at most MOST_RANKED
    values are left between all of them, which are ranked at last.
    """
    columns = list(dict.fromkeys(columns))
    if not columns or not probabilities:
        return {c: [] for c in columns}
    value, margin = {c: col(c).cast("double") for c in columns}, 2 / ACCURACY
    sides = [x for p in probabilities for x in (max(0.0, p - margin), min(1.0, p + margin))]
    row = df.agg(*[F.struct(F.count(value[c]).alias("n"), F.min(value[c]).alias("low"), F.max(value[c]).alias("high"), F.percentile_approx(value[c], sides, ACCURACY).alias("sides")).alias(f"c{i}") for i, c in enumerate(columns)]).first()
    facts = {c: row[f"c{i}"] for i, c in enumerate(columns)}
    ranks, brackets, known = {}, {}, {}
    for c in columns:
        for k, p in enumerate(probabilities):
            if facts[c]["n"]:
                at = (facts[c]["n"] - 1) * p
                ranks[c, k] = (round(at),) * 2 if nearest else (math.floor(at), math.ceil(at))
                brackets[c, k] = tuple(facts[c]["sides"][2 * k : 2 * k + 2])
    while brackets:
        keys = list(brackets)
        between = {(c, k): F.when((value[c] > brackets[c, k][0]) & (value[c] < brackets[c, k][1]), value[c]) for c, k in keys}

        def numbers(key: tuple[str, int]) -> Column:
            v, (low, high), open_ = value[key[0]], brackets[key], between[key]
            return F.struct(F.count_if(v < low).alias("below"), F.count_if(v == low).alias("at_low"), F.count(open_).alias("inside"), F.min(open_).alias("least"), F.max(open_).alias("most"), F.count_if(v <= high).alias("up_to"))

        counts = df.agg(*[numbers(key).alias(f"k{i}") for i, key in enumerate(keys)]).first()
        open_keys: dict[tuple[str, int], tuple] = {}
        for i, key in enumerate(keys):
            found, (low, high) = counts[f"k{i}"], brackets.pop(key)
            first = found["below"] + found["at_low"]
            missed, narrow = [], []
            for side, rank in enumerate(ranks[key]):
                if (key, side) in known:
                    continue
                if rank < found["below"] or rank >= found["up_to"]:  # the sketch was off
                    missed += [(facts[key[0]]["low"], low)] if rank < found["below"] else [(high, facts[key[0]]["high"])]
                elif rank < first:
                    known[key, side] = low
                elif rank >= first + found["inside"]:
                    known[key, side] = high
                elif rank in (first, first + found["inside"] - 1):
                    known[key, side] = found["least"] if rank == first else found["most"]
                else:
                    narrow.append((rank - first) / found["inside"])
            if missed:
                brackets[key] = min([m[0] for m in missed] + [low] * bool(narrow)), max([m[1] for m in missed] + [high] * bool(narrow))
            elif narrow:
                open_keys[key] = (low, high, found["inside"], first, narrow)
        if not open_keys:
            continue
        if brackets or sum(x[2] for x in open_keys.values()) > MOST_RANKED:
            inside = {key: between[key] for key in open_keys}
            shares = {key: [max(0.0, min(x[4]) - margin), min(1.0, max(x[4]) + margin)] for key, x in open_keys.items()}
            row = df.agg(*[F.percentile_approx(inside[key], shares[key], ACCURACY).alias(f"k{i}") for i, key in enumerate(open_keys)]).first()
            brackets |= {key: tuple(row[f"k{i}"]) for i, key in enumerate(open_keys)}
            continue
        each = [F.when(between[key].isNotNull(), F.struct(F.lit(i).alias("i"), value[key[0]].alias("v"))) for i, key in enumerate(open_keys)]
        some = reduce(lambda a, b: a | b, [between[key].isNotNull() for key in open_keys])
        grouped = df.filter(some).select(F.explode(F.array_compact(F.array(*each))).alias("e")).groupBy("e.i", "e.v").agg(F.count(F.lit(1)).alias("n"))
        left, last = list(open_keys), {}
        for r in grouped.orderBy("i", "v").toLocalIterator():  # MOST_RANKED rows
            key = left[r["i"]]
            low = last.get(key, open_keys[key][3])
            last[key] = low + r["n"]
            for side, rank in enumerate(ranks[key]):
                if low <= rank < last[key]:
                    known[key, side] = r["v"]
    out: dict[str, list[float | None]] = {}
    for c in columns:
        out[c] = []
        for k, p in enumerate(probabilities):
            if (c, k) not in ranks:
                out[c].append(None)
                continue
            a, b = known[(c, k), 0], known[(c, k), 1]
            out[c].append(a if a == b else a + (b - a) * ((facts[c]["n"] - 1) * p - ranks[c, k][0]))
    return out


def numeric_profile(df: DataFrame, columns: list[str] | None = None, most: int | None = None) -> DataFrame:
    """(column_name, count, null_count, min, max, mean, std, p25, p50, p75, total), a row a numeric column."""
    columns = (columns or columns_of(df, "numeric"))[:most]
    quantiles = exact_quantiles(df, columns, (0.25, 0.5, 0.75))

    def one(c: str) -> Column:
        v = col(c).cast("double")
        parts = [F.lit(c).alias("column_name"), F.count(v).alias("count"), F.count_if(v.isNull()).alias("null_count"), (F.min(v) + 0.0).alias("min"), (F.max(v) + 0.0).alias("max"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std")]
        parts += [F.lit(q).cast("double").alias(n) for q, n in zip(quantiles[c], ("p25", "p50", "p75"), strict=True)]
        return F.struct(*parts, F.sum(v).alias("total"))

    return as_rows(df.agg(*[one(c).alias(f"c{i}") for i, c in enumerate(columns)]), [f"c{i}" for i in range(len(columns))])


def date_range_profile(df: DataFrame, columns: list[str] | None = None, most: int | None = None) -> DataFrame:
    """(column_name, min_date, max_date), a row a temporal column."""
    columns = (columns or columns_of(df, "temporal"))[:most]
    parts = [F.struct(F.lit(c).alias("column_name"), F.min(col(c)).cast("timestamp_ntz").alias("min_date"), F.max(col(c)).cast("timestamp_ntz").alias("max_date")).alias(f"c{i}") for i, c in enumerate(columns)]
    return as_rows(df.agg(*parts), [f"c{i}" for i in range(len(columns))])


def missing_and_distinct(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column_name, row_count, missing, distinct_count) of every column; distinct values don't count null.

    Values are made distinct per column first, in as many tasks as there are values to share, so that
    no single task gathers a column.
    """
    columns = columns or df.columns
    missing = as_rows(df.agg(*[F.struct(F.lit(c).alias("column_name"), F.count(F.lit(1)).alias("row_count"), F.count_if(col(c).isNull()).alias("missing")).alias(f"c{i}") for i, c in enumerate(columns)]), [f"c{i}" for i in range(len(columns))])
    digest = F.md5(F.col("value").cast("binary")).alias("value")  # whole texts needn't move
    values = values_by_column(df, columns).select("column_name", digest).groupBy("column_name", "value").agg(F.lit(1).alias("one"))
    distinct = values.groupBy("column_name").agg(F.count("one").alias("distinct_count"))
    return missing.join(distinct, "column_name", "left").withColumn("distinct_count", F.coalesce("distinct_count", F.lit(0).cast("long")))


def values_by_column(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, value as text) of every non-null cell."""
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), col(c).cast("string").alias("value")) for c in columns])
    return df.select(F.explode(cells).alias("e")).select("e.*").filter("value IS NOT NULL")


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    return values_by_column(df, columns).groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("count"))


def top_values(df: DataFrame, columns: list[str] | None = None, top: int = TOP_VALUES, up_to: int = TOP_VALUES_UP_TO, most: int | None = None, distinct: dict[str, int] | None = None) -> DataFrame:
    """(column_name, value, count, place) of columns with at most ``up_to`` distinct values (counted here unless given); ties by value."""
    columns = (columns or columns_of(df, "categorical"))[:most]
    if distinct is None:
        distinct = {r.column_name: r.distinct_count for r in missing_and_distinct(df, columns).collect()}
    few = [c for c in columns if 1 <= distinct[c] <= up_to]
    counts = value_counts(df, few) if few else value_counts(df, columns).limit(0)
    place = F.row_number().over(Window.partitionBy("column_name").orderBy(F.col("count").desc(), "value"))
    return counts.withColumn("place", place).filter(F.col("place") <= top)


def _pair_sums(columns: list[str], shifts: list[float]):
    """Of a task's rows, for every two columns: rows with both values, and the sums of shifted values, squares and products over these rows."""
    import numpy as np
    import pyarrow as pa

    first, second = np.triu_indices(len(columns), 1)

    def sums(batches):
        total = np.zeros((6, len(first)))
        for batch in batches:
            held = np.array([c.is_valid().to_numpy(zero_copy_only=False) for c in batch.columns], np.float64)
            with np.errstate(all="ignore"):  # what isn't finite is told by its sums
                x = np.array([c.fill_null(s).to_numpy(zero_copy_only=False) - s for c, s in zip(batch.columns, shifts, strict=True)])
                one, two, both = x @ held.T, (x * x) @ held.T, x @ x.T
            parts = ((held @ held.T)[first, second], one[first, second], one[second, first], two[first, second], two[second, first], both[first, second])
            total += np.array(parts)
        yield pa.RecordBatch.from_arrays([pa.array(first.astype(np.int32)), pa.array(second.astype(np.int32)), *map(pa.array, total)], ["a", "b", "n", "x", "y", "xx", "yy", "xy"])

    return sums


def _plain_correlations(df: DataFrame, pairs: list[tuple[str, str]]) -> dict[tuple[str, str], float | None]:
    """Correlations by Spark's own moments, PAIRS_AT_ONCE in one aggregate; None for constant columns."""

    def one(a: str, b: str) -> Column:
        both = col(a).isNotNull() & col(b).isNotNull()
        x, y = F.when(both, col(a).cast("double")), F.when(both, col(b).cast("double"))
        spread = F.stddev_pop(x) * F.stddev_pop(y)
        return F.when(spread > 0, F.covar_pop(x, y) / spread)

    out: dict[tuple[str, str], float | None] = {}
    for k in range(0, len(pairs), PAIRS_AT_ONCE):
        part = pairs[k : k + PAIRS_AT_ONCE]
        out |= dict(zip(part, df.agg(*[one(a, b).alias(f"c{i}") for i, (a, b) in enumerate(part)]).first(), strict=True))
    return out


def correlation_pairs(df: DataFrame, columns: list[str] | None = None, least: float = LEAST_CORRELATION, most: int | None = None) -> DataFrame:
    """(left_column, right_column, correlation) where its size exceeds ``least``; constant columns have none.

    Each task multiplies its batches' values, shifted by the columns' means, as matrices, and Spark adds
    the sums of each pair. Pairs whose sums aren't finite, or leave few digits as a column hardly varies
    where both have values, are computed again by Spark's own moments.
    """
    columns = (columns or columns_of(df, "numeric"))[:most]
    result = "left_column string, right_column string, correlation double"
    if len(columns) < 2:
        return df.sparkSession.createDataFrame([], result)
    values = df.select(*[col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)])
    means = values.agg(*[F.avg(f"c{i}") for i in range(len(columns))]).first()
    shifts = [m if m is not None and math.isfinite(m) else 0.0 for m in means]
    sums = values.mapInArrow(_pair_sums(columns, shifts), "a int, b int, " + ", ".join(f"{c} double" for c in ("n", "x", "y", "xx", "yy", "xy")))
    found, again = {}, []
    for r in sums.groupBy("a", "b").agg(*[F.sum(c).alias(c) for c in ("n", "x", "y", "xx", "yy", "xy")]).collect():  # a row a pair
        pair = columns[r.a], columns[r.b]
        if not r.n:
            continue
        left, right = r.xx - r.x * r.x / r.n, r.yy - r.y * r.y / r.n
        if not all(map(math.isfinite, r)) or left <= LEAST_SPREAD * r.xx or right <= LEAST_SPREAD * r.yy or not LEAST_SQUARES < min(left, right) <= max(left, right) < 1 / LEAST_SQUARES:
            again.append(pair)
        else:
            found[pair] = (r.xy - r.x * r.y / r.n) / math.sqrt(left) / math.sqrt(right)
    found |= _plain_correlations(df, again)
    order = {c: i for i, c in enumerate(columns)}
    rows = [(a, b, found[a, b]) for a, b in sorted(found, key=lambda p: (order[p[0]], order[p[1]])) if found[a, b] is not None]
    return df.sparkSession.createDataFrame(rows, result).withColumn("correlation", F.round("correlation", 3)).filter(F.abs("correlation") > least)


def first_values(df: DataFrame, samples: int) -> DataFrame:
    """(column_name, sample_values): the first values of each column that aren't null, as texts, in the order of the rows.

    One pass for all columns: a task sends on the first values of each split it reads, a bounded number,
    and of these the first in the order of files and splits count.
    """
    import pyarrow as pa

    from .ordered import source_place

    columns = data_columns(df)
    file, start = source_place(df)
    cells = df.select(file.alias("__file"), start.alias("__start"), F.spark_partition_id().alias("__part"), *[col(c).cast("string").alias(f"c{i}") for i, c in enumerate(columns)])

    def firsts(batches):
        found: dict[tuple, list[list[str]]] = {}  # of one task
        for batch in batches:
            places = list(zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True))
            cuts = [k for k in range(len(places)) if k == 0 or places[k] != places[k - 1]]
            for low, high in zip(cuts, [*cuts[1:], len(places)], strict=True):
                held = found.setdefault(places[low], [[] for _ in columns])
                for values, column in zip(held, batch.columns[3:], strict=True):
                    if len(values) < samples:
                        values += column.slice(low, high - low).drop_null().slice(0, samples - len(values)).to_pylist()
        rows = [(*place, k, c, v) for place, held in found.items() for c, values in zip(columns, held, strict=True) for k, v in enumerate(values)]
        yield pa.RecordBatch.from_pylist([dict(zip(("file", "start", "part", "k", "column_name", "v"), r, strict=True)) for r in rows], schema=pa.schema([("file", pa.string()), ("start", pa.int64()), ("part", pa.int32()), ("k", pa.int32()), ("column_name", pa.string()), ("v", pa.string())]))

    found = cells.mapInArrow(firsts, "file string, start long, part int, k int, column_name string, v string")
    order = Window.partitionBy("column_name").orderBy("file", "start", "part", "k")  # some rows a split
    first = found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= samples)
    listed = first.groupBy("column_name").agg(F.array_sort(F.collect_list(F.struct("place", "v"))).alias("all"))
    return listed.select("column_name", F.col("all.v").alias("sample_values"))


def frame_profile(df: DataFrame, samples: int = 5) -> DataFrame:
    """(column_name, dtype, non_null_count, null_count, unique_count with null as a value, sample_values: the first in row order)."""
    base = missing_and_distinct(df)
    types = dict(df.dtypes)
    kinds = F.create_map(*[F.lit(x) for pair in types.items() for x in pair])
    rows = base.select("column_name", F.element_at(kinds, F.col("column_name")).alias("dtype"), (F.col("row_count") - F.col("missing")).alias("non_null_count"), F.col("missing").alias("null_count"), (F.col("distinct_count") + (F.col("missing") > 0).cast("int")).alias("unique_count"))
    return rows.join(first_values(df, samples), "column_name", "left").withColumn("sample_values", F.coalesce("sample_values", F.array().cast("array<string>")))
