"""What grows with the input stays bounded: blocks of row order, work a cell, pairs of columns."""

import math

from pyspark.sql import functions as F

from gristmill.functions import text as T
from gristmill.operators import ordered, profile


def test_blocks_of_one_file_are_bounded(spark, tmp_path, monkeypatch):
    """One split of 100 rows: no block has more than 7, numbers have no gaps, filling crosses blocks."""
    monkeypatch.setattr(ordered, "BLOCK_ROWS", 8)
    rows = spark.range(100).coalesce(1).select("id", F.when(F.col("id") % 30 == 5, F.col("id") * 2.0).alias("v"))
    rows.write.parquet(str(tmp_path / "t"))
    out = ordered.with_row_number(spark.read.parquet(str(tmp_path / "t")))
    assert out.groupBy(ordered.BLOCK).count().agg(F.max("count")).first()[0] == 8
    assert out.filter(F.col(ordered.ROW) != F.col("id")).count() == 0
    assert out.groupBy(ordered.BLOCK).agg(F.min("id").alias("a")).filter(F.col("a") != F.col(ordered.BLOCK) * 8).count() == 0
    filled = {r.id: r.v for r in ordered.interpolate(out, ["v"]).collect()}
    assert all(filled[k] is None if k < 5 else math.isclose(filled[k], 2.0 * min(k, 95)) for k in range(100))


def test_a_cell_is_computed_once(spark):
    """Shared parts of the grammars of dates and numbers stand once in the plan, not once a use."""
    d = spark.createDataFrame([("x",)], "t string")
    plan = lambda c: d.select(c.alias("m"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan(T.moment_in(F.col("t"))).count("regexp_replace(") <= 8  # seven shapes and white space
    assert plan(T.number_in(F.col("t"))).count("regexp_replace(") == 3
    assert plan(T.number_in(F.col("t"))).count("regexp_extract(") == 1


def test_numbers_of_odd_cells(spark):
    cells = {"$1,234.50": 1234.5, "(£3,000)": -3000.0, "-5": -5.0, "12.5%": 12.5, "usd 1.2k": 1200.0, "3 bn": 3e9, "": None, "n/a": None, "O": None, "abc": None, "..": None, "7.": 7.0, "a.5b": 5e8, None: None, "٣": None}
    got = spark.createDataFrame([(k,) for k in cells], "t string").select("t", T.number_in(F.col("t")).alias("n"), T.number_in(F.col("t"), True).alias("s")).collect()
    assert {r.t: r.n for r in got} == cells
    assert {r.t for r in got if r.s is not None} == {"$1,234.50", "(£3,000)", "-5", "12.5%", "3 bn"}


def test_correlations_by_sums_are_those_of_moments(spark, monkeypatch):
    """Nulls, a far mean, a constant, columns that are constant where both have values, and NaN."""
    d = spark.range(500).select(
        F.col("id").alias("a"), (F.col("id") * 3 + F.rand(1) * 400).alias("b"), (F.col("id") % 17 - F.col("id") / 50).alias("c"), F.lit(0.1).alias("k"),
        F.when(F.col("id") % 3 == 0, F.lit(1e9) + F.col("id") % 40).alias("far"), F.when(F.col("id") < 50, 7).otherwise(F.col("id")).alias("half"),
        F.when(F.col("id") < 50, F.col("id")).alias("start"), F.when(F.col("id") == 3, float("nan")).otherwise(F.col("id")).alias("odd"), F.lit(None).cast("int").alias("none"),
    ).repartition(3)
    pairs = [(a, b) for i, a in enumerate(d.columns) for b in d.columns[i + 1 :]]
    plain, asked = profile._plain_correlations, []
    want = {p: round(r, 3) for p, r in plain(d, pairs).items() if r is not None and not abs(r) <= 0.0}
    monkeypatch.setattr(profile, "_plain_correlations", lambda df, some: asked.extend(some) or plain(df, some))
    got = {(r[0], r[1]): r[2] for r in profile.correlation_pairs(d, least=0.0).collect()}
    same = lambda x, y: x == y or (math.isnan(x) and math.isnan(y)) or abs(x - y) < 1.1e-3
    assert {p for p in got} == {p for p in want if want[p] != 0} and all(same(got[p], want[p]) for p in got)
    assert ("half", "start") not in got and ("a", "k") not in got
    assert ("a", "b") not in asked and ("a", "c") not in asked and ("a", "far") not in asked and ("half", "start") in asked
