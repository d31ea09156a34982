"""JSON files: lines, one array, or objects one after the other, all read by several tasks.

Files with an object on each line are left to Spark's own reader. Others are cut into their objects
by ``scan``: pieces end where a closing brace stands, and folded quotes and depths tell which brace
ends an object of the top level.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.profile import BLOCK, ROW
from ..session import materialized
from . import scan
from .grid import head_bytes

_WIDE_MARKS = (b"\xff\xfe", b"\xfe\xff", b"\x00\x00\xfe\xff")


def is_lines(spark: SparkSession, path: str) -> bool:
    """Whether every line that isn't empty is one object, by its braces outside of strings; one pass."""
    line = F.trim(F.replace(F.col("value"), F.lit("\ufeff"), F.lit("")), F.lit(" \t\r"))
    bare = F.regexp_replace(line, r'"[^"\\]*+(?:\\.[^"\\]*+)*+"', "0")
    count = lambda c: F.length(bare) - F.length(F.replace(bare, F.lit(c), F.lit("")))
    one = bare.startswith("{") & bare.endswith("}") & (count("{") == count("}")) & ~bare.contains('"') & ~bare.rlike(r"\}\s*\{")
    return spark.read.text(path).filter(line != "").agg(F.coalesce(F.bool_and(one), F.lit(True))).first()[0]


def read_json(spark: SparkSession, path: str, max_rows: int | None = None, numbered: bool = False) -> tuple[DataFrame, dict]:
    """The objects of JSON files as a table with the union of their fields, and the form that was found.

    What is no object (a scalar in an array, text between objects, a cut end) becomes a row of nulls with
    its text in ``_corrupt_record``, as Spark's permissive mode has it. Files in UTF-16 or UTF-32 are
    read by one task each. ``max_rows`` caps the rows, the first ones. ``numbered`` adds the order of the rows.
    """
    if head_bytes(spark, path, 4).startswith(_WIDE_MARKS):
        df, form = spark.read.json(path, multiLine=True), "whole file"
        found = None
    elif is_lines(spark, path):
        df, form, found = spark.read.json(path), "lines", None
    else:
        form = "objects"
        found = scan.numbered(materialized(scan.records(scan.pieces(spark, path, "}"), scan.json_step, scan.cut_json, "").select("file", "start", "seq", F.col("record").cast("string").alias("record"))))
        texts = getattr(found.select("record")._jdf, "as")(spark._jvm.org.apache.spark.sql.Encoders.STRING())
        # The reader's own inference over texts, which its Java interface offers.
        schema = StructType.fromJson(json.loads(spark._jsparkSession.read().json(texts).schema().json()))
        df = found.select(F.from_json("record", schema, {"columnNameOfCorruptRecord": "_corrupt_record"}).alias("r"), BLOCK, ROW).select("r.*", BLOCK, ROW)
    if (numbered or max_rows) and found is None:
        from ..operators.ordered import with_row_number

        df = with_row_number(df)
    if max_rows:
        df = df.orderBy(ROW).limit(max_rows)
    return df if numbered else df.drop(BLOCK, ROW), {"type": "json", "form": form}
