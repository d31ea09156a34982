"""Intermediate tables in the folder that the cluster shares, and row decisions applied to documents."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, or the session's checkpoint folder; a new local one only where the master is local."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="gristmill-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


#: Arrow batches between Spark and Python: a batch of whole texts is held on both sides, by each task.
BATCH_BYTES = ("spark.sql.execution.arrow.maxBytesPerBatch", "8m")


class Workspace:
    """Named Parquet tables that cut lineage: a lost executor costs no recomputation of what is written here.

    Results read them lazily, so they stay; a ``gristmill-*`` folder may go once its results are written.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        if spark.conf.get(BATCH_BYTES[0], None) is None:  # a set size stays
            spark.conf.set(*BATCH_BYTES)
        self.root = f"{shared_folder(spark)}/gristmill-{uuid.uuid4().hex}"

    def table(self, df: DataFrame, name: str, **options) -> DataFrame:
        """Write ``df`` and return the written table."""
        path = f"{self.root}/{name}"
        df.write.parquet(path, **options)
        return self.spark.read.schema(df.schema).parquet(path)

    def append(self, df: DataFrame, name: str) -> None:
        df.write.mode("append").parquet(f"{self.root}/{name}")

    def appended(self, name: str, schema) -> DataFrame:
        """What has been appended so far."""
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}")

    def drop(self, *names: str) -> None:
        """Remove tables that no later step reads."""
        jvm = self.spark._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def keep(self, *names: str) -> None:
        """Remove all tables but these, which the result reads."""
        root = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        found = root.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(root)
        self.drop(*[n for n in (f.getPath().getName() for f in found) if n not in names])


def free_name(columns: list[str], base: str) -> str:
    """A column name from ``base`` that no column of ``columns`` has in any case."""
    taken = {c.lower() for c in columns}
    while base in taken:
        base += "_"
    return base


def ranked(work: Workspace, rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``rows`` with ``rank`` (1, 2, ... in ``order``), from each row's place in its range and the rows of the ranges before."""
    sorted_rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    placed = work.table(sorted_rows.withColumn("at", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)), name)
    sizes = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n"))  # a row a range
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    return placed.join(F.broadcast(starts), "part").withColumn("rank", F.col("start") + F.col("at") + 1).drop("part", "at", "start")


#: Bytes of keys up to which a list of them is broadcast; a longer one is joined by a shuffle.
BROADCAST_BYTES = 64 << 20


def broadcast_if_small(df: DataFrame, *columns: str) -> DataFrame:
    """A written table of keys, broadcast if its measured bytes (of ``columns`` as texts, and 32 a row) are few."""
    sizes = [F.coalesce(F.sum(F.octet_length(F.col(c).cast("string"))), F.lit(0)) for c in columns]
    rows, *text = df.agg(F.count(F.lit(1)), *sizes).first()
    return F.broadcast(df) if 32 * rows + sum(text) <= BROADCAST_BYTES else df


def without(docs: DataFrame, dropped: DataFrame, repeated: DataFrame, digest) -> DataFrame:
    """Rows of ``docs`` but those in ``dropped`` (id, digest), and one row for each key of ``repeated``.

    ``digest`` is the column expression that both tables call ``digest``; ``repeated`` lists keys
    that stay and stand in several rows of ``docs`` (the same id with the same text). Ids may be null.
    Documents don't move where the keys are few enough to broadcast. Of repeated rows the one with
    the least hash of its columns (maps don't count) stays, pre-aggregated in every task.
    """
    columns = docs.columns
    key, mark, whole = dropped.columns[0], free_name(columns, "digest"), free_name(columns, "whole")
    marked = docs.withColumn(mark, digest)

    def same(other: DataFrame):
        return marked[key].eqNullSafe(other[key]) & (marked[mark] == other["digest"])

    rest = marked.join(broadcast_if_small(dropped, key), same(dropped), "left_anti")
    if repeated.isEmpty():
        return rest.select(*columns)
    marked, few = rest, broadcast_if_small(repeated, key)
    hashed = [F.col(f"`{f.name}`") for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
    row = F.min_by(F.struct(*[F.col(f"`{c}`") for c in columns]), F.xxhash64(*hashed)).alias(whole)
    one = rest.join(few, same(repeated), "left_semi").groupBy(key, mark).agg(row).select(*[F.col(whole)[c].alias(c) for c in columns])
    return rest.join(few, same(repeated), "left_anti").select(*columns).unionByName(one)
