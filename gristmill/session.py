"""Session settings and materialised tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession


def build_session(name: str = "gristmill", master: str | None = None) -> SparkSession:
    """A session in UTC with ANSI semantics and adaptive execution, which the operators rely on."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    return (
        builder.config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.ansi.enabled", "true")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .getOrCreate()
    )


def shared_path(spark: SparkSession) -> str:
    """A new path in the folder that the cluster shares (``spark.checkpoint.dir``); a local one only where the master is local."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isEmpty():
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="gristmill-"))
            current = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = current.get()
    return f"{folder}/table-{uuid.uuid4().hex}"


def materialized(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder of ``spark.checkpoint.dir`` and read again.

    It cuts lineage; a lost executor loses nothing. Rows come back in another order and in other partitions,
    as Spark packs files by their sizes: what depends on the order must carry it (``with_row_number``).
    """
    path = shared_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def counted(df: DataFrame, facts: dict[str, Column]) -> tuple[DataFrame, Observation]:
    """``df`` with aggregates that come for free with its next write: ``observation.get`` has them by name."""
    seen = Observation()
    return df.observe(seen, *[c.alias(name) for name, c in facts.items()]), seen
