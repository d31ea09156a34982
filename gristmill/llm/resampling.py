"""Importance resampling of documents towards a target corpus by hashed n-gram features.

Each task runs DuckDB over its own texts: SQL unnests the words, windows them into runs of 1 to
``max_words`` words, counts runs by text and puts the distinct ones in buckets by a registered zlib
CRC-32 function. A text's bucket counts are written to Parquet in the shared folder, with one row of
totals a task; Spark merges the totals of source and target into the buckets' gains (the log ratio of
their shares in the target and in the source, add-one smoothed), and scores each document by the mean
gain of its features plus Gumbel noise from a hash of its id. The highest scores of the documents with
at least ``least_words`` words are drawn, which samples without replacement in proportion to the
weights.

Scores are whole thousandths, so that sums are exact and reruns agree. A score's range is bounded
(gains by the logarithms of counts, noise by 32 bits), so a count of rows by score finds the lowest
score drawn; only rows from there on are range-sorted and numbered, by their place and the rows of the
ranges before.

Texts are read in blocks of BLOCK_BYTES; a longer text goes in pieces of so many characters, cut
between words, whose counts are added up. No DuckDB spills: its memory is that of a block.

Defined cases: null texts and texts without words have no features, weight 0, and are never drawn if
``least_words`` is 1 or more; very long texts and words are like others; an empty target gives every
document features of the source alone; null ids hash as empty and come last among equal scores; repeated rows are rows
like others, with equal scores and consecutive ranks; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .workspace import Workspace, ranked

#: What is no word character, after lower-casing A-Z: ASCII but 0-9 and a-z.
GAP = r"\x00-\x2F\x3A-\x60\x7B-\x7F"
BUCKETS, LEAST_WORDS, PERCENT, SEED = 10_000, 20, 10, 2024
BLOCK_BYTES = 4 << 20
DUCK = {"threads": 1, "memory_limit": "512MB", "temp_directory": ""}


def feature_sql(max_words: int, buckets: int) -> str:
    """DuckDB SQL from ``texts`` (place, body, tail) to (place, words, bucket lists, count lists).

    Runs start at the words of ``body`` and may go on into ``tail``; ``words`` counts those of body.
    """
    runs = ["SELECT place, word AS feature FROM tokens WHERE pos <= own"]
    for n in range(2, max_words + 1):
        following = " || ' ' || ".join(["word", *[f"lead(word, {k}) OVER run" for k in range(1, n)]])
        runs.append(f"SELECT place, feature FROM (SELECT place, pos, own, {following} AS feature FROM tokens WINDOW run AS (PARTITION BY place ORDER BY pos)) WHERE pos <= own AND feature IS NOT NULL")
    tail = f" || regexp_extract_all(tail, '[^{GAP}]+')" if max_words > 1 else ""
    return f"""
    WITH split AS (SELECT place, regexp_extract_all(body, '[^{GAP}]+') AS of_body, of_body{tail} AS words FROM texts),
    tokens AS (SELECT place, len(of_body) AS own, unnest(words) AS word{", generate_subscripts(words, 1) AS pos" if max_words > 1 else ", 1 AS pos"} FROM split),
    counted AS (SELECT place, feature, count(*) AS n FROM ({" UNION ALL ".join(runs)}) GROUP BY ALL),
    hashed AS (SELECT feature, crc32(feature) % {buckets} AS bucket FROM (SELECT DISTINCT feature FROM counted)),
    lists AS (SELECT place, list(bucket)::INTEGER[] AS buckets, list(n)::BIGINT[] AS counts FROM (SELECT place, bucket, sum(n)::BIGINT AS n FROM counted JOIN hashed USING (feature) GROUP BY ALL) GROUP BY place)
    SELECT place::BIGINT AS place, len(of_body)::BIGINT AS words, coalesce(buckets, []) AS buckets, coalesce(counts, []) AS counts FROM split LEFT JOIN lists USING (place) ORDER BY place
    """


def _crc32(features: pa.Array) -> pa.Array:
    return pa.array([zlib.crc32(f.encode()) for f in features.to_pylist()], pa.int64())


def _connection():
    import duckdb

    con = duckdb.connect(config=DUCK)
    con.create_function("crc32", _crc32, [duckdb.sqltype("VARCHAR")], duckdb.sqltype("BIGINT"), type="arrow")
    return con


def pieces(text: str, max_words: int, size: int = BLOCK_BYTES) -> Iterator[tuple[str, str]]:
    """A text in bodies of about ``size`` characters cut between words, each with the next ``max_words - 1`` words."""
    gap, following = re.compile(f"[{GAP}]"), re.compile(f"(?:[{GAP}]*[^{GAP}]+){{0,{max_words - 1}}}")
    low = 0
    while low < len(text):
        cut = gap.search(text, low + size)
        high = cut.start() if cut else len(text)
        yield text[low:high], following.match(text, high)[0]
        low = high


def _blocks(column: pa.Array, size: int) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts together stay within ``size`` bytes; a longer text is alone."""
    ends, low = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)), 0
    while low < len(ends):
        before = ends[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(ends, before + size, side="right")))
        yield low, high
        low = high


def _bucket_counts(id_type: str, max_words: int, buckets: int, size: int = BLOCK_BYTES):
    """Task function: (id, text) batches to a row for each text, and a last one with the task's totals."""
    sql = feature_sql(max_words, buckets)

    def run(batches):
        con, totals, seen = _connection(), np.zeros(buckets, np.int64), None

        def counted(places, bodies, tails) -> pa.Table:
            texts = pa.table({"place": pa.array(places, pa.int64()), "body": bodies, "tail": tails})
            con.register("texts", texts)
            out = con.sql(sql).to_arrow_table().combine_chunks()
            con.unregister("texts")
            return out

        for batch in batches:
            ids, seen = batch.column(0), batch.column(0).type
            texts = pc.ascii_lower(pc.fill_null(batch.column(1), ""))
            for low, high in _blocks(texts, size):
                if high == low + 1 and len(whole := texts[low].as_py()) > size:
                    sums, words = np.zeros(buckets, np.int64), 0
                    for body, tail in pieces(whole, max_words, size):
                        part = counted([0], pa.array([body]), pa.array([tail]))
                        words += part["words"][0].as_py()
                        np.add.at(sums, part["buckets"].combine_chunks().flatten().to_numpy(), part["counts"].combine_chunks().flatten().to_numpy())
                    held = np.flatnonzero(sums)
                    words, at, n = pa.array([words], pa.int64()), pa.array([held], pa.list_(pa.int32())), pa.array([sums[held]], pa.list_(pa.int64()))
                else:
                    part = counted(range(high - low), texts.slice(low, high - low), pa.array([""] * (high - low)))
                    words, at, n = (part[c].combine_chunks() for c in ("words", "buckets", "counts"))
                    at, n = at.cast(pa.list_(pa.int32())), n.cast(pa.list_(pa.int64()))
                np.add.at(totals, at.flatten().to_numpy(zero_copy_only=False), n.flatten().to_numpy(zero_copy_only=False))
                rows = high - low
                yield pa.RecordBatch.from_arrays([ids.slice(low, rows), words, at, n, pa.nulls(rows, pa.list_(pa.int64()))], ["id", "words", "buckets", "counts", "totals"])
        if seen is not None and totals.any():
            yield pa.RecordBatch.from_arrays([pa.nulls(1, seen), pa.array([0], pa.int64()), pa.nulls(1, pa.list_(pa.int32())), pa.nulls(1, pa.list_(pa.int64())), pa.array([totals], pa.list_(pa.int64()))], ["id", "words", "buckets", "counts", "totals"])
        con.close()

    return run, f"id {id_type}, words long, buckets array<int>, counts array<bigint>, totals array<bigint>"


def bucket_table(work: Workspace, texts: DataFrame, id_col: str, text_col: str, name: str, max_words: int, buckets: int) -> DataFrame:
    """The written bucket counts of a corpus: a row a text, and rows of totals."""
    picked = texts.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return work.table(picked.mapInArrow(*_bucket_counts(picked.schema["id"].dataType.simpleString(), max_words, buckets)), name)


def bucket_totals(table: DataFrame, name: str) -> DataFrame:
    """(bucket, features) summed over the totals of all tasks."""
    each = table.filter("totals is not null").select(F.posexplode("totals").alias("bucket", "n"))
    return each.groupBy("bucket").agg(F.sum("n").alias(name))


def bucket_gains(spark, source: DataFrame, target: DataFrame, buckets: int) -> np.ndarray:
    """floor(1000 * ln(target share / source share)) of each bucket; as many numbers as buckets reach the driver."""
    both = spark.range(buckets).join(bucket_totals(source, "s"), F.col("id") == F.col("bucket"), "left").drop("bucket").join(bucket_totals(target, "t"), F.col("id") == F.col("bucket"), "left")
    found = both.select("id", F.coalesce("s", F.lit(0)).alias("s"), F.coalesce("t", F.lit(0)).alias("t")).toArrow().sort_by("id")
    s, t = found["s"].to_numpy(), found["t"].to_numpy()
    all_s, all_t = float(s.sum()), float(t.sum())
    return np.floor(1000 * np.log((t + 1.0) * (all_s + buckets) / ((s + 1.0) * (all_t + buckets)))).astype(np.int64)


def _weights(id_type: str, gains: np.ndarray):
    """Task function: the floored mean gain over each text's features."""

    def run(batches):
        for batch in batches:
            lists = batch.column(2)
            at, n = lists.flatten().to_numpy(zero_copy_only=False), batch.column(3).flatten().to_numpy(zero_copy_only=False)
            ends = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))])
            added = lambda v: np.diff(np.concatenate([[0], np.cumsum(v)])[ends])
            features = added(n)
            weight = np.where(features > 0, added(gains[at] * n) // np.maximum(features, 1), 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(features, pa.int64()), pa.array(weight, pa.int64())], ["id", "words", "n_features", "weight"])

    return run, f"id {id_type}, words long, n_features long, weight long"


def gumbel(row_id: Column, seed: int) -> Column:
    """Whole thousandths of Gumbel noise from the first 32 bits of sha256(``seed:id``)."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(row_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def resampled(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text",
    *, max_words: int = 1, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED,
) -> DataFrame:
    """One row per input row: id, n_features, weight, score and rank; the rank is null for rows that aren't drawn."""
    if max_words < 1 or buckets < 1 or not 0 <= percent <= 100:
        raise ValueError("max_words and buckets must be 1 or more, percent from 0 to 100")
    spark, work = docs.sparkSession, Workspace(docs.sparkSession)
    source = bucket_table(work, docs, id_col, text_col, "source", max_words, buckets)
    aim = bucket_table(work, target.withColumn("target_row", F.lit(0)), "target_row", target_text_col, "target", max_words, buckets)
    gains = bucket_gains(spark, source, aim, buckets)
    id_type = docs.schema[id_col].dataType.simpleString()
    weighted = source.filter("totals is null").drop("totals").mapInArrow(*_weights(id_type, gains))
    scored = work.table(weighted.withColumn("score", F.col("weight") + gumbel(F.col("id"), seed)).withColumn("row", F.monotonically_increasing_id()), "scored")

    able = F.col("words") >= least_words
    by_score = scored.filter(able).groupBy("score").agg(F.count(F.lit(1)).alias("n")).toArrow().sort_by([("score", "descending")])
    reached = np.cumsum(by_score["n"].to_numpy())
    drawn = percent * (int(reached[-1]) if len(reached) else 0) // 100
    names = ("n_features", "weight", "score")
    if not drawn:
        work.keep("scored")
        return scored.select(F.col("id").alias(id_col), *names, F.lit(None).cast("long").alias("rank"))
    least = by_score["score"][int(np.searchsorted(reached, drawn))].as_py()
    # Equal rows are told apart by their place, so that many copies of one row don't meet in one range.
    tried = able & (F.col("score") >= least)
    first = ranked(work, scored.filter(tried), [F.col("score").desc(), F.col("id").asc_nulls_last(), F.col("row").asc()], "ranked")
    work.keep("scored", "ranked")
    first = first.select("id", *names, F.when(F.col("rank") <= drawn, F.col("rank")).alias("rank"))
    rest = scored.filter(~tried).select("id", *names, F.lit(None).cast("long").alias("rank"))
    return first.unionByName(rest).withColumnRenamed("id", id_col)
