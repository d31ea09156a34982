"""Exact deduplication by content-defined chunk recipes.

A rolling hash over the bytes of a text sets chunk borders, so equal texts always fall into equal
chunks. Distinct chunks are brought together once, as identifier and SHA-256 of their bytes, which
verifies that an identifier stands for one chunk; where it doesn't, its chunks are numbered. A text is
then only its *recipe*, the ordered list of chunk identifiers, and all comparing, grouping and joining
moves recipes of eight bytes a chunk; neither texts nor chunks move.

Defined cases: a null text counts as empty, and all empty texts are equal. A null id sorts below
every other. Rows that repeat both id and text are copies of each other like any other rows; one of
them is kept. Extra columns are ignored, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .textblocks import LOWER, PIECE, text_blocks
from .workspace import Workspace, without

WINDOW = 16  # bytes that decide about a border; smaller than MIN_CHUNK, so that borders never depend on the text before
MIN_CHUNK, MAX_CHUNK, BORDER_BITS = 256, 16384, 10

_GEAR = np.random.default_rng(7).integers(0, 1 << 32, 256, dtype=np.uint32)


def border_marks(data: np.ndarray) -> np.ndarray:
    """Places after which the rolling hash of the last WINDOW bytes allows a border."""
    found = [np.zeros(0, np.int64)]
    for low in range(0, len(data), PIECE):
        start = max(0, low - WINDOW)
        rolled, width = _GEAR[data[start : low + PIECE]], 1
        while width < WINDOW:
            longer = rolled.copy()
            longer[width:] += rolled[:-width] << np.uint32(width)
            rolled, width = longer, 2 * width
        found.append(np.flatnonzero(rolled[low - start :] >> np.uint32(32 - BORDER_BITS) == 0) + low + 1)
    return np.concatenate(found)


def cut(marks: np.ndarray, start: int, end: int) -> list[int]:
    """Ends of the chunks of the text at [start, end): the first mark past MIN_CHUNK, MAX_CHUNK at most."""
    ends, at = [], start
    while end - at > MIN_CHUNK:
        k = np.searchsorted(marks, at + MIN_CHUNK)
        stop = min(int(marks[k]) if k < len(marks) else end, at + MAX_CHUNK, end)
        ends.append(stop)
        at = stop
    if at < end:
        ends.append(end)
    return ends


def _chunks(column: pa.Array, fold_case: bool) -> Iterator[tuple[int, bytes, list[bytes]]]:
    """Row number, normalised text and chunks of each text."""
    for row, _, data, offsets in text_blocks(column):
        data = LOWER[data] if fold_case else data
        marks, raw = border_marks(data) if len(data) else np.zeros(0, np.int64), data.tobytes()
        for k, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
            ends = cut(marks, a, b)
            yield row + k, raw[a:b], [raw[x:y] for x, y in zip([a, *ends], ends, strict=False)]


def chunk_key(chunk: bytes, bits: int) -> int:
    """The signed 64-bit identifier of a chunk; ``bits`` below 64 makes collisions likely, for tests."""
    key = xxhash.xxh3_64_intdigest(chunk) >> (64 - bits)
    return key - (1 << 64) if key >> 63 else key


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, fold_case: bool = True, key_bits: int = 64) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256, n_chunks.

    Of equal texts the row with the largest id is kept. ``fold_case`` compares texts after
    lower-casing A-Z only.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    work = Workspace(docs.sparkSession)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def distinct_chunks(batches):
        for batch in batches:
            seen = {(chunk_key(c, key_bits), hashlib.sha256(c).digest()) for _, _, chunks in _chunks(batch.column(0), fold_case) for c in chunks}  # of one batch
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in seen], pa.int64()), pa.array([c for _, c in seen], pa.binary())], ["key", "chunk"])

    def recipes(batches):
        for batch in batches:
            shas, lists = [], []
            for _, text, chunks in _chunks(batch.column(1), fold_case):
                shas.append(hashlib.sha256(text).hexdigest())
                lists.append([chunk_key(c, key_bits) for c in chunks])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shas, pa.string()), pa.array(lists, pa.list_(pa.int64()))], ["id", "digest", "recipe"])

    # Every identifier must stand for one chunk; those that don't are listed.
    verified = texts.select("text").mapInArrow(distinct_chunks, "key long, chunk binary").groupBy("key", "chunk").agg(F.count(F.lit(1)).alias("n"))
    clashes = work.table(verified.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key"), "clashes")
    rows = texts.mapInArrow(recipes, f"id {id_type}, digest string, recipe array<bigint>")
    if clashes.isEmpty():
        rows = rows.withColumn("patch", F.lit(None).cast("array<struct<at:int,number:int>>"))
    else:
        rows = _with_patches(texts, rows, clashes, fold_case, key_bits, id_type)
    rows = work.table(rows, "recipes")
    groups = rows.groupBy("recipe", "patch").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    copies = work.table(groups.filter("group_size > 1"), "copies")
    return (
        rows.join(copies, (rows["recipe"] == copies["recipe"]) & rows["patch"].eqNullSafe(copies["patch"]), "left")
        .select(
            rows["id"],
            F.when(copies["group_size"].isNull(), rows["id"]).otherwise(copies["keep_id"]).alias("keep_id"),
            F.coalesce(copies["group_size"], F.lit(1).cast("long")).alias("group_size"),
            rows["digest"].alias("text_sha256"),
            F.size(rows["recipe"]).alias("n_chunks"),
        )
        .withColumn("kept", F.col("id").eqNullSafe(F.col("keep_id")))
        .select(F.col("id").alias(id_col), "keep_id", "group_size", "kept", "text_sha256", "n_chunks")
    )


def _with_patches(texts: DataFrame, rows: DataFrame, clashes: DataFrame, fold_case: bool, key_bits: int, id_type: str) -> DataFrame:
    """Where a hash stands for several chunks: number these, and add to each recipe (place, number) of what it uses of them."""

    def placed(batches):
        for batch in batches:
            for row, text, chunks in _chunks(batch.column(1), fold_case):
                n, sha = len(chunks), hashlib.sha256(text).hexdigest()
                if n:
                    ids = batch.column(0).slice(row, 1).take(pa.array([0] * n))
                    yield pa.RecordBatch.from_arrays([ids, pa.array([sha] * n), pa.array(range(n), pa.int32()), pa.array([chunk_key(c, key_bits) for c in chunks], pa.int64()), pa.array([hashlib.sha256(c).digest() for c in chunks], pa.binary())], ["id", "digest", "at", "key", "chunk"])

    used = texts.mapInArrow(placed, f"id {id_type}, digest string, at int, key long, chunk binary").join(clashes, "key", "left_semi")
    numbered = used.select("key", "chunk").distinct().withColumn("number", F.row_number().over(Window.partitionBy("key").orderBy("chunk")))
    patches = used.join(numbered, ["key", "chunk"]).groupBy("id", "digest").agg(F.array_sort(F.collect_set(F.struct("at", "number"))).alias("patch"))
    return rows.join(patches, rows["id"].eqNullSafe(patches["id"]) & (rows["digest"] == patches["digest"]), "left").select(rows["id"], rows["digest"], "recipe", "patch")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that exact_dedup keeps, with all their columns; one row where id and text repeat."""
    work = Workspace(docs.sparkSession)
    found = work.table(exact_dedup(docs, id_col, text_col).filter("group_size > 1").select(id_col, F.unhex(F.substring("text_sha256", 1, 32)).alias("digest"), "kept"), "decided")
    dropped = found.filter("not kept").select(id_col, "digest")
    repeated = work.table(found.filter("kept").groupBy(id_col, "digest").count().filter("count > 1").select(id_col, "digest"), "repeated")
    work.keep("decided", "repeated")
    return without(docs, dropped, repeated, F.unhex(F.substring(folded_sha256(text_col), 1, 32)))


def folded_sha256(text_col: str):
    """SHA-256 of the text lower-cased in A-Z, as ``text_sha256`` has it."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.sha2(F.translate(F.coalesce(F.col(text_col).cast("string"), F.lit("")), upper, upper.lower()), 256)
