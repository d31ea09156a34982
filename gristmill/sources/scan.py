"""Records of text files whose boundaries depend on everything before them, cut by all tasks in parallel.

A line break may stand inside a quoted cell, a brace inside a JSON string; whether it does is only known
from the start of the file. Spark's text source deals out byte ranges as pieces between separators.
A first pass summarises each range for both cases, that it starts inside quotes and that it
doesn't: where it ends, and how much deeper. The few summaries of a file are folded in order, which
gives each range its true start, and a second pass cuts the records. What crosses the end of a range
is joined from its parts. Each record belongs to the range that it starts in, so (file, start, seq) is
its place, and numbers follow without sorting the records.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.profile import BLOCK, ROW
from ..session import materialized

#: (inside quotes at the end, how much deeper) after a piece, from whether it starts inside quotes.
Step = Callable[[bytes, int], tuple[int, int]]
#: Bytes of records that a task sends on together.
BATCH = 4 << 20


def pieces(spark: SparkSession, path: str, separator: str | None = None) -> DataFrame:
    """(file, start, size, value): the bytes between separators (line breaks by default), in their order within a range."""
    df = spark.read.text(path, lineSep=separator) if separator else spark.read.text(path)
    where = df.metadataColumn("_metadata")
    return df.select(where["file_path"].alias("file"), where["file_block_start"].alias("start"), where["file_size"].alias("size"), F.col("value").cast("binary").alias("value"))


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, Iterator[bytes]]]:
    """The pieces of one range after the other, with the other columns of its rows."""
    rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
    row = next(rows, None)

    def same(head: tuple) -> Iterator[bytes]:
        nonlocal row
        while row is not None and row[:2] == head[:2]:
            value = row[-1]
            row = next(rows, None)
            yield value

    while row is not None:
        head = row[:-1]
        values = same(head)
        yield head, values
        for _ in values:  # what the reader of the range has left
            pass


def _summary(step: Step):
    def run(batches):
        for (file, start, size), values in _ranges(batches):
            ends, deeper, length, first = [0, 1], [0, 0], 0, ""
            for value in values:
                for k in (0, 1):
                    ends[k], more = step(value, ends[k])
                    deeper[k] += more
                length += len(value) + 1
                if not first:
                    first = value.removeprefix(b"\xef\xbb\xbf").lstrip()[:1].decode("latin-1")
            yield pa.RecordBatch.from_pylist([{"file": file, "start": start, "size": size, "end0": ends[0], "end1": ends[1], "deeper0": deeper[0], "deeper1": deeper[1], "length": length, "first": first}], schema=_SUMMARY)

    return run


_SUMMARY = pa.schema([("file", pa.string()), ("start", pa.int64()), ("size", pa.int64()), ("end0", pa.int32()), ("end1", pa.int32()), ("deeper0", pa.int64()), ("deeper1", pa.int64()), ("length", pa.int64()), ("first", pa.string())])


def _folded(ranges: pd.DataFrame) -> pd.DataFrame:
    """The state at the start of each range of a file; also what the file begins with, and whether it ends with a separator."""
    ranges, inside, depth, out = ranges.sort_values("start"), 0, 0, []
    first = next((f for f in ranges["first"] if f), "")
    spare = int(ranges["length"].sum()) - int(ranges["size"].iloc[0])
    for k, r in enumerate(ranges.itertuples()):
        out.append((r.file, r.start, inside, depth, first, k + 1 == len(ranges), spare))
        depth += r.deeper1 if inside else r.deeper0
        inside = r.end1 if inside else r.end0
    return pd.DataFrame(out, columns=["file", "start", "inside", "depth", "first", "last", "spare"])


def records(read: DataFrame, step: Step, cut, glue: str) -> DataFrame:
    """(file, start, seq, record) of (file, start, size, value).

    ``cut`` takes the state of a range and its pieces and yields (kind, bytes): kind 0 is a whole
    record, 1 one that goes on in the next range, 2 what goes on from the range before. ``glue`` joins
    the parts of a record.
    """
    summaries = read.mapInArrow(_summary(step), "file string, start long, size long, end0 int, end1 int, deeper0 long, deeper1 long, length long, first string")
    states = materialized(summaries.groupBy("file").applyInPandas(_folded, "file string, start long, inside int, depth long, first string, last boolean, spare long"))  # a row a range

    def run(batches):
        for (file, start, *state), values in _ranges(batches):
            seq, held, size = 0, [], 0
            for kind, record in cut(tuple(state), values):
                held.append({"file": file, "start": start, "seq": -1 if kind == 2 else seq, "kind": kind, "record": record})
                seq, size = seq + (kind != 2), size + len(record)
                if size > BATCH:
                    yield pa.RecordBatch.from_pylist(held, schema=_RECORD)
                    held, size = [], 0
            if held:
                yield pa.RecordBatch.from_pylist(held, schema=_RECORD)

    # Both passes must see the same ranges.
    told = read.drop("size").join(F.broadcast(states), ["file", "start"], "left").select("file", "start", F.coalesce("inside", F.raise_error(F.lit("the ranges of a file changed between two passes")).cast("int")).alias("inside"), "depth", "first", "last", "spare", "value")
    found = materialized(told.mapInArrow(run, "file string, start long, seq long, kind int, record binary"))
    parts = found.filter("kind <> 0")
    order = Window.partitionBy("file").orderBy("start", "seq").rowsBetween(Window.unboundedPreceding, 0)
    numbered = parts.withColumn("of", F.sum((F.col("kind") == 1).cast("int")).over(order))
    joined = numbered.groupBy("file", "of").agg(F.array_sort(F.collect_list(F.struct("start", "seq", "record"))).alias("parts"))
    whole = joined.select("file", F.col("parts")[0]["start"].alias("start"), F.col("parts")[0]["seq"].alias("seq"), F.array_join(F.transform("parts.record", lambda r: r.cast("string")), glue).cast("binary").alias("record"))
    return found.filter("kind = 0").select("file", "start", "seq", "record").union(whole)


_RECORD = pa.schema([("file", pa.string()), ("start", pa.int64()), ("seq", pa.int64()), ("kind", pa.int32()), ("record", pa.binary())])


def numbered(rows: DataFrame) -> DataFrame:
    """Rows with (file, start, seq) with ``__row`` over all files by path, ``__block``, and ``row_in_file``; all from 0."""
    sizes = rows.groupBy("file", "start").agg(F.count(F.lit(1)).alias("n"))
    along = Window.orderBy("file", "start")  # a row a range
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = materialized(sizes.select("file", "start", before(along).alias("of_all"), before(Window.partitionBy("file").orderBy("start")).alias("of_file"), (F.row_number().over(along) - 1).cast("long").alias(BLOCK)))
    return rows.join(F.broadcast(starts), ["file", "start"]).withColumn(ROW, F.col("of_all") + F.col("seq")).withColumn("row_in_file", F.col("of_file") + F.col("seq")).drop("of_all", "of_file")


# Delimited text: pieces are lines.


def line_step(delimiter: str) -> Step:
    """Quotes count where a cell begins with one; inside, two stand for one."""
    mark = delimiter.encode()

    def step(line: bytes, inside: int) -> tuple[int, int]:
        if b'"' not in line:
            return inside, 0
        at, end = 0, len(line)
        while True:
            if inside:
                close = _CLOSES.match(line, at)
                if not close:
                    return 1, 0
                at = close.end()
            elif line[at : at + 1] == b'"':
                inside, at = 1, at + 1
                continue
            at = line.find(mark, at) + 1
            if not at or at > end:
                return 0, 0
            inside = 0

    return step


_CLOSES = re.compile(rb'(?:[^"]|"")*"(?!")')


def cut_lines(step: Step):
    def cut(state: tuple, lines: Iterator[bytes]) -> Iterator[tuple[int, bytes]]:
        inside, held, kind = state[0], [], 2 if state[0] else 0
        for line in lines:
            if not line and not held and not inside:  # blank lines between records
                continue
            if inside or b'"' in line:
                inside, _ = step(line, inside)
            held.append(line)
            if not inside:
                yield kind, b"\n".join(held)
                held, kind = [], 0
        if held:
            # Open quotes at the end of the file close there.
            yield (2 if kind == 2 else 0 if state[3] else 1), b"\n".join(held)

    return cut


# JSON: pieces end where a closing brace stands.

_ESCAPED, _OPENS = re.compile(rb"\\.", re.S), re.compile(rb"[\[\]{]")
_BETWEEN = b" \t\r\n,[]\xef\xbb\xbf"


def json_step(piece: bytes, inside: int) -> tuple[int, int]:
    if b"\\" in piece:
        piece = _ESCAPED.sub(b"", piece)
    parts = piece.split(b'"')
    deeper = sum(p.count(b"{") + p.count(b"[") - p.count(b"]") for p in parts[inside::2])
    inside = (inside + len(parts) - 1) % 2
    return inside, deeper - (not inside)


def _opening(piece: bytes, depth: int, base: int) -> int:
    """The place of the brace that opens a record, for a piece that starts outside of records; -1 if none does."""
    bare = _ESCAPED.sub(b"\0\0", piece)
    at, parts = 0, bare.split(b'"')
    for k, part in enumerate(parts):
        if k % 2 == 0:
            for m in _OPENS.finditer(part):
                if m[0] == b"{" and depth == base:
                    return at + m.start()
                depth += 1 if m[0] != b"]" else -1
        at += len(part) + 1
    return -1


def cut_json(state: tuple, values: Iterator[bytes]) -> Iterator[tuple[int, bytes]]:
    """Objects of a file of lines, of one array, or of objects one after the other; other text comes as records that don't parse."""
    inside, depth, first, last, spare = state
    base = 1 if first == "[" else 0
    # In a record from the range before: deeper than its base, or in a string.
    within = inside == 1 or depth > base
    held, kind = [], 2 if within else 0
    value = next(values, None)
    while value is not None:
        following = next(values, None)
        final = last and following is None
        if not within:
            at = _opening(value, depth, base)
            stray = (value if at < 0 else value[:at]).strip(_BETWEEN)
            if stray:
                yield 0, stray
        inside, deeper = json_step(value, inside)
        # Behind the last piece stands a brace only if the file is as long as all pieces and separators.
        closed = not final or spare == 0 or (spare != 1 and inside == 0 and depth + deeper == base)
        depth += deeper + (inside == 0 and not closed)
        if within or at >= 0:
            held.append((value if within else value[at:]) + (b"}" if closed else b""))
            within = inside == 1 or depth > base
            if not within:
                yield kind, b"".join(held)
                held, kind = [], 0
        value = following
    if held:
        yield (2 if kind == 2 else 0 if last else 1), b"".join(held)
