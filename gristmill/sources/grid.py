"""Delimited text as a grid of cells: encoding, delimiter, header row, numbers.

Only the head of a file is looked at on the driver, for its encoding and delimiter; rows are cut and
parsed by all tasks (``scan``), and headers are found for each file.
"""

from __future__ import annotations

import codecs
import csv
import re
import statistics

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.names import unique_names
from ..operators.profile import BLOCK, ROW, col
from ..session import materialized
from . import scan

# How much of the head counts, the words of headers, and the weights of the header score.
HEAD_BYTES, HEAD_LINES, HEADER_ROWS = 128_000, 30, 25
LEAST_HEADER_SCORE, LEAST_NUMERIC_SHARE = 4.0, 0.85
HEADER_WORDS = ("name", "organisation", "organization", "count", "total", "date", "year", "month", "amount", "value", "category", "type", "status", "number", "id")
SCORE_WEIGHTS = {"filled": 2, "header_words": 3, "next_numbers": 2, "next_filled": 1, "density": 4, "next_density": 3, "continuity": 3, "numbers": -2, "unnamed": -4, "place": -0.05}
DELIMITERS = ",;\t|"


def head_bytes(spark: SparkSession, path: str, size: int = HEAD_BYTES) -> bytes:
    """The first bytes of a file, or of the first file of a folder, by Spark's own file systems."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.getFileStatus(where).isDirectory():
        names = sorted(s.getPath().toString() for s in fs.listStatus(where) if s.isFile() and not s.getPath().getName().startswith(("_", ".")))
        where = jvm.org.apache.hadoop.fs.Path(names[0])
    stream = fs.open(where)
    try:
        return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(jvm.org.apache.commons.io.input.BoundedInputStream(stream, size)))
    finally:
        stream.close()


def detect_encoding(head: bytes) -> str:
    """By byte order mark, else UTF-8 where the head decodes, else a detector's guess if it is fairly sure.

    The head may end inside a character. A whole file that does so is UTF-8 only if other characters are.
    """
    marks = ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe\x00\x00", "utf-32le"), (b"\xff\xfe", "utf-16le"), (b"\xfe\xff", "utf-16be"))
    for mark, name in marks:
        if head.startswith(mark):
            return name
    decoder = codecs.getincrementaldecoder("utf-8")()
    try:
        text = decoder.decode(head)
        if not decoder.getstate()[0] or len(head) >= HEAD_BYTES or not text.isascii():
            return "utf-8"
    except UnicodeDecodeError:
        pass
    try:
        from charset_normalizer import from_bytes
    except ImportError:
        return "iso-8859-1"
    best = from_bytes(head).best()
    return best.encoding.replace("_", "-") if best is not None and best.chaos < 0.55 else "utf-8"


#: Opens where a cell of any delimiter begins and closes where one ends, or is cut off by the end of the head.
_QUOTED = re.compile(r'(?<![^,;\t|\r\n])"(?:[^"]|"")*+(?:"(?=[,;\t|\r\n]|\Z)|\Z)')


def detect_delimiter(text: str, fallback: str = ",") -> str:
    """The standard sniffer's choice, else the delimiter with many, regular, widespread hits; one that all lines hold alike goes before.

    What quoted cells hold, line breaks too, doesn't count.
    """
    lines = [x for x in re.split("\r\n|\r|\n", _QUOTED.sub('""', text)) if x.strip()][:HEAD_LINES]
    if not lines:
        return fallback
    hits = {d: [x.count(d) for x in lines] for d in DELIMITERS}
    regular = [d for d, h in hits.items() if h[0] and len(h) > 1 and len(set(h)) == 1]
    try:
        sniffed = csv.Sniffer().sniff("\n".join(lines), DELIMITERS).delimiter
        if sniffed in regular or not regular:
            return sniffed
    except csv.Error:
        pass
    if regular:
        return max(regular, key=lambda d: hits[d][0])

    def score(d: str) -> float:
        filled = [h for h in hits[d] if h]
        return statistics.mean(hits[d]) * (hits[d].count(statistics.mode(hits[d])) / len(lines)) * (len(filled) / len(lines)) if filled else 0.0

    best = max(DELIMITERS, key=score)
    return best if score(best) else fallback


def _is_number(cell: str) -> bool:
    return bool(re.fullmatch(r"[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?", re.sub(r"[,£$\s]", "", cell)))


def header_score(rows: list[list[str | None]], at: int) -> float:
    """How much row ``at`` looks like the names of the rows below it."""
    cells = [[(c or "").strip() for c in r] for r in rows[at : at + 6]]
    held = [[c for c in r if c] for r in cells]
    if len(held[0]) < 2:
        return -10.0
    below = held[1] if len(held) > 1 else []
    like = [len(r) >= max(2, len(held[0]) - 1) for r in held[1:]]
    facts = {
        "filled": len(held[0]),
        "header_words": sum(any(w in c.lower() for w in HEADER_WORDS) for c in held[0]),
        "next_numbers": min(3, sum(map(_is_number, below))),
        "next_filled": min(len(below), len(held[0])),
        "density": len(held[0]) / len(cells[0]),
        "next_density": len(below) / len(cells[1]) if len(cells) > 1 and cells[1] else 0.0,
        "continuity": sum(like) / len(like) if like else 0.0,
        "numbers": sum(map(_is_number, held[0])),
        "unnamed": sum(c.lower().startswith("__unnamed__") for c in held[0]),
        "place": at,
    }
    return sum(SCORE_WEIGHTS[k] * v for k, v in facts.items())


def find_header(rows: list[list[str | None]]) -> int | None:
    """The row of the first 25 (but the last) that looks most like a header; None if none does."""
    scores = [header_score(rows, k) for k in range(min(len(rows) - 1, HEADER_ROWS))]
    best = max(scores, default=LEAST_HEADER_SCORE - 1)
    return scores.index(best) if best >= LEAST_HEADER_SCORE else None


def header_names(cells: list[str | None]) -> list[str]:
    return unique_names([" ".join((c or "").split()) for c in cells])


def promote_header(df: DataFrame, row_number: str) -> DataFrame:
    """Name the columns of a grid of texts by its header row and drop what stands above; ``row_number`` orders the rows."""
    names = [c for c in df.columns if c != row_number]
    head = df.orderBy(row_number).limit(HEADER_ROWS + 7).collect()
    wide = max((k for r in head for k, c in enumerate(names, 1) if r[c] is not None), default=0)  # wider rows further down don't count
    at = find_header([[r[c] for c in names[:wide]] for r in head])
    if at is None:
        return df.dropna("all", subset=names).drop(row_number)
    rows = df.filter(F.col(row_number) > head[at][row_number]).select(*[col(c) for c in names])
    return rows.toDF(*header_names([head[at][c] for c in names])).dropna("all")


def cast_numeric_like(df: DataFrame) -> DataFrame:
    """Text columns of which 85 % of the values are numbers (thousands separated by commas) as doubles, in one aggregate."""
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, StringType)]
    if not texts:
        return df
    bare = {c: F.replace(F.trim(col(c)), F.lit(","), F.lit("")) for c in texts}
    number = {c: F.when(v.rlike(r"^[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?$"), v.try_cast("double")) for c, v in bare.items()}
    counts = df.agg(*[F.struct(F.count(number[c]).alias("a"), F.count(col(c)).alias("b")).alias(f"c{i}") for i, c in enumerate(texts)]).first()
    cast = {c: number[c] for i, c in enumerate(texts) if counts[f"c{i}"]["b"] and counts[f"c{i}"]["a"] >= LEAST_NUMERIC_SHARE * counts[f"c{i}"]["b"]}
    return df.withColumns(cast) if cast else df


def _whole_file_lines(spark: SparkSession, path: str, encoding: str) -> DataFrame:
    """Lines of files whose encoding has line breaks of several bytes, as UTF-8; a file is read by one task."""
    import pyarrow as pa

    def lines(batches):
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = [x.encode() for x in re.split("\r\n|\r|\n", content.decode(encoding, "replace"))]
                yield pa.RecordBatch.from_arrays([pa.array([file] * len(found)), pa.array([0] * len(found), pa.int64()), pa.array([len(content)] * len(found), pa.int64()), pa.array(found, pa.binary())], ["file", "start", "size", "value"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(lines, "file string, start long, size long, value binary")


def _cells(delimiter: str, encoding: str, as_written: bool):
    """Task function: records to their trimmed cells, empty ones null; or to cells as they are, null where nothing is written."""
    import pyarrow as pa

    def run(batches):
        csv.field_size_limit(1 << 62)
        for batch in batches:
            texts = [r.decode(encoding, "replace") for r in batch.column(3).to_pylist()]
            # A row at a time, so that a record that Python's reader can't end stays its own.
            if as_written:
                first = [not start and not seq for start, seq in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
                cells = [next(csv.reader([t.removeprefix("\ufeff") if f else t], delimiter=delimiter, quoting=csv.QUOTE_NOTNULL), []) for t, f in zip(texts, first, strict=True)]
            else:
                rows = [next(csv.reader([t.replace("\0", "")], delimiter=delimiter), []) for t in texts]
                cells = [[c.replace("\ufeff", "").strip() or None for c in row] for row in rows]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(cells, pa.list_(pa.string()))], ["file", "start", "seq", "cells"])

    return run, "file string, start long, seq long, cells array<string>"


def _layout(heads):
    """Of one file: the row of its header in the file (-1: none), and the names."""
    import pandas as pd

    rows = [list(r) for r in heads.sort_values("row_in_file")["cells"]]
    wide = max((k for r in rows for k, c in enumerate(r, 1) if c is not None), default=0)  # wider rows further down don't count
    grid = [(r + [None] * wide)[:wide] for r in rows]
    at = find_header(grid)
    return pd.DataFrame([(heads["file"].iloc[0], -1 if at is None else at, grid[at] if at is not None else None, grid)], columns=["file", "at", "header", "grid"])


def _first_row(heads):
    """Of one file whose first row is known to be its header: what ``_layout`` gives."""
    import pandas as pd

    cells = list(heads["cells"].iloc[0])
    return pd.DataFrame([(heads["file"].iloc[0], 0, cells, [cells])], columns=["file", "at", "header", "grid"])


def layouts(rows: DataFrame, header: bool | None = None) -> list[dict]:
    """By file, in the order of paths: the row of the header, and the names of all its columns.

    ``header`` True: it is the first row. Else each file's first rows are judged apart. A file without
    a header of its own, but with a row that is another file's header, has it there; one without any takes
    the names of the others where these all agree, else numbers. A row a file reaches the driver, with the
    rows looked at.
    """
    heads = rows.filter(F.col("row_in_file") < (1 if header else HEADER_ROWS + 7)).select("file", "row_in_file", "cells")
    found = heads.groupBy("file").applyInPandas(_first_row if header else _layout, "file string, at int, header array<string>, grid array<array<string>>")
    widths = rows.groupBy("file").agg(F.max(F.size("cells")).alias("width"))
    files = found.join(widths, "file").orderBy("file").collect()
    known = {tuple(f.header) for f in files if f.header}
    out = []
    for f in files:
        at, cells = f.at, f.header
        if cells is None and known:
            held = {k: tuple(r) for k, r in enumerate(f.grid[:HEADER_ROWS])}
            at = next((k for k, r in held.items() if r in known), -1)
            cells = held[at] if at >= 0 else next(iter(known)) if len(known) == 1 and f.width <= len(next(iter(known))) else None
        names = header_names([*(cells or []), *[None] * max(0, f.width - len(cells or []))])
        out.append({"file": f.file, "at": at, "names": names})
    return out


def read_delimited(spark: SparkSession, path: str, delimiter: str | None = None, encoding: str | None = None, header: bool | None = None, max_rows: int | None = None, numbered: bool = False, as_written: bool = False) -> tuple[DataFrame, dict]:
    """A delimited file, or a folder of them, as a typed table, and what was detected.

    Byte ranges of a file are read by different tasks, also where quoted cells hold line breaks.
    ``header`` False keeps ``column_1``..., True takes the first row of each file; None looks for the header row of each file. Columns of
    one name line up, whatever their order in the files; a column that a file lacks is null there, and a
    column's type comes from the values of all files. Ragged rows are padded to the widest row,
    empty cells are null. ``max_rows`` caps the rows read, the first ones. ``numbered`` adds ``__row`` and
    ``__block``, the order of the rows, which ``clean`` follows. ``as_written`` keeps every cell whole and as
    text (its line breaks become \\n): nothing is trimmed or read as a number, ``""`` is an empty text, and only
    what isn't written is null. It needs Python 3.13.
    """
    head = b"" if encoding and delimiter else head_bytes(spark, path)
    encoding = encoding or detect_encoding(head)
    text = head.decode(encoding, "replace").lstrip("\ufeff")
    if len(head) == HEAD_BYTES:  # its last line may be cut
        text = text.rpartition("\n")[0] or text
    delimiter = delimiter or detect_delimiter(text, "\t" if path.lower().endswith((".tsv", ".tsv.gz")) else ",")
    wide_breaks = encoding.lower().replace("_", "-").startswith(("utf-16", "utf-32"))
    lines = _whole_file_lines(spark, path, encoding) if wide_breaks else scan.pieces(spark, path)
    step = scan.line_step(delimiter)
    found = scan.records(lines, step, scan.cut_lines(step), "\n")
    rows = scan.numbered(materialized(found.mapInArrow(*_cells(delimiter, "utf-8" if wide_breaks else encoding, as_written))))
    files = layouts(rows, header) if header is not False else [{"file": r.file, "at": -1, "names": header_names([None] * r.width)} for r in rows.groupBy("file").agg(F.max(F.size("cells")).alias("width")).orderBy("file").collect()]
    names = list(dict.fromkeys(n for f in files for n in f["names"]))
    kinds = list(dict.fromkeys((f["at"], tuple(f["names"])) for f in files))
    if len(kinds) > 1:  # a row a file
        told = spark.createDataFrame([(f["file"], kinds.index((f["at"], tuple(f["names"])))) for f in files], "file string, kind int")
        rows = rows.join(F.broadcast(told), "file")
        at = F.element_at(F.array(*[F.lit(k[0]) for k in kinds]), F.col("kind") + 1)
        place = lambda n: F.element_at(F.array(*[F.lit(k[1].index(n) if n in k[1] else -1) for k in kinds]), F.col("kind") + 1)
        cell = lambda n: F.when(place(n) >= 0, F.get("cells", place(n)))
    else:
        at, cell = F.lit(kinds[0][0] if kinds else -1), lambda n: F.get("cells", F.lit(kinds[0][1].index(n)))
    table = rows.filter(F.col("row_in_file") > at).select(*[cell(n).alias(n) for n in names], BLOCK, ROW)
    if not as_written:
        table = table.dropna("all", subset=names or None)
    if max_rows:
        table = table.orderBy(ROW).limit(max_rows)
    if not as_written:
        table = cast_numeric_like(table)
    return table if numbered else table.drop(BLOCK, ROW), {"type": "delimited", "encoding": encoding, "delimiter": delimiter, "header_scan_rows": HEADER_ROWS, "files": len(files), "headers": len({k[1] for k in kinds})}
