"""Workbooks (.xlsx), from the standard library's zip and XML readers.

Spark lists and reads the files on any file system it knows. One task a workbook only unpacks it and
cuts the XML of sheets and shared strings between rows, without parsing; the pieces are dealt out and parsed
by all tasks, and cells meet their shared strings in a join, so neither a sheet nor the table of
strings is held by one task. Cells are texts, as in other grids; dates are written as ISO dates or
times, as the cells' number formats say, and booleans as TRUE or FALSE.
"""

from __future__ import annotations

import datetime as dt
import io
import posixpath
import re
import zipfile
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..operators.combine import combine_sheets
from ..operators.profile import col
from ..session import materialized
from .grid import cast_numeric_like, promote_header

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def sheet_files(book: zipfile.ZipFile) -> dict[str, str]:
    """Part name by sheet name, in the workbook's order."""
    targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    sheets = ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{_MAIN}sheet")
    return {s.get("name"): posixpath.normpath(posixpath.join("xl", targets[s.get(_LINK)])) if not targets[s.get(_LINK)].startswith("/") else targets[s.get(_LINK)][1:] for s in sheets}


def _place(reference: str) -> int:
    n = 0
    for c in re.match("[A-Z]+", reference).group():
        n = 26 * n + ord(c) - 64
    return n - 1


#: Number formats of dates and times among those that every workbook knows.
DATE_FORMATS = frozenset([*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)])


def date_styles(book: zipfile.ZipFile) -> set[int]:
    """The numbers of the cell styles that show dates or times."""
    if "xl/styles.xml" not in book.namelist():
        return set()
    root = ElementTree.fromstring(book.read("xl/styles.xml"))
    own = {int(f.get("numFmtId")): re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", f.get("formatCode") or "") for f in root.iter(f"{_MAIN}numFmt")}
    shows = lambda k: bool(re.search("[ymdhs]", own[k].lower())) if k in own else k in DATE_FORMATS
    formats = root.find(f"{_MAIN}cellXfs")
    return {k for k, x in enumerate(formats if formats is not None else ()) if shows(int(x.get("numFmtId") or 0))}


def first_day(book: zipfile.ZipFile) -> dt.datetime:
    """Day 0 of the workbook's dates."""
    kind = ElementTree.fromstring(book.read("xl/workbook.xml")).find(f"{_MAIN}workbookPr")
    return dt.datetime(1904, 1, 1) if kind is not None and kind.get("date1904") in ("1", "true") else dt.datetime(1899, 12, 30)


def moment_text(days: str, zero: dt.datetime) -> str:
    """A date, or date and time where the number has a fraction; the number itself where it is no date."""
    try:
        moment = zero + dt.timedelta(milliseconds=round(float(days) * 86_400_000))
    except (ValueError, OverflowError):
        return days
    return moment.date().isoformat() if moment.time() == dt.time() else moment.replace(microsecond=0).isoformat(" ")


#: Bytes of XML in a piece; a longer row makes a longer piece. Rows are numbered within pieces below ROWS.
PIECE, ROWS = 1 << 20, 1 << 20


def xml_pieces(stream, tag: str, size: int = PIECE):
    """Yield XML documents of the elements ``tag`` of a part, some at a time, each in the part's own root element."""
    closes = re.compile(rf"</(?:\w+:)?{tag}>|<(?:\w+:)?{tag}(?:\s[^>]*)?/>".encode())
    opens = re.compile(rf"<(?:\w+:)?{tag}[\s/>]".encode())
    held, root, end = b"", None, b""
    while True:
        more = stream.read(size)
        held += more
        if root is None:
            at = opens.search(held)
            if at:
                # The first element that isn't a declaration or a comment carries the names of the part.
                m = re.search(rb"<([A-Za-z][\w:.-]*)(\s[^>]*)?>", held)
                root, end, held = m[0], b"</" + m[1] + b">", held[at.start() :]
        if root is not None:
            last = None
            for last in closes.finditer(held):
                pass
            if last:
                yield root + held[: last.end()] + end
                held = held[last.end() :]
        if not more:
            return


def _pieces(size: int = PIECE):
    """Task function: (path, content) of workbooks to their pieces."""

    def run(batches):
        for batch in batches:
            for file, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                with zipfile.ZipFile(io.BytesIO(data.as_py())) as book:
                    dates, zero = sorted(date_styles(book)), first_day(book).isoformat()
                    if "xl/sharedStrings.xml" in book.namelist():
                        first = 0
                        with book.open("xl/sharedStrings.xml") as stream:
                            for k, xml in enumerate(xml_pieces(stream, "si", size)):
                                yield _piece(file, None, -1, k, first, xml, dates, zero)
                                first += len(re.findall(rb"<(?:\w+:)?si[\s/>]", xml))
                    for place, (name, part) in enumerate(sheet_files(book).items()):
                        with book.open(part) as stream:
                            for k, xml in enumerate(xml_pieces(stream, "row", size)):
                                yield _piece(file, name, place, k, k * ROWS, xml, dates, zero)

    return run, "file string, sheet string, place int, piece int, first long, xml binary, dates array<int>, zero string"


def _piece(*values) -> pa.RecordBatch:
    kinds = {"file": pa.string(), "sheet": pa.string(), "place": pa.int32(), "piece": pa.int32(), "first": pa.int64(), "xml": pa.binary(), "dates": pa.list_(pa.int32()), "zero": pa.string()}
    return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds.values(), strict=True)], list(kinds))


def _strings(batches):
    """Shared strings of pieces: (file, number, text)."""
    for batch in batches:
        for row in batch.to_pylist():
            texts = ["".join(t.text or "" for t in si.iter() if t.tag.endswith("}t") and not t.tag.endswith("}rPh")) for si in ElementTree.fromstring(row["xml"])]
            yield pa.RecordBatch.from_arrays([pa.array([row["file"]] * len(texts), pa.string()), pa.array(range(row["first"], row["first"] + len(texts)), pa.int64()), pa.array(texts, pa.string())], ["file", "number", "text"])


def _rows(batches):
    """Rows of pieces: the cells' texts, and the numbers of those that are shared strings."""
    for batch in batches:
        for piece in batch.to_pylist():
            dates, zero = set(piece["dates"]), dt.datetime.fromisoformat(piece["zero"])
            cells, shared = [], []
            for row in ElementTree.fromstring(piece["xml"]):
                own: list[str | None] = []
                numbers: list[int | None] = []
                for c in row.iter(f"{_MAIN}c"):
                    at = _place(c.get("r")) if c.get("r") else len(own)
                    own += [None] * (at + 1 - len(own))
                    numbers += [None] * (at + 1 - len(numbers))
                    value, kind = c.find(f"{_MAIN}v"), c.get("t")
                    text = value.text if value is not None else None
                    if kind == "inlineStr":
                        own[at] = "".join(t.text or "" for t in c.iter(f"{_MAIN}t"))
                    elif kind == "s" and text:
                        numbers[at] = int(text)
                    elif kind == "b" and text:
                        own[at] = "TRUE" if text.strip() == "1" else "FALSE"
                    else:
                        own[at] = moment_text(text, zero) if text and kind in (None, "n") and int(c.get("s") or 0) in dates else text
                cells.append(own)
                shared.append(numbers)
            n = len(cells)
            yield pa.RecordBatch.from_arrays([pa.array([piece["file"]] * n), pa.array([piece["sheet"]] * n), pa.array([piece["place"]] * n, pa.int32()), pa.array(range(piece["first"], piece["first"] + n), pa.int64()), pa.array(cells, pa.list_(pa.string())), pa.array(shared, pa.list_(pa.int64()))], ["file", "sheet", "place", "row", "cells", "shared"])


def workbook_cells(books: DataFrame, piece: int = PIECE) -> DataFrame:
    """(file, sheet, place, row, cells) of workbooks given as (path, content); ``row`` ascends within a sheet."""
    spark = books.sparkSession
    wide = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = materialized(books.mapInArrow(*_pieces(piece)).repartition(wide))
    strings = found.filter("place < 0").mapInArrow(_strings, "file string, number long, text string")
    rows = materialized(found.filter("place >= 0").mapInArrow(_rows, "file string, sheet string, place int, row long, cells array<string>, shared array<bigint>"))
    asked = rows.select("file", "place", "row", F.posexplode("shared").alias("at", "number")).filter("number IS NOT NULL")
    texts = asked.join(strings, ["file", "number"]).groupBy("file", "place", "row").agg(F.map_from_entries(F.collect_list(F.struct("at", "text"))).alias("texts"))
    return rows.join(texts, ["file", "place", "row"], "left").select("file", "sheet", "place", "row", F.transform("cells", lambda c, at: F.coalesce(c, F.try_element_at("texts", at))).alias("cells"))


def workbook_bytes(sheets: dict[str, list[list]]) -> bytes:
    """A workbook of texts, numbers, booleans and empty cells, for what a task holds anyway."""
    names = f'xmlns="{_MAIN[1:-1]}" xmlns:r="{_LINK[1:].split("}")[0]}"'
    strings: dict[str, int] = {}

    def cell(value) -> str:
        if isinstance(value, bool):
            return f'<c t="b"><v>{int(value)}</v></c>'
        if isinstance(value, str):
            return f'<c t="s"><v>{strings.setdefault(value, len(strings))}</v></c>'
        return "<c/>" if value is None else f"<c><v>{value!r}</v></c>"

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        links = "".join(f'<sheet name={quoteattr(n)} sheetId="{k}" r:id="rId{k}"/>' for k, n in enumerate(sheets, 1))
        book.writestr("xl/workbook.xml", f"<workbook {names}><sheets>{links}</sheets></workbook>")
        parts = "".join(f'<Relationship Id="rId{k}" Target="worksheets/sheet{k}.xml"/>' for k in range(1, len(sheets) + 1))
        book.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{parts}</Relationships>')
        for k, rows in enumerate(sheets.values(), 1):
            book.writestr(f"xl/worksheets/sheet{k}.xml", f"<worksheet {names}><sheetData>" + "".join(f"<row>{''.join(map(cell, row))}</row>" for row in rows) + "</sheetData></worksheet>")
        book.writestr("xl/sharedStrings.xml", f"<sst {names}>" + "".join(f'<si><t xml:space="preserve">{escape(t)}</t></si>' for t in strings) + "</sst>")
    return out.getvalue()


def cast_dates_and_flags(df: DataFrame) -> DataFrame:
    """Text columns of ISO dates, times, or TRUE and FALSE only as dates, timestamps or booleans, in one aggregate."""
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, StringType)]
    if not texts:
        return df
    shapes = {"date": r"^\d{4}-\d{2}-\d{2}$", "timestamp_ntz": r"^\d{4}-\d{2}-\d{2}( \d{2}:\d{2}:\d{2})?$", "boolean": "^(TRUE|FALSE)$"}
    counts = df.agg(*[F.struct(F.count(col(c)).alias("n"), *[F.count_if(col(c).rlike(p)).alias(k) for k, p in shapes.items()]).alias(f"c{i}") for i, c in enumerate(texts)]).first()
    kinds = {c: next((k for k in shapes if counts[f"c{i}"]["n"] and counts[f"c{i}"][k] == counts[f"c{i}"]["n"]), None) for i, c in enumerate(texts)}
    return df.withColumns({c: col(c).try_cast(k) for c, k in kinds.items() if k}) if any(kinds.values()) else df


def read_sheets(spark: SparkSession, path: str, old: bool = False) -> dict[str, DataFrame]:
    """Each sheet of a workbook (``old``: .xls) as a typed table, by its name; of several files by file and name."""
    from .xls import old_workbook_cells

    books = spark.read.format("binaryFile").load(path).select("path", "content")
    return sheets_of(old_workbook_cells(books) if old else workbook_cells(books))


def sheets_of(cells: DataFrame) -> dict[str, DataFrame]:
    """``read_sheets`` of (file, sheet, place, row, cells)."""
    cells = materialized(cells)
    out = {}
    widths = cells.groupBy("file", "place", "sheet").agg(F.max(F.size("cells")).alias("width")).orderBy("file", "place").collect()
    several = len({r.file for r in widths}) > 1
    for file, place, sheet, width in widths:
        if width > 0:
            own = cells.filter((F.col("file") == file) & (F.col("place") == place))
            grid = own.select("row", *[F.nullif(F.trim(F.get("cells", F.lit(k))), F.lit("")).alias(f"column_{k + 1}") for k in range(width)])
            out[f"{posixpath.basename(file)}:{sheet}" if several else sheet] = cast_dates_and_flags(cast_numeric_like(promote_header(grid, "row")))
    return out


def read_workbook(spark: SparkSession, path: str, old: bool = False) -> DataFrame:
    """All sheets of a workbook (``old``: .xls) as one table."""
    return combine_sheets(read_sheets(spark, path, old))
