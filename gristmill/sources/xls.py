"""Old workbooks (.xls): compound files with a stream of binary records.

Spark lists and reads the files; a task reads one whole, as the format ends at 65,536 rows a sheet.
Cells are texts as in other workbooks. Formulas show their stored results, errors read as empty.
Encrypted workbooks and those from before 1997 are refused.
"""

from __future__ import annotations

import datetime as dt
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .xlsx import DATE_FORMATS, moment_text

MAGIC = bytes.fromhex("d0cf11e0a1b11ae1")
# The records' numbers.
BOF, EOF, CONTINUE, FILEPASS, DATEMODE, BOUNDSHEET, SST, FORMAT, XF = 0x809, 0x0A, 0x3C, 0x2F, 0x22, 0x85, 0xFC, 0x41E, 0xE0
NUMBER, RK, MULRK, LABELSST, LABEL, BOOLERR, FORMULA, STRING = 0x203, 0x27E, 0xBD, 0xFD, 0x204, 0x205, 0x06, 0x207
_END = 0xFFFFFFFA  # sector numbers from here on end chains
ROWS_AT_ONCE = 2000


def stream(content: bytes, names: tuple[str, ...] = ("Workbook",)) -> bytes:
    """A named stream of a compound file, from its chain of sectors."""
    if not content.startswith(MAGIC):
        raise ValueError("not a compound file")
    sector, small = 1 << struct.unpack_from("<H", content, 30)[0], 1 << struct.unpack_from("<H", content, 32)[0]
    first_entry, cutoff, first_small, first_more = (struct.unpack_from("<I", content, k)[0] for k in (48, 56, 60, 68))
    at = lambda n: content[sector * (n + 1) : sector * (n + 2)]
    numbers = lambda data: list(struct.unpack(f"<{len(data) // 4}I", data[: len(data) // 4 * 4]))
    tables = [n for n in numbers(content[76:512]) if n < _END]
    while first_more < _END:
        *more, first_more = numbers(at(first_more))
        tables += [n for n in more if n < _END]
    following = [n for t in tables for n in numbers(at(t))]

    def chain(n: int, links: list[int], piece) -> bytes:
        out, seen = [], 0
        while n < _END and seen <= len(links):
            out.append(piece(n))
            n, seen = links[n], seen + 1
        return b"".join(out)

    entries = chain(first_entry, following, at)
    found: dict[str, tuple[int, int]] = {}
    for k in range(0, len(entries), 128):
        length = struct.unpack_from("<H", entries, k + 64)[0]
        if length >= 2:
            found[entries[k : k + length - 2].decode("utf-16le", "replace")] = struct.unpack_from("<II", entries, k + 116)
    name = next((n for n in names if n in found), None)
    if name is None:
        raise ValueError("a workbook from before 1997" if "Book" in found else "no workbook in the file")
    start, size = found[name]
    if size >= cutoff:
        return chain(start, following, at)[:size]
    # Short streams lie in small sectors of the root's stream.
    root = chain(found["Root Entry"][0], following, at)
    return chain(start, numbers(chain(first_small, following, at)), lambda n: root[small * n : small * (n + 1)])[:size]


def records(data: bytes, at: int = 0) -> Iterator[tuple[int, list[bytes]]]:
    """(number, parts) of the records of one substream, its parts being its own bytes and those of records that continue it."""
    held: tuple[int, list[bytes]] | None = None
    depth = 0
    while at + 4 <= len(data):
        kind, size = struct.unpack_from("<HH", data, at)
        part, at = data[at + 4 : at + 4 + size], at + 4 + size
        if kind == CONTINUE and held:
            held[1].append(part)
            continue
        if held and depth == 1:
            yield held
        depth += (kind == BOF) - (kind == EOF)
        held = (kind, [part])
        if not depth:
            return


class _Parts:
    """Bytes that run over several parts; the characters of a text state their width anew in each."""

    def __init__(self, parts: list[bytes]):
        self.parts, self.part, self.at = parts, 0, 0

    def take(self, n: int) -> bytes:
        out = b""
        while n:
            here = self.parts[self.part][self.at : self.at + n]
            out, n, self.at = out + here, n - len(here), self.at + len(here)
            if n:
                self.part, self.at = self.part + 1, 0
        return out

    def text(self, n: int, wide: int) -> str:
        out = ""
        while n:
            if self.at >= len(self.parts[self.part]):
                self.part, self.at = self.part + 1, 1
                wide = self.parts[self.part][0] & 1
            room = (len(self.parts[self.part]) - self.at) // (1 + wide)
            some = min(n, room)
            out += self.take(some * (1 + wide)).decode("utf-16le" if wide else "latin-1", "replace")
            n -= some
        return out

    def string(self, size: str = "<H") -> str:
        """A text with its length, and whatever formats and phonetics follow it."""
        n = struct.unpack(size, self.take(struct.calcsize(size)))[0]
        flags = self.take(1)[0]
        runs = struct.unpack("<H", self.take(2))[0] if flags & 8 else 0
        more = struct.unpack("<I", self.take(4))[0] if flags & 4 else 0
        out = self.text(n, flags & 1)
        self.take(4 * runs + more)
        return out


def _rk(value: int) -> float:
    out = float((value if value < 1 << 31 else value - (1 << 32)) >> 2) if value & 2 else struct.unpack("<d", struct.pack("<Q", (value & ~3) << 32))[0]
    return out / 100 if value & 1 else out


def _shown(number: float) -> str:
    return str(int(number)) if number.is_integer() and abs(number) < 1e15 else repr(number)


class Workbook:
    """What all sheets share: their names and places, strings, and which cell styles show dates."""

    def __init__(self, data: bytes):
        self.data, self.sheets, self.strings, formats, styles = data, [], [], {}, []
        self.zero = dt.datetime(1899, 12, 30)
        for kind, parts in records(data):
            own = parts[0]
            if kind == FILEPASS:
                raise ValueError("an encrypted workbook")
            if kind == DATEMODE and struct.unpack_from("<H", own)[0]:
                self.zero = dt.datetime(1904, 1, 1)
            elif kind == BOUNDSHEET and own[5] == 0:
                self.sheets.append((_Parts([own[6:]]).string("<B"), struct.unpack_from("<I", own)[0]))
            elif kind == SST:
                held = _Parts(parts)
                _, n = struct.unpack("<II", held.take(8))
                self.strings = [held.string() for _ in range(n)]
            elif kind == FORMAT:
                formats[struct.unpack_from("<H", own)[0]] = re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", _Parts([own[2:]]).string())
            elif kind == XF:
                styles.append(struct.unpack_from("<H", own, 2)[0])
        self.dates = {k for k, f in enumerate(styles) if (re.search("[ymdhs]", formats[f].lower()) if f in formats else f in DATE_FORMATS)}

    def rows(self, offset: int) -> Iterator[tuple[int, list[str | None]]]:
        """(row, cells) of the rows of a sheet that have cells, in the order of the file's blocks of rows."""
        cells: dict[int, dict[int, str | None]] = {}
        waiting: tuple[int, int] | None = None

        def number(row: int, column: int, style: int, value: float) -> None:
            cells.setdefault(row, {})[column] = moment_text(repr(value), self.zero) if style in self.dates else _shown(value)

        for kind, parts in records(self.data, offset):
            own = parts[0]
            if kind in (NUMBER, RK, LABELSST, LABEL, BOOLERR, FORMULA):
                row, column, style = struct.unpack_from("<HHH", own)
            if kind == NUMBER:
                number(row, column, style, struct.unpack_from("<d", own, 6)[0])
            elif kind == RK:
                number(row, column, style, _rk(struct.unpack_from("<I", own, 6)[0]))
            elif kind == MULRK:
                row, column = struct.unpack_from("<HH", own)
                for k in range((len(own) - 6) // 6):
                    style, value = struct.unpack_from("<HI", own, 4 + 6 * k)
                    number(row, column + k, style, _rk(value))
            elif kind == LABELSST:
                cells.setdefault(row, {})[column] = self.strings[struct.unpack_from("<I", own, 6)[0]]
            elif kind == LABEL:
                cells.setdefault(row, {})[column] = _Parts([own[6:], *parts[1:]]).string()
            elif kind == BOOLERR and not own[7]:
                cells.setdefault(row, {})[column] = "TRUE" if own[6] else "FALSE"
            elif kind == FORMULA:
                if own[12:14] != b"\xff\xff":
                    number(row, column, style, struct.unpack_from("<d", own, 6)[0])
                elif own[6] == 0:
                    waiting = row, column
                elif own[6] == 1:
                    cells.setdefault(row, {})[column] = "TRUE" if own[8] else "FALSE"
            elif kind == STRING and waiting:
                cells.setdefault(waiting[0], {})[waiting[1]] = _Parts(parts).string()
                waiting = None
        for row in sorted(cells):
            yield row, [cells[row].get(k) for k in range(max(cells[row]) + 1)]


def old_workbook_cells(books: DataFrame) -> DataFrame:
    """(file, sheet, place, row, cells) of old workbooks given as (path, content)."""
    kinds = {"file": pa.string(), "sheet": pa.string(), "place": pa.int32(), "row": pa.int64(), "cells": pa.list_(pa.string())}

    def read(batches):
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                book = Workbook(stream(content.as_py()))
                for place, (sheet, offset) in enumerate(book.sheets):
                    held = [(file, sheet, place, row, cells) for row, cells in book.rows(offset)]
                    for k in range(0, len(held), ROWS_AT_ONCE):
                        yield pa.RecordBatch.from_arrays([pa.array(list(v), t) for v, t in zip(zip(*held[k : k + ROWS_AT_ONCE], strict=True), kinds.values(), strict=True)], list(kinds))

    return books.mapInArrow(read, "file string, sheet string, place int, row long, cells array<string>")
