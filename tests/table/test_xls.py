import datetime as dt
import random
import struct

import pytest

from gristmill.sources import xls
from gristmill.sources.readers import read_dataset


def record(kind, data, most=8224):
    out = struct.pack("<HH", kind, len(data[:most])) + data[:most]
    for k in range(most, len(data), most):
        out += struct.pack("<HH", xls.CONTINUE, len(data[k : k + most])) + data[k : k + most]
    return out


def text(value, size="<H"):
    wide = any(ord(c) > 255 for c in value)
    return struct.pack(size, len(value)) + bytes([wide]) + value.encode("utf-16le" if wide else "latin-1")


def shared(strings, most):
    """A table of strings over records of ``most`` bytes: texts are cut between characters and state their width again, some with formats and phonetics behind them."""
    parts, part = [], bytearray(struct.pack("<II", len(strings), len(strings)))
    for k, value in enumerate(strings):
        wide, rich, far = any(ord(c) > 255 for c in value), k % 3 == 1, k % 5 == 2
        head = struct.pack("<HB", len(value), wide | 8 * rich | 4 * far) + (struct.pack("<H", 2) if rich else b"") + (struct.pack("<I", 3) if far else b"")
        if len(part) + len(head) > most:
            parts, part = [*parts, bytes(part)], bytearray()
        part += head
        for c in value:
            if len(part) + 1 + wide > most:
                parts, part = [*parts, bytes(part)], bytearray([wide])
            part += c.encode("utf-16le" if wide else "latin-1")
        for b in b"\7" * (8 * rich + 3 * far):
            if len(part) + 1 > most:
                parts, part = [*parts, bytes(part)], bytearray()
            part.append(b)
    parts = [*parts, bytes(part)]
    return b"".join(struct.pack("<HH", xls.SST if k == 0 else xls.CONTINUE, len(p)) + p for k, p in enumerate(parts))


def book(sheets, most=8224, extra=b""):
    """The records of a workbook; cells are texts, numbers, booleans, dates, ("formula", value) or None."""
    strings = list(dict.fromkeys(v for rows in sheets.values() for row in rows for v in row if isinstance(v, str)))
    bof = lambda kind: record(xls.BOF, struct.pack("<HHHH", 0x600, kind, 0, 0) + bytes(8))
    styles = b"".join(record(xls.XF, struct.pack("<HH", 0, f) + bytes(16)) for f in (0, 14, 164))
    front = bof(5) + extra + record(xls.FORMAT, struct.pack("<H", 164) + text("dd/mm/yyyy hh:mm")) + styles + shared(strings, most)
    bodies = []
    for rows in sheets.values():
        out = bof(0x10)
        for r, row in enumerate(rows):
            for c, v in enumerate(row):
                at = struct.pack("<HHH", r, c, 0)
                if isinstance(v, str):
                    out += record(xls.LABELSST, at + struct.pack("<I", strings.index(v)))
                elif isinstance(v, bool):
                    out += record(xls.BOOLERR, at + bytes([v, 0]))
                elif isinstance(v, tuple):
                    if isinstance(v[1], str):
                        out += record(xls.FORMULA, at + b"\0\0\0\0\0\0\xff\xff" + bytes(8)) + record(xls.STRING, text(v[1]), most)
                    else:
                        out += record(xls.FORMULA, at + struct.pack("<d", v[1]) + bytes(8))
                elif isinstance(v, dt.datetime):
                    out += record(xls.NUMBER, struct.pack("<HHH", r, c, 2) + struct.pack("<d", (v - dt.datetime(1899, 12, 30)) / dt.timedelta(days=1)))
                elif isinstance(v, dt.date):
                    out += record(xls.RK, struct.pack("<HHHI", r, c, 1, (v - dt.date(1899, 12, 30)).days << 2 | 2))
                elif isinstance(v, int):
                    out += record(xls.MULRK, struct.pack("<HHHIH", r, c, 0, (v * 100 << 2 | 3) & 0xFFFFFFFF, c))
                elif v is not None:
                    out += record(xls.NUMBER, at + struct.pack("<d", v))
        bodies.append(out + bof(0x20) + record(xls.NUMBER, struct.pack("<HHHd", 0, 0, 0, 9.0)) + record(xls.EOF, b"") + record(xls.EOF, b""))  # a chart's own records don't count
    size = len(front) + sum(4 + 8 + len(n) * (1 + any(ord(c) > 255 for c in n)) for n in sheets) + 4
    links = b""
    for name, body in zip(sheets, bodies):
        links += record(xls.BOUNDSHEET, struct.pack("<IBB", size, 0, 0) + text(name, "<B"))
        size += len(body)
    return front + links + record(xls.EOF, b"") + b"".join(bodies)


def compound(data, shuffle=1):
    """A compound file of sectors in random order; streams below 4,096 bytes lie in small sectors."""
    r, sectors, links = random.Random(shuffle), {}, {}
    short = len(data) < 4096

    def store(content, places):
        for k, place in enumerate(places):
            sectors[place] = content[512 * k : 512 * k + 512].ljust(512, b"\0")
            links[place] = places[k + 1] if k + 1 < len(places) else 0xFFFFFFFE
        return places[0]

    count = -(-len(data) // 512)
    tables = -(-(count + 20) // 128)
    free = list(range(tables, tables + count + 3))
    r.shuffle(free)
    if short:
        small = -(-len(data) // 64)
        first = store(data.ljust(64 * small, b"\0"), free[: -(-64 * small // 512)])
        table = struct.pack(f"<{small}I", *[*range(1, small), 0xFFFFFFFE])
        first_small = store(table, free[count + 1 : count + 2])
        root, start = (first, 64 * small), 0
    else:
        root, start, first_small = (0xFFFFFFFE, 0), store(data, free[:count]), 0xFFFFFFFE
    entry = lambda name, kind, at, size: (name.encode("utf-16le").ljust(64, b"\0") + struct.pack("<HBB", 2 * len(name) + 2, kind, 0) + b"\xff" * 12 + bytes(36) + struct.pack("<II", at, size) + bytes(4)).ljust(128, b"\0")
    entries = store(entry("Root Entry", 5, *root) + entry("Workbook", 2, start, len(data)), free[count : count + 1])
    fat = [links.get(k, 0xFFFFFFFF) for k in range(tables * 128)]
    fat[:tables] = [0xFFFFFFFD] * tables
    for k in range(tables):
        sectors[k] = struct.pack("<128I", *fat[128 * k : 128 * k + 128])
    head = xls.MAGIC + bytes(16) + struct.pack("<HHHHH", 0x3E, 3, 0xFFFE, 9, 6) + bytes(6) + struct.pack("<IIIIIIIIII", 0, tables, entries, 0, 4096, first_small, int(short), 0xFFFFFFFE, 0, 0)[:36]
    head = head[:76].ljust(76, b"\0") + struct.pack("<109I", *[*range(tables), *[0xFFFFFFFF] * (109 - tables)])
    return head + b"".join(sectors.get(k, bytes(512)) for k in range(max(sectors) + 1))


ROWS = [["Item Name", "Sold Date", "Seen Time", "Is Open", "Item Count", "Share Value", "Result Text"]] + [
    [f"näme {i} {'日本' * (i % 4)}", dt.date(2023, 1, 1) + dt.timedelta(days=i), dt.datetime(2023, 1, 1, 12) + dt.timedelta(hours=i), i % 2 == 0, i - 3, i + 0.25, ("formula", f"r{i}" if i % 2 else i * 1.5)] for i in range(60)
]


@pytest.mark.parametrize("most", [40, 8224])
def test_cells_of_an_old_workbook(spark, tmp_path, most):
    (tmp_path / "a.xls").write_bytes(compound(book({"Täble": ROWS}, most), most))
    df, info = read_dataset(spark, f"{tmp_path}/a.xls")
    assert info["type"] == "workbook" and df.dtypes == [("Item Name", "string"), ("Sold Date", "date"), ("Seen Time", "timestamp_ntz"), ("Is Open", "boolean"), ("Item Count", "double"), ("Share Value", "double"), ("Result Text", "string")]
    want = [(r[0].strip(), *r[1:4], float(r[4]), r[5], r[6][1] if isinstance(r[6][1], str) else xls._shown(r[6][1])) for r in ROWS[1:]]
    assert sorted(map(tuple, df.collect())) == sorted(want)


def test_short_streams_and_several_sheets(spark, tmp_path):
    small = [["Organisation Name", "COS Used"], ["A", 3], ["B", None], ["C", 5.5]]
    content = compound(book({"Table 1": small, "Empty": [], "Table 2": small[:2]}))
    assert len(xls.stream(content)) < 4096
    (tmp_path / "s.xls").write_bytes(content)
    df, _ = read_dataset(spark, f"{tmp_path}/s.xls")
    assert sorted(map(str, map(tuple, df.collect()))) == ["('A', 3.0, 'Table 1')", "('A', 3.0, 'Table 2')", "('B', None, 'Table 1')", "('C', 5.5, 'Table 1')"]


def test_numbers_and_what_is_refused():
    assert [xls._rk(x) for x in (5 << 2 | 2, 1234 << 2 | 3, (-7 << 2 | 2) & 0xFFFFFFFF)] == [5.0, 12.34, -7.0]
    assert xls._rk(struct.unpack("<Q", struct.pack("<d", 1.5))[0] >> 32) == 1.5
    with pytest.raises(ValueError, match="encrypted"):
        xls.Workbook(book({"T": ROWS[:2]}, extra=record(xls.FILEPASS, bytes(4))))
    with pytest.raises(ValueError, match="compound"):
        xls.stream(b"PK\3\4")
