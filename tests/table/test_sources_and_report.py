import csv
import datetime as dt
import hashlib
import html
import json
import random
import re
import sys
import zipfile

import pytest

from gristmill import queries
from gristmill.plans import questions
from gristmill.plans.analyze import analyze, answer, ask, combined_quality, insight_rows
from gristmill.sources import xlsx
from gristmill.sources.grid import HEAD_BYTES, detect_delimiter, detect_encoding, find_header, header_names, read_delimited
from gristmill.sources.readers import profile_json, read_dataset, write_outputs
from gristmill.streaming.monthly import months_of, stream_windows


def test_header_below_a_title(spark, tmp_path):
    path = tmp_path / "r.csv"
    path.write_text('Report 2024,\nOrganisation Name,Total Count\n"North, East",5\nSouth,"1,018"\n,\nWest\n', encoding="utf-8-sig")
    df, info = read_delimited(spark, str(path))
    assert df.columns == ["Organisation Name", "Total Count"] and info["encoding"] == "utf-8" and info["delimiter"] == ","
    assert sorted(map(str, df.collect())) == sorted(["Row(Organisation Name='North, East', Total Count=5.0)", "Row(Organisation Name='South', Total Count=1018.0)", "Row(Organisation Name='West', Total Count=None)"])


def test_normal_header_delimiters_and_encodings(spark, tmp_path):
    path = tmp_path / "r.tsv"
    path.write_bytes("Customer Name\tTotal Revenue\nJosé\t1200\nÆsop\t3400\n".encode("cp1252"))
    df, info = read_dataset(spark, str(path), encoding="windows-1252")
    assert sorted(map(tuple, df.collect())) == [("José", 1200.0), ("Æsop", 3400.0)] and info["delimiter"] == "\t"
    assert detect_delimiter("a;b;c\n1;2;3\n") == ";" and detect_delimiter("", "\t") == "\t" and detect_delimiter("a|b\nc|d") == "|"
    assert detect_encoding(b"\xef\xbb\xbfa") == "utf-8" and detect_encoding("é".encode()) == "utf-8"
    assert header_names([" a  b ", None, "a b"]) == ["a b", "column_2", "a b_2"]
    assert find_header([["Title", None], ["note", None], ["x", None]]) is None and find_header([["a"], ["b"]]) is None


def test_late_wide_rows_and_quoted_breaks(spark, tmp_path):
    path = tmp_path / "wide.csv"
    path.write_text("Item Name,Item Count\n" + "a,1\n" * 30000 + "b,2,late\n")
    df, info = read_delimited(spark, str(path))
    assert df.count() == 30001 and df.filter("column_3 = 'late'").count() == 1 and df.columns[:2] == ["Item Name", "Item Count"]
    path = tmp_path / "breaks.csv"
    path.write_text('Item Name,Item Count,Note\n"a\n\nb",1,x\nc,2,"y, ""z"""\nd,3,"1\n2",more\n')
    df, info = read_delimited(spark, str(path))
    assert sorted(tuple(r)[:3] for r in df.collect()) == [("a\n\nb", 1.0, "x"), ("c", 2.0, 'y, "z"'), ("d", 3.0, "1\n2")]
    assert len(df.columns) == 4 and df.filter("`column_4` = 'more'").count() == 1


@pytest.fixture
def small_ranges(spark):
    """Byte ranges of some hundred bytes, so that small files are read by many tasks."""
    settings = {"spark.sql.files.maxPartitionBytes": "300", "spark.sql.files.openCostInBytes": "1"}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k in settings:
        spark.conf.unset(k)


def test_quoted_breaks_across_ranges(spark, tmp_path, small_ranges):
    """Cells with breaks, quotes and delimiters, some longer than several ranges: rows equal those of one reader over the whole file."""
    r = random.Random(3)
    cell = lambda: "".join(r.choice(["a", "b", ' "', "\n", ",", "é", '5" pipe', "\r\n", " "]) for _ in range(r.choice([0, 1, 3, 30, 900 if r.random() < 0.1 else 5])))
    rows = [[f"k{i}", cell(), str(i), cell()] for i in range(150)]
    path = tmp_path / "t.csv"
    with path.open("w", newline="") as f:
        f.write("Item Name,First Note,Total Count,Second Note\n")
        for row in rows:
            csv.writer(f, quoting=r.choice([csv.QUOTE_MINIMAL, csv.QUOTE_ALL]), lineterminator=r.choice(["\n", "\r\n"])).writerow(row)
        f.write('last,tail 5" wide,151,"open to the end\nof the file')
    df, info = read_delimited(spark, str(path), numbered=True)
    with path.open(newline="") as f:
        want = [[c.replace("\r\n", "\n").strip() or None for c in row] for row in csv.reader(f)][1:]
    got = df.orderBy("__row").collect()
    assert [[x["Item Name"], x["First Note"], x["Second Note"]] for x in got] == [[w[0], w[1], w[3]] for w in want] and len(want) == 151
    assert [x["Total Count"] for x in got] == [float(w[2]) for w in want] and [x["__row"] for x in got] == list(range(1, 152))
    assert len({x["__block"] for x in got}) > 10
    assert [x["Item Name"] for x in read_delimited(spark, str(path), max_rows=7)[0].collect()] == [w[0] for w in want[:7]]


def test_folders_have_a_header_in_each_file(spark, tmp_path):
    df = spark.range(1000).selectExpr("id AS order_id", "concat('name ', id, '\n\"q\"') AS customer_name", "id * 0.5 AS total_amount").repartition(4)
    write_outputs(df, csv_path=f"{tmp_path}/out.csv")
    back, info = read_dataset(spark, f"{tmp_path}/out.csv", fmt="csv")
    assert info["files"] == 4 and info["headers"] == 1 and back.dtypes == [("order_id", "double"), ("customer_name", "string"), ("total_amount", "double")]
    assert sorted(map(tuple, back.collect())) == sorted((float(i), f'name {i}\n"q"', i * 0.5) for i in range(1000))


def test_quoted_prose_has_no_delimiters(spark, tmp_path):
    """Line breaks and marks in quoted cells once made "|" the delimiter."""
    prose = "\n".join("Esoust | thntorti | ershha; andreoningth | edthth | hebleing" for _ in range(12))
    rows = [["1", "en", "Short."], ["2", "en", prose], ["3", "fr", 'He said "' + prose + '" twice'], ["4", "en", "Last."]]
    path = tmp_path / "t.csv"
    with path.open("w", newline="") as f:
        csv.writer(f, lineterminator="\n").writerows([["doc_id", "lang", "text"], *rows])
    df, info = read_delimited(spark, str(path))
    assert info["delimiter"] == "," and df.columns == ["doc_id", "lang", "text"]
    assert sorted(tuple(r) for r in df.collect()) == [(float(i), a, t) for i, a, t in rows]
    assert detect_delimiter(f'a,b\n1,"{prose}') == "," and detect_delimiter(f'"a|b";c\n"{prose}";d\n') == ";"


@pytest.mark.parametrize("before", range(4))
def test_a_head_that_ends_inside_a_character_is_utf8(monkeypatch, before):
    monkeypatch.setitem(sys.modules, "charset_normalizer", None)  # a guess isn't needed
    assert detect_encoding(("x" * before + "é" * HEAD_BYTES).encode()[:HEAD_BYTES]) == "utf-8"
    assert detect_encoding(("x" * before + "日" * HEAD_BYTES).encode()[:HEAD_BYTES]) == "utf-8"
    assert detect_encoding(("x" * before + "abcdefgh café").encode("latin-1")) == "iso-8859-1"


def test_delimited_folder_keeps_odd_cells(spark, tmp_path, small_ranges):
    """What trimming, numbers in doubles and nulls for empty cells once changed."""
    texts = [None, "", " \n\t ", "12", "\u3000wide\xa0", "\x01ctrl\x1f", "nul \0 within\0", "\ufeffmark", "a\rb\r\nc", '"', '""', ',"a', 'back\\"slash\\', "#note", "NaN", "1e5", "\u2028line\x85", "long " * 300 + '",\n"' + "é" * 500, "null", "\\N", "'q'|;\t"]
    rows = [((1 << 53) + 1 + i, [None, "", " de ", "7"][i % 4], str(i % 20), t) for i, t in enumerate(texts)]
    rows += [(None, None, None, None)] + [(i, "en", "007", str(i)) for i in range(200)]
    spark.createDataFrame(rows, "doc_id long, lang string, source string, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    letters = lambda t: None if t is None else hashlib.md5(re.sub("[\x09-\x0d\x20]+", "", t).encode()).hexdigest()
    got = queries.delimited_folder(spark, str(tmp_path))
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(str((i, a, s, letters(t))) for i, a, s, t in rows)
    assert got.dtypes == [("doc_id", "bigint"), ("lang", "string"), ("source", "string"), ("letters", "string")]


def test_headers_that_differ_line_up(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Customer Name,Total Count\nann,1\nbob,2\n")
    (tmp_path / "b.csv").write_text("Report of May,\nTotal Count,Customer Name,Status\n3,cid,new\nx,dot,old\n")
    (tmp_path / "c.csv").write_text("Customer Name,Total Count\n")
    (tmp_path / "d.csv").write_text("")
    df, info = read_delimited(spark, str(tmp_path), numbered=True)
    assert df.drop("__row", "__block").columns == ["Customer Name", "Total Count", "Status"] and info["files"] == 3
    assert [tuple(r)[:3] for r in df.orderBy("__row").collect()] == [("ann", "1", None), ("bob", "2", None), ("cid", "3", "new"), ("dot", "x", "old")]
    plain, _ = read_delimited(spark, str(tmp_path / "a.csv"), header=False)
    assert plain.columns == ["column_1", "column_2"] and plain.count() == 3
    empty, _ = read_delimited(spark, str(tmp_path / "d.csv"))
    assert empty.columns == [] or empty.count() == 0


def test_wide_encodings(spark, tmp_path):
    (tmp_path / "w.csv").write_bytes("Customer Name;Total Count\n\"é\nß\";5\n日本;6\n".encode("utf-16"))
    df, info = read_delimited(spark, str(tmp_path / "w.csv"))
    assert sorted(map(tuple, df.collect())) == [("é\nß", 5.0), ("日本", 6.0)] and info["delimiter"] == ";"


JSON_ROWS = [{"a": i, "s": s, "n": {"x": [i, {"y": "}{"}]}} for i, s in enumerate(['plain', 'br}ace', 'q"uote', 'back\\\\slash\\\\', 'é{[', ',] [', 'long ' * 90, 'new\nline', '\\"'] * 12)]


@pytest.mark.parametrize("form", ["lines", "array", "pretty", "objects", "one line of objects", "folder"])
def test_json_forms(spark, tmp_path, small_ranges, form):
    texts = [json.dumps(x, ensure_ascii=False) for x in JSON_ROWS]
    path = tmp_path / "t.json"
    if form == "folder":
        path.mkdir()
        (path / "1.json").write_text("\n".join(texts[:50]))
        (path / "2.json").write_text(json.dumps(JSON_ROWS[50:], indent=1))
    else:
        path.write_text({"lines": "\n".join(texts) + "\n", "array": json.dumps(JSON_ROWS), "pretty": "\ufeff " + json.dumps(JSON_ROWS, indent=2) + "\n", "objects": "\n\n".join(json.dumps(x, indent=1) for x in JSON_ROWS), "one line of objects": " ".join(texts)}[form])
    df, info = read_dataset(spark, str(path), numbered=True)
    got = df.orderBy("__row").collect()
    assert info["form"] == ("lines" if form == "lines" else "objects") and [x["__row"] for x in got] == list(range(len(JSON_ROWS)))
    assert [(x.a, x.s) for x in got] == [(x["a"], x["s"]) for x in JSON_ROWS] and len({x["__block"] for x in got}) > 5
    assert [x.a for x in read_dataset(spark, str(path), max_rows=3)[0].collect()] == [0, 1, 2]


def test_json_that_is_no_object_is_not_lost(spark, tmp_path):
    (tmp_path / "t.json").write_text('[{"a": 1}, 7, {"a": 2}, "x}", [{"a": 3}], {"a": 4')
    df, _ = read_dataset(spark, str(tmp_path / "t.json"))
    assert sorted(x.a for x in df.filter("a IS NOT NULL").collect()) in ([1, 2], [1, 2, 4]) and df.filter("_corrupt_record IS NOT NULL").count() >= 2
    (tmp_path / "e.json").write_text("")
    assert read_dataset(spark, str(tmp_path / "e.json"))[0].count() == 0


def test_formats_and_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "x", [1, 2]), (2, None, [3])], "id long, name string, parts array<int>")
    write_outputs(df, f"{tmp_path}/a.parquet", f"{tmp_path}/a.csv")
    assert read_dataset(spark, f"{tmp_path}/a.parquet")[0].count() == 2
    assert read_dataset(spark, f"{tmp_path}/a.csv", fmt="csv")[0].columns == ["id", "name", "parts"]
    (tmp_path / "b.json").write_text('[{"a": 1}, {"a": 2}]')
    assert read_dataset(spark, f"{tmp_path}/b.json")[0].count() == 2 and read_dataset(spark, f"{tmp_path}/b.json", max_rows=1)[0].count() == 1
    with pytest.raises(ValueError):
        read_dataset(spark, "x.doc")
    assert json.loads(profile_json({"b": dt.date(2024, 1, 1), "a": 1})) == {"a": 1, "b": "2024-01-01"}


def workbook(path, sheets):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f"<workbook {ns}><sheets>" + "".join(f'<sheet name="{n}" sheetId="{k}" r:id="rId{k}"/>' for k, n in enumerate(sheets, 1)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="rId{k}" Target="worksheets/sheet{k}.xml"/>' for k in range(1, len(sheets) + 1)) + "</Relationships>")
        strings: list[str] = []
        for k, rows in enumerate(sheets.values(), 1):
            out = []
            for r, row in enumerate(rows, 1):
                cells = []
                for c, v in enumerate(row):
                    if isinstance(v, str):
                        strings.append(v)
                        cells.append(f'<c r="{chr(65 + c)}{r}" t="s"><v>{len(strings) - 1}</v></c>')
                    elif v is not None:
                        cells.append(f'<c r="{chr(65 + c)}{r}"><v>{v}</v></c>')
                out.append(f'<row r="{r}">{"".join(cells)}</row>')
            z.writestr(f"xl/worksheets/sheet{k}.xml", f"<worksheet {ns}><sheetData>{''.join(out)}</sheetData></worksheet>")
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}>" + "".join(f"<si><t>{s}</t></si>" for s in strings) + "</sst>")


def test_workbook(spark, tmp_path):
    path = f"{tmp_path}/w.xlsx"
    rows = [["Organisation Name", "COS Used"], ["A", 3], ["B", None], ["C", 5.5]]
    workbook(path, {"Table 1": rows, "Empty": [], "Table 2": rows[:2]})
    df, _ = read_dataset(spark, path)
    assert df.columns == ["Organisation Name", "COS Used", "Sheet"]
    assert sorted(map(str, df.collect())) == ["Row(Organisation Name='A', COS Used=3.0, Sheet='Table 1')", "Row(Organisation Name='A', COS Used=3.0, Sheet='Table 2')", "Row(Organisation Name='B', COS Used=None, Sheet='Table 1')", "Row(Organisation Name='C', COS Used=5.5, Sheet='Table 1')"]


def test_workbook_dates_and_flags(spark, tmp_path):
    path = f"{tmp_path}/d.xlsx"
    workbook(path, {"T": [["Item Name", "Sold Date", "Seen Time", "Is Open"], ["A", 1, 1, 1], ["B", 1, 1, 1]]})
    rows = '<row r="1">' + "".join(f'<c r="{c}1" t="inlineStr"><is><t>{n}</t></is></c>' for c, n in zip("ABCD", ("Item Name", "Sold Date", "Seen Time", "Is Open"))) + "</row>"
    for r, (name, day, time, flag) in enumerate([("A", 45123, 45123.5, 1), ("B", 45124, 45124.25, 0)], 2):
        rows += f'<row r="{r}"><c r="A{r}" t="inlineStr"><is><t>{name}</t></is></c><c r="B{r}" s="1"><v>{day}</v></c><c r="C{r}" s="2"><v>{time}</v></c><c r="D{r}" t="b"><v>{flag}</v></c></row>'
    with zipfile.ZipFile(path) as z:
        parts = {n: z.read(n) for n in z.namelist()}
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    parts["xl/worksheets/sheet1.xml"] = f"<worksheet {ns}><sheetData>{rows}</sheetData></worksheet>"
    parts["xl/styles.xml"] = f'<styleSheet {ns}><numFmts><numFmt numFmtId="164" formatCode="dd/mm/yy\\ hh:mm"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="164"/></cellXfs></styleSheet>'
    with zipfile.ZipFile(path, "w") as z:
        for n, content in parts.items():
            z.writestr(n, content)
    df, _ = read_dataset(spark, path)
    assert [t for _, t in df.dtypes] == ["string", "date", "timestamp_ntz", "boolean"]
    assert sorted(map(tuple, df.collect())) == [("A", dt.date(2023, 7, 16), dt.datetime(2023, 7, 16, 12), True), ("B", dt.date(2023, 7, 17), dt.datetime(2023, 7, 17, 6), False)]


def test_a_sheet_is_parsed_in_pieces(spark, tmp_path):
    """A workbook cut into small pieces reads as a whole, and its pieces lie in several partitions."""
    rows = [["Item Name", "Item Count", "Note Text"]] + [[f"item {i % 97}", i, f"<n&{i}>" if i % 3 else None] for i in range(3000)]
    rows = [[html.escape(c) if isinstance(c, str) else c for c in r] for r in rows]
    workbook(f"{tmp_path}/p.xlsx", {"One": rows, "Two": rows[:500]})
    books = spark.read.format("binaryFile").load(f"{tmp_path}/p.xlsx").select("path", "content")
    pieces = books.mapInArrow(*xlsx._pieces(20_000))
    assert pieces.filter("place = 0").count() > 5 and pieces.filter("place < 0").count() > 5
    sheets = xlsx.sheets_of(xlsx.workbook_cells(books, 20_000))
    for name, n in (("One", 3000), ("Two", 499)):
        got = sorted(tuple(r) for r in sheets[name].select("Item Count", "Item Name", "Note Text").collect())
        assert got == [(float(i), f"item {i % 97}", f"<n&{i}>" if i % 3 else None) for i in range(n)]


def test_report_of_orders(spark, sf_dir):
    report = analyze(spark.read.parquet(f"{sf_dir}/orders.parquet"), "orders")
    assert report["dataset"]["row_count"] == 1500 and report["metrics"]["kpis"][0]["column"] == "o_totalprice"
    kinds = [c["type"] for c in report["charts"]]
    assert "line" in kinds and "bar" in kinds and "histogram" in kinds and len(kinds) <= 8
    assert report["metrics"]["forecasts"][0]["metric"] == "o_totalprice" and report["recommendations"] and "1,500 rows" in report["summary"]
    assert 0 <= report["data_quality"]["score"] <= 100 and json.loads(profile_json(report))
    rows = insight_rows(spark, report)
    assert rows.filter("type = 'kpi'").count() == len(report["metrics"]["kpis"]) and rows.first().sort_order == 0


def test_combined_quality_and_questions(spark):
    assert combined_quality({"score": 60, "issues": [{"issue_type": "missing_values"}, {"issue_type": "duplicate_rows"}], "fixes": []})["score"] == 95
    df = spark.createDataFrame([("North", 5.0, "x"), ("South", 9.0, "x"), ("North", 1.0, "y")], "region string, total_sales double, kind string")
    assert [tuple(r) for r in ask(df, "Which are the top regions by sales?").collect()] == [("South", 9.0), ("North", 6.0)]
    assert ask(df, "hello") is None
    assert [tuple(r) for r in ask(df, "lowest regions by total sales").collect()] == [("North", 6.0), ("South", 9.0)]
    said = answer(df, "worst kind by sales")
    assert said["text"] == "Lowest Kind by Total Sales: y (1.00), x (14.00)" and said["chart"]["rows"][0] == {"label": "y", "total": 1.0}


FOOTBALL = [("Alpha", 2, 1, 1, "W"), ("Alpha", 1, 1, 0, "D"), ("Alpha", 3, 1, 2, "W"), ("Beta", 1, 2, 1, "L"), ("Beta", 0, 1, 0, "L"), ("Beta", 2, 2, 1, "D"), (None, 9, 0, 9, "W")]


def test_team_questions(spark):
    df = spark.createDataFrame(FOOTBALL, "team string, goals_team int, goals_opponent int, goals int, match_result string")
    assert questions.resolved(df) == {"team": "team", "scored": "goals_team", "conceded": "goals_opponent", "own": "goals", "result": "match_result"}
    said = answer(df, "Which team performed better overall?")
    assert said["text"].startswith("Ranked by win rate, then mean goal difference: Alpha, 3 rows, win rate 66.7%, 2-1-0, mean difference 1.00") and said["text"].index("Alpha") < said["text"].index("Beta")
    assert [r.label for r in ask(df, "win rate by team").collect()] == ["Alpha", "Beta"] == [r.label for r in ask(df, "team performance").collect()]
    goals = answer(df, "Show the top 5 teams by goals")
    assert [tuple(r) for r in goals["table"].collect()] == [("Alpha", 6.0), ("Beta", 3.0)] and goals["chart"]["x"] == "team" and goals["chart"]["measures"] == ["goals_team"]
    own = answer(df.select("team", "goals"), "rank the best clubs")
    assert [(r.label, r.total_own, r.win_rate) for r in own["table"].collect()] == [("Alpha", 3.0, None), ("Beta", 2.0, None)] and "total Goals" in own["text"]
    lost = answer(df.select("goals"), "top teams by goals")
    assert lost["table"] is None and "names the team" in lost["text"]


def test_slots_by_names(spark):
    df = spark.createDataFrame([], "`Home Country` string, club_id int, `Opponent Goals (total)` double, player_goals double, outcome_code int, expected_goals double")
    assert questions.resolved(df) == {"team": "Home Country", "conceded": "Opponent Goals (total)", "own": "player_goals", "result": "outcome_code"}
    assert [questions.asked_for(q) for q in ("best squad?", "teams", "chart goals per club", "top regions", "goal difference by team, top first")] == ["performance", None, "goals", None, "performance"]


def test_streamed_windows_match_batch(spark, tmp_path, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "value").orderBy("ts")
    events.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in")
    q = stream_windows(stream, "ts", "value").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    done = months_of(spark.read.parquet(f"{tmp_path}/out"))
    assert 0 < done.agg({"rows": "sum"}).first()[0] <= events.count()
