import io
import zipfile

import pytest

from granary.plans.table_plan import PlanError
from granary.sources import delimited as D
from granary.sources import files, office


def test_dialects():
    assert D.detect_delimiter("﻿price;note;quality\n1,2;a;b") == ";"
    assert D.detect_delimiter('"a;b",c\n') == ","
    assert D.detect_delimiter("single\n1") == ","
    with pytest.raises(PlanError):
        D.detect_delimiter("a,b;c\n")


def test_quoted_records():
    assert D.records('ID,Note,Amount\n1,"a, ""b""\nc",5\r\n2,,6') == [["ID", "Note", "Amount"], ["1", 'a, "b"\nc', "5"], ["2", "", "6"]]
    for bad in ('a,b\n"x,1', 'a,b\nx"y,1', 'a,b\n"x"y,1'):
        with pytest.raises(PlanError):
            D.records(bad)


def test_headers_and_widths():
    assert D.table_cells([["a", "", "a"], ["1"], ["", " ", ""]]) == (["a", "column2", "a_2"], [["1", "", ""]])
    with pytest.raises(PlanError):
        D.table_cells([["a"], ["1", "2"]])


def test_charsets():
    assert D.decode("标题".encode("gb18030")) == "标题"
    assert D.decode("£".encode("cp1252"), "cp1252") == "£"


def test_csv_file(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text('price;note\n1,5;"a\nb ""q"""\n2;x\n')
    rows = D.read_csv_file(spark, str(path)).orderBy("_row").collect()
    assert [(r.price, r.note) for r in rows] == [("1,5", 'a\nb "q"'), ("2", "x")]


def test_csv_folder(spark, tmp_path):
    (tmp_path / "good.csv").write_bytes("a,b\n1,标\n".encode("gb18030"))
    (tmp_path / "bad.csv").write_text('a,b\n"1,2\n')
    rows = {r.path.split("/")[-1]: r for r in D.read_csv_folder(spark, str(tmp_path)).collect()}
    assert rows["good.csv"].cells == {"a": "1", "b": "标"} and rows["bad.csv"].error


def test_document_tables(spark):
    text = "Intro\n| ID | Amount |\n| --- | --- |\n| 1 | 5 |\n| ID | Amount |\n| 2 |\n\nprose\nA\tB\n1\tx\\ty"
    tables = D.document_tables(text, escaped=True)
    assert [t["id"] for t in tables] == ["table-1", "table-2"]
    assert [r["cells"] for r in tables[0]["rows"]] == [["1", "5"], ["2"]] and tables[0]["malformed"] == 1
    assert tables[1]["rows"][0]["cells"] == ["1", "x\ty"]
    for t in tables:
        for r in t["rows"]:
            assert text[r["start"] : r["end"]].count("|") or "\t" in text[r["start"] : r["end"]]
    rows = D.extract_tables(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")).collect()
    assert len(rows) == 3 and sum(r.ragged for r in rows) == 1


def test_workbook_round_trip(spark, tmp_path):
    from decimal import Decimal

    raw = office.workbook(["name", "value"], [["=1+1", Decimal("12.5")], [None, Decimal("1234567890123456789")]], "line one\nline two")
    assert office.sheet_names(raw) == ["result", "notes"]
    assert office.sheet_rows(raw) == [["name", "value"], ["=1+1", "12.5"], ["", "1234567890123456789"]]
    assert office.sheet_rows(raw, "notes") == [["line one"], ["line two"]]
    (tmp_path / "b.xlsx").write_bytes(raw)
    rows = office.read_office_folder(spark, str(tmp_path)).where("sheet = 'result'").orderBy("_row").collect()
    assert rows[0].cells == {"name": "=1+1", "value": "12.5"}
    with pytest.raises(ValueError):
        office.sheet_rows(raw, "none")


def test_docx_text():
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    body = f'<w:document xmlns:w="{w}"><w:body>{p("Head")}<w:tbl><w:tr><w:tc>{p("a")}</w:tc><w:tc>{p("b")}{p("c")}</w:tc></w:tr></w:tbl>{p("End")}</w:body></w:document>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", body)
    assert office.document_text(out.getvalue()) == "Head\na\tb\\nc\nEnd"


def test_folder_scan(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.md").write_text("x")
    (tmp_path / "sub" / "b.TXT").write_text("y")
    (tmp_path / "c.exe").write_text("z")
    rows = files.scan_folder(spark, str(tmp_path)).collect()
    assert sorted(r.relative_path for r in rows) == ["a.md", "sub/b.TXT"] and all(len(r.fingerprint) == 64 for r in rows)


def test_folder_limits_and_changes(spark, tmp_path):
    root = tmp_path / "root's"
    for name, text in (("a.md", "1"), ("b.md", "22"), ("c.txt", "3"), ("sub/d.txt", "x" * 50), ("node_modules/e.md", "5"), ("sub/.GIT/f.md", "6"), ("noext", "7"), ("sub/deep/g.csv", "8")):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    rows = {r.relative_path: r for r in files.scan_folder(spark, str(root), most_bytes=40).collect()}
    assert set(rows) == {"a.md", "b.md", "c.txt", "sub/d.txt", "sub/deep/g.csv"} and rows["sub/d.txt"].reason == "too large" and rows["sub/d.txt"].fingerprint is None and rows["a.md"].fingerprint
    for limits in ({"most_depth": 2}, {"most_entries": 5}, {"most_files": 4}):
        with pytest.raises(PlanError):
            files.scan_folder(spark, str(root), **limits)
    (tmp_path / "none").mkdir()
    assert files.scan_folder(spark, str(tmp_path / "none")).collect() == []
    found = files.scan_folder(spark, str(root), most_bytes=40)
    key = lambda p: rows[p].source_key
    stored = [(key("a.md"), "a.md", rows["a.md"].fingerprint, "READY"), (key("b.md"), "b.md", "old", "READY"), (key("c.txt"), "c.txt", rows["c.txt"].fingerprint, "FAILED"), (key("sub/d.txt"), "sub/d.txt", "q", "READY"), ("gone", "gone.md", "z", "READY"), ("busy", "busy.md", "z", "PROCESSING")]
    plan = files.sync_plan(found, spark.createDataFrame(stored, "source_key string, relative_path string, fingerprint string, status string"))
    assert {r.relative_path: (r.change, r.reason) for r in plan.collect()} == {
        "a.md": ("unchanged", None), "b.md": ("updated", None), "c.txt": ("updated", None), "sub/d.txt": ("skipped", "too large"), "sub/deep/g.csv": ("added", None), "gone.md": ("removed", None), "busy.md": ("skipped", "being worked on"),
    }


def test_pages_within_a_budget(spark):
    d = spark.createDataFrame([(1, "x" * 13000), (2, ""), (3, None)], "doc_id long, text string")
    pages = files.text_pages(d, 6000)
    assert pages.where("doc_id = 1").count() == 3 and pages.where("doc_id = 3").count() == 1
    got = files.read_pages(pages, [1, 2, 3], budget=12500).where("doc_id = 1").orderBy("page").collect()
    assert [(r.page, r.next_page) for r in got] == [(1, 2), (2, 3)]
