"""XLSX and DOCX with the standard library: zip and XML, cached values only, nothing is run."""

from __future__ import annotations

import datetime as dt
import io
import re
import zipfile
from xml.etree import ElementTree as ET

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.sources.delimited import table_cells

_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
#: The built-in number formats that are dates.
DATE_FORMATS = frozenset([*range(14, 23), *range(45, 48)])


def sheet_names(raw: bytes) -> list[str]:
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        return [s.get("name") for s in ET.fromstring(z.read("xl/workbook.xml")).iter(f"{_S}sheet")]


def _text(node) -> str:
    return "".join(t.text or "" for t in node.iter(f"{_S}t"))


def sheet_rows(raw: bytes, sheet: str | None = None) -> list[list[str]]:
    """Cells of a sheet (the first by default) as text: cached values of formulas, "" where there is none; dates as ISO text."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        names = z.namelist()
        book = ET.fromstring(z.read("xl/workbook.xml"))
        targets = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        sheets = {s.get("name"): targets[s.get(f"{_R}id")] for s in book.iter(f"{_S}sheet")}
        if sheet is not None and sheet not in sheets:
            raise ValueError(f"no such sheet: {sheet}")
        target = sheets[sheet] if sheet else next(iter(sheets.values()))
        shared = [_text(i) for i in ET.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_S}si")] if "xl/sharedStrings.xml" in names else []
        dates = _date_styles(ET.fromstring(z.read("xl/styles.xml"))) if "xl/styles.xml" in names else set()
        root = ET.fromstring(z.read("xl/" + target.removeprefix("/xl/")))
        rows: list[list[str]] = []
        for row in root.iter(f"{_S}row"):
            number = int(row.get("r") or len(rows) + 1)
            rows += [[] for _ in range(number - 1 - len(rows))]
            cells: list[str] = []
            for c in row.iter(f"{_S}c"):
                at = _column(c.get("r")) if c.get("r") else len(cells)
                cells += [""] * (at - len(cells))
                cells.append(_cell(c, shared, dates))
            rows.append(cells)
        return rows


def _column(reference: str) -> int:
    n = 0
    for letter in re.match("[A-Z]+", reference)[0]:
        n = 26 * n + ord(letter) - 64
    return n - 1


def _date_styles(styles) -> set[int]:
    custom = {int(f.get("numFmtId")) for f in styles.iter(f"{_S}numFmt") if re.search("[yd]", re.sub(r'"[^"]*"|\[[^\]]*]', "", f.get("formatCode", "")), re.I)}
    xfs = styles.find(f"{_S}cellXfs")
    return {i for i, x in enumerate(xfs if xfs is not None else []) if int(x.get("numFmtId") or 0) in DATE_FORMATS | custom}


def _cell(c, shared: list[str], dates: set[int]) -> str:
    if c.get("t") == "inlineStr":
        return _text(c)
    value = c.find(f"{_S}v")
    if value is None or value.text is None:
        return ""
    if c.get("t") == "s":
        return shared[int(value.text)]
    if c.get("t") == "b":
        return "TRUE" if value.text == "1" else "FALSE"
    if c.get("t") in (None, "n") and int(c.get("s") or 0) in dates:
        day = dt.datetime(1899, 12, 30) + dt.timedelta(days=float(value.text))
        return day.date().isoformat() if float(value.text).is_integer() else day.replace(microsecond=0).isoformat()
    return value.text


def document_text(raw: bytes) -> str:
    """Paragraphs and tables (cells apart by tabs, escaped) of a DOCX in the order of its body."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        body = ET.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    text = lambda node: "".join(t.text or "" if t.tag == f"{_W}t" else "\n" if t.tag == f"{_W}br" else "\t" if t.tag == f"{_W}tab" else "" for t in node.iter())
    parts = []
    for node in body:
        if node.tag == f"{_W}p":
            parts.append(text(node))
        elif node.tag == f"{_W}tbl":
            for row in node.iter(f"{_W}tr"):
                cells = ["\n".join(text(p) for p in cell.iter(f"{_W}p")) for cell in row.iter(f"{_W}tc")]
                parts.append("\t".join(c.replace("\\", "\\\\").replace("\t", "\\t").replace("\n", "\\n") for c in cells))
    return "\n".join(parts)


def read_office_folder(spark: SparkSession, path: str) -> DataFrame:
    """path, kind, sheet, _row, cells (of sheets) and text (of documents); one row for each sheet row or document."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(F.lower("path").rlike(r"\.(xlsx|docx)$")).select("path", "content")

    def read(frames):
        import pandas as pd

        for frame in frames:
            out = []
            for name, content in zip(frame["path"], frame["content"], strict=True):
                raw = bytes(content)
                if name.lower().endswith(".docx"):
                    out.append((name, "docx", None, 0, None, document_text(raw)))
                    continue
                for sheet in sheet_names(raw):
                    rows = sheet_rows(raw, sheet)
                    if any(any(c.strip() for c in r) for r in rows):
                        columns, cells = table_cells(rows)
                        out += [(name, "xlsx", sheet, i, dict(zip(columns, r, strict=True)), None) for i, r in enumerate(cells, 1)]
            yield pd.DataFrame(out, columns=["path", "kind", "sheet", "_row", "cells", "text"])

    return files.mapInPandas(read, "path string, kind string, sheet string, _row long, cells map<string,string>, text string")


def workbook(columns: list[str], rows: list[list], notes: str = "") -> bytes:
    """A small XLSX of a result (numbers of up to 15 digits as such, everything else as text, never a formula) and its notes."""
    from decimal import Decimal
    from xml.sax.saxutils import escape

    def cell(v) -> str:
        if v is None:
            return "<c/>"
        if isinstance(v, int | float | Decimal) and not isinstance(v, bool) and len(Decimal(str(v)).as_tuple().digits) <= 15:
            return f"<c><v>{v}</v></c>"
        return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>'

    def sheet(table) -> str:
        lines = "".join(f"<row>{''.join(map(cell, r))}</row>" for r in table)
        return f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="{_S[1:-1]}"><sheetData>{lines}</sheetData></worksheet>'

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        kinds = "".join(f'<Override PartName="/xl/{p}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.{k}+xml"/>' for p, k in (("workbook", "sheet.main"), ("worksheets/sheet1", "worksheet"), ("worksheets/sheet2", "worksheet")))
        z.writestr("[Content_Types].xml", f'<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>{kinds}</Types>')
        rel = '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{}</Relationships>'
        one = '<Relationship Id="{0}" Type="' + _R[1:-1] + '/{1}" Target="{2}"/>'
        z.writestr("_rels/.rels", rel.format(one.format("r1", "officeDocument", "xl/workbook.xml")))
        z.writestr("xl/_rels/workbook.xml.rels", rel.format(one.format("r1", "worksheet", "worksheets/sheet1.xml") + one.format("r2", "worksheet", "worksheets/sheet2.xml")))
        z.writestr("xl/workbook.xml", f'<?xml version="1.0" encoding="UTF-8"?><workbook xmlns="{_S[1:-1]}" xmlns:r="{_R[1:-1]}"><sheets><sheet name="result" sheetId="1" r:id="r1"/><sheet name="notes" sheetId="2" r:id="r2"/></sheets></workbook>')
        z.writestr("xl/worksheets/sheet1.xml", sheet([columns, *rows]))
        z.writestr("xl/worksheets/sheet2.xml", sheet([[line] for line in notes.split("\n")]))
    return out.getvalue()
