"""Delimited text: dialect by the header, strict quotes, fallback charsets, tables inside documents."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.plans.table_plan import PlanError

HEADER_LIMIT = 65_536


def decode(raw: bytes, fallback: str = "gb18030") -> str:
    """UTF-8 without its mark, strictly; else the fallback (tables: gb18030, documents: cp1252)."""
    try:
        return raw.decode("utf-8-sig")
    except UnicodeDecodeError:
        return raw.decode(fallback)


def detect_delimiter(text: str) -> str:
    """Of comma, semicolon and tab the most frequent in the header outside quotes; comma without any; a tie is an error."""
    counts, quoted, at = dict.fromkeys(",;\t", 0), False, 0
    text = text.removeprefix("\ufeff")
    while at < len(text):
        if at >= HEADER_LIMIT:
            raise PlanError("the header is too long to tell its delimiter")
        c = text[at]
        if c == '"':
            if quoted and text[at + 1 : at + 2] == '"':
                at += 1
            else:
                quoted = not quoted
        elif not quoted:
            if c in "\r\n":
                break
            if c in counts:
                counts[c] += 1
        at += 1
    best = max(counts.values())
    if not best:
        return ","
    if list(counts.values()).count(best) > 1:
        raise PlanError("the header has several delimiters equally often")
    return max(counts, key=counts.get)


def records(text: str, delimiter: str | None = None) -> list[list[str]]:
    """Rows of cells. Quotes only around whole cells, doubled inside; white space may follow a closing quote; anything else about
    quotes is an error."""
    text = text.removeprefix("\ufeff")
    delimiter = delimiter or detect_delimiter(text)
    cell = re.compile(rf'"((?:[^"]|"")*)"[^\S\r\n{re.escape(delimiter)}]*|([^"\r\n{re.escape(delimiter)}]*)')
    rows, row, at = [], [], 0
    while at < len(text):
        m = cell.match(text, at)
        at = m.end()
        row.append(m[1].replace('""', '"') if m[1] is not None else m[2])
        if at < len(text) and text[at] == '"':
            raise PlanError("a quote inside a cell, or one that isn't closed")
        if at >= len(text):
            break
        if text[at] == delimiter:
            at += 1
            if at == len(text):
                row.append("")
            continue
        if text[at] not in "\r\n":
            raise PlanError("text after a closing quote")
        at += 2 if text.startswith("\r\n", at) else 1
        rows.append(row)
        row = []
    return [*rows, row] if row else rows


def table_cells(rows: list[list[str]]) -> tuple[list[str], list[list[str]]]:
    """(columns, rows): blank rows left out, blank names by their place, repeated ones numbered; short rows padded; a long row
    whose overflow isn't blank is an error."""
    rows = [r for r in rows if any(c.strip() for c in r)]
    if not rows:
        raise PlanError("there is no header")
    columns: list[str] = []
    for i, name in enumerate(rows[0], 1):
        name = base = name.strip() or f"column{i}"
        n = 2
        while name in columns:
            name, n = f"{base}_{n}", n + 1
        columns.append(name)
    out = []
    for r in rows[1:]:
        if any(c.strip() for c in r[len(columns) :]):
            raise PlanError("a row has more cells than the header")
        out.append((r + [""] * len(columns))[: len(columns)])
    return columns, out


def read_csv_file(spark: SparkSession, path: str, fallback: str = "gb18030") -> DataFrame:
    """One file as a table of text columns with _row, its place. The header decides the dialect; Spark parses the rest where the
    file is UTF-8 (multi-line quotes, FAILFAST), so that a large file never passes the driver."""
    head = spark.read.format("binaryFile").load(path).select(F.substring("content", 1, HEADER_LIMIT).alias("h"), "length").first()
    raw = bytes(head["h"])
    try:
        text = raw.decode("utf-8-sig", errors="strict" if head["length"] <= HEADER_LIMIT else "ignore")
        charset = "UTF-8"
    except UnicodeDecodeError:
        text, charset = raw.decode(fallback, errors="ignore"), fallback
    delimiter = detect_delimiter(text)
    first = records(text[: _record_end(text)], delimiter)
    columns, _ = table_cells(first[:1])
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    df = spark.read.schema(schema).csv(path, sep=delimiter, header=True, multiLine=True, quote='"', escape='"', mode="FAILFAST", encoding=charset, enforceSchema=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return df.na.fill("").withColumn("_row", F.monotonically_increasing_id())


def _record_end(text: str) -> int:
    quoted = False
    for i, c in enumerate(text):
        if c == '"':
            quoted = not quoted
        elif c in "\r\n" and not quoted:
            return i
    return len(text)


def read_csv_folder(spark: SparkSession, path: str, fallback: str = "gb18030") -> DataFrame:
    """path, _row, and cells (name to text) of every CSV file of a folder, each in its own dialect; error for files that can't be read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").option("recursiveFileLookup", "true").load(path).select("path", "content")

    def read(frames):
        import pandas as pd

        for frame in frames:
            out = []
            for name, content in zip(frame["path"], frame["content"], strict=True):
                try:
                    columns, rows = table_cells(records(decode(bytes(content), fallback)))
                    out += [(name, i, dict(zip(columns, r, strict=True)), None) for i, r in enumerate(rows, 1)]
                except (PlanError, UnicodeDecodeError) as e:
                    out.append((name, 0, None, str(e)))
            yield pd.DataFrame(out, columns=["path", "_row", "cells", "error"])

    return files.mapInPandas(read, "path string, _row long, cells map<string,string>, error string")


def document_tables(text: str, escaped: bool = False) -> list[dict]:
    """Tables in a text: runs of lines with tabs or pipes. The first line is the header; separator lines and repeated headers are
    left out; rows of another width are kept and counted as malformed; blank or repeated header names are an issue."""
    tables, header, mark, at = [], None, "", 0

    def close():
        nonlocal header
        if header is not None and rows:
            issues = list(notes)
            if any(not h.strip() for h in header) or len(set(header)) != len(header):
                issues.append("the headers are blank or not unique")
            tables.append({"id": f"table-{len(tables) + 1}", "headers": header, "rows": list(rows), "malformed": malformed, "issues": issues})
        header = None

    rows: list[dict] = []
    notes: list[str] = []
    malformed = 0
    for line in text.split("\n"):
        start, at = at, at + len(line) + 1
        kind = "\t" if "\t" in line else "|" if "|" in line else ""
        if not kind:
            close()
            rows, notes, malformed = [], [], 0
            continue
        raw = line if kind == "\t" else line.strip().removeprefix("|").removesuffix("|")
        cells = [unescape(c.strip()) if escaped else c.strip() for c in raw.split(kind)]
        if all(re.fullmatch(":?-{3,}:?", c) for c in cells):
            continue
        if header is None:
            header, mark, rows, notes, malformed = cells, kind, [], [], 0
        elif kind != mark or len(cells) != len(header):
            malformed += 1
            notes.append(f"row {len(rows) + 1} has another width, at {start}")
            rows.append({"row": len(rows) + 1, "start": start, "end": start + len(line), "cells": cells})
        elif cells != header:
            rows.append({"row": len(rows) + 1, "start": start, "end": start + len(line), "cells": cells})
    close()
    return tables


def extract_tables(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, table_id, headers, row, start, end, cells, ragged and issues of the rows of all tables in documents."""
    kind = "array<struct<table_id:string,headers:array<string>,row:int,start:int,end:int,cells:array<string>,ragged:boolean,issues:array<string>>>"
    texts = pa.list_(pa.string())
    row = pa.struct([("table_id", pa.string()), ("headers", texts), ("row", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("cells", texts), ("ragged", pa.bool_()), ("issues", texts)])

    @F.arrow_udf(kind)
    def read(texts: pa.Array) -> pa.Array:
        tables = ([] if t is None else document_tables(t) for t in texts.to_pylist())
        found = [[{"table_id": t["id"], "headers": t["headers"], **r, "ragged": len(r["cells"]) != len(t["headers"]), "issues": t["issues"]} for t in of for r in t["rows"]] for of in tables]
        return pa.array(found, pa.list_(row))

    return docs.select(F.col(id_col).alias("doc_id"), F.explode(read(F.col(text_col))).alias("x")).select("doc_id", "x.*")


def unescape(cell: str) -> str:
    return re.sub(r"(?s)\\(.)", lambda m: {"t": "\t", "r": "\r", "n": "\n"}.get(m[1], m[1]), cell)
