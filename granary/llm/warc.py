"""WARC archives of pages, through a table of record chunks.

A payload is a number of rows (record, chunk number), none over a megabyte, each with the digest of the payload as far as it goes; no
record is held as a whole beside its own cell. Archives are written by Spark's text writer, as a record is text that ends
in two line breaks. A payload of several chunks becomes the segments of a record, as the format has them. Archives are read line by
line, with a digest that grows as the lines come.
"""

from __future__ import annotations

import base64
import hashlib
from urllib.parse import quote, unquote

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import met, pick, shared_path, stored, utf8

CHUNK = 1 << 20
#: Fixed by the format.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = "\r\n\r\n"


def base32(sha1) -> str:
    return base64.b32encode(sha1.digest()).decode()


def _cuts(data: np.ndarray, start: int, end: int, most: int) -> list[int]:
    """Where a text is cut into chunks of at most `most` bytes, never inside a character."""
    cuts = [start]
    while end - cuts[-1] > most:
        at = cuts[-1] + most
        while data[at] & 0xC0 == 0x80:
            at -= 1
        cuts.append(at)
    return [*cuts, end]


def record_chunks(pages: DataFrame, chunk: int = CHUNK, id_col: str = "page_id", url_col: str = "url", text_col: str = "html") -> DataFrame:
    """The chunk table: record (a number for each row), page_id, url, chunk_no, n_chunks, total (bytes of the payload), body, sha1 (base32,
    of the payload up to this chunk's end) and, in the last chunk, content (sha256 of the payload).

    The payload is the text in UTF-8; null counts as empty, and an empty one has one chunk. Chunks have at most `chunk` bytes
    (four at least) and end between characters. Repeated rows are records of their own.
    """
    rows = pick(pages, page_id=id_col, url=url_col, text=text_col)
    most = max(4, chunk)
    page_type = rows.schema["page_id"].dataType.simpleString()

    def cut(batches):
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            data, offsets = utf8(batch.column(2))
            raw = memoryview(data)
            made: list[tuple] = []
            held = 0
            for row in range(batch.num_rows):
                cuts = _cuts(data, int(offsets[row]), int(offsets[row + 1]), most)
                sha1, content = hashlib.sha1(), hashlib.sha256()
                for k in range(len(cuts) - 1):
                    body = raw[cuts[k] : cuts[k + 1]]
                    sha1.update(body)
                    content.update(body)
                    made.append((number, row, k, len(cuts) - 1, cuts[-1] - cuts[0], bytes(body), base32(sha1), content.digest() if k == len(cuts) - 2 else None))
                    held += len(body)
                    if held > 4 * most:
                        yield _chunk_rows(batch, made)
                        made, held = [], 0
                number += 1
            yield _chunk_rows(batch, made)

    return rows.mapInArrow(cut, f"page_id {page_type}, url string, record long, chunk_no int, n_chunks int, total long, body binary, sha1 string, content binary")


def _chunk_rows(batch: pa.RecordBatch, made: list[tuple]) -> pa.RecordBatch:
    record, row, number, count, total, body, sha1, content = zip(*made, strict=True) if made else [()] * 8
    at = pa.array(row, pa.int64())
    columns = [batch.column(0).take(at), batch.column(1).take(at).cast(pa.string()), pa.array(record, pa.int64()), pa.array(number, pa.int32()), pa.array(count, pa.int32()), pa.array(total, pa.int64())]
    columns += [pa.array(body, pa.binary()), pa.array(sha1, pa.string()), pa.array(content, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "record", "chunk_no", "n_chunks", "total", "body", "sha1", "content"])


def revisits(chunks: DataFrame, least: int = 0) -> DataFrame:
    """record and first (page_id, record, url of the response) of every record that revisits another. Of records with equal
    payloads of at least `least` bytes the one with the largest page_id is the response (null is the smallest; of equal ids the
    last number counts), the others are revisits. chunks must be a stored table; its bodies are not read."""
    last = chunks.where("content is not null and total >= " + str(int(least))).select("content", "record", "page_id", "url", "total")
    groups = stored(last.groupBy("content").agg(F.count("*").alias("n"), F.max(F.struct("page_id", "record", "url")).alias("first")), "contents")
    return met(last, groups, "content", "n").where("record <> first.record").select("record", "first")


def _head(fields: list[tuple[str, object]]) -> bytes:
    return (VERSION + "\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None) + "\r\n").encode()


def record_name(page_id, record: int, number: int = 0) -> str:
    """A record's identifier, which says the page's id (quoted; empty for null)."""
    return f"<urn:x-page:{'' if page_id is None else quote(str(page_id), safe='')}:{record}:{number}>"


def page_of(name: str | None) -> str | None:
    return None if name is None or not name.startswith("<urn:x-page:") else unquote(name.split(":")[2]) or None


def _uri(url: str | None, name: str) -> str:
    """The address with blanks, controls and characters beyond ASCII quoted, so that it stays on one line; else the record's name."""
    return quote(url, safe="!#$%&'()*+,/:;=?@[]~") if url else name[1:-1]


def _records(date: str):
    def write(batches):
        begun = False
        for batch in batches:
            lines = []
            for r in batch.to_pylist():
                if not begun:
                    about = b"software: granary\r\nformat: WARC File Format 1.1\r\n"
                    name = f"<urn:x-warcinfo:{r['record']}:{r['chunk_no']}>"
                    lines.append(_head([("WARC-Type", "warcinfo"), ("WARC-Record-ID", name), ("WARC-Date", date), ("Content-Type", "application/warc-fields"), ("Content-Length", len(about))]) + about)
                    begun = True
                lines.append(_record(r, date))
            yield pa.RecordBatch.from_arrays([pa.array(lines, pa.binary()).view(pa.string())], names=["value"])

    return write


def _record(r: dict, date: str) -> bytes:
    """One segment, without the two line breaks at its end."""
    first, number = r["first"], r["chunk_no"]
    name = record_name(r["page_id"], r["record"], number)
    http = b"" if number else f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {r['total']}\r\n\r\n".encode()
    block = http if first else http + r["body"]
    several = r["n_chunks"] > 1 and not first
    fields = [
        ("WARC-Type", "revisit" if first else "continuation" if number else "response"), ("WARC-Record-ID", name), ("WARC-Date", date), ("WARC-Target-URI", _uri(r["url"], record_name(r["page_id"], r["record"]))),
        ("WARC-Payload-Digest", None if number else f"sha1:{r['whole']}"), ("WARC-Block-Digest", f"sha1:{base32(hashlib.sha1(block))}"),
    ]
    if first:
        other = record_name(first["page_id"], first["record"])
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", other), ("WARC-Refers-To-Target-URI", _uri(first["url"], other)), ("WARC-Refers-To-Date", date)]
    if several:
        start = len(f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {r['total']}\r\n\r\n")
        fields += [("WARC-Segment-Number", number + 1), ("WARC-Segment-Origin-ID", record_name(r["page_id"], r["record"]) if number else None), ("WARC-Segment-Total-Length", start + r["total"] if number == r["n_chunks"] - 1 else None)]
    fields += [("Content-Type", None if number else "application/http; msgtype=response"), ("Content-Length", len(block))]
    return _head(fields) + block


def write_archives(chunks: DataFrame, path: str, again: DataFrame | None = None, date: str = "2000-01-01T00:00:00Z") -> None:
    """Writes gzipped WARC files into the folder `path`: a record for each record of the stored chunk table, revisits (see revisits()) without payload.

    Records of one chunk are written where they are read, if the revisits are few enough for Spark to broadcast, else after one
    shuffle; the chunks of longer ones are brought together and ordered, so that a record's segments follow each other.
    """
    if again is None:
        again = chunks.sparkSession.createDataFrame([], f"record long, first struct<page_id:{chunks.schema['page_id'].dataType.simpleString()},record:long,url:string>")
    marked = chunks.join(again, "record", "left").where("chunk_no = 0 or first is null")
    columns = ["page_id", "url", "record", "chunk_no", "n_chunks", "total", F.when(F.col("first").isNull(), F.col("body")).alias("body"), "first"]
    whole = chunks.where("chunk_no = n_chunks - 1 and n_chunks > 1").select("record", F.col("sha1").alias("whole"))
    single = marked.where("n_chunks = 1").select(*columns, F.col("sha1").alias("whole"))
    longer = marked.where("n_chunks > 1").select(*columns).join(whole, "record").repartition("record").sortWithinPartitions("record", "chunk_no")
    texts = single.mapInArrow(_records(date), "value string").union(longer.select(single.columns).mapInArrow(_records(date), "value string"))
    texts.write.option("lineSep", END).option("compression", "gzip").text(path)


class _Reader:
    """Takes the lines of one archive and gives its records' payloads in chunks: record_id, record_type, target_uri, chunk_no, body, sha1 (of
    the payload as far as it goes), and with the last chunk payload_bytes, payload_digest, refers_to and intact."""

    def __init__(self, chunk: int | None) -> None:
        self.chunk, self.rows = chunk, []
        self.state, self.fields, self.left, self.open = "start", [], 0, None

    def feed(self, lines: pa.Array) -> None:
        """Lines without their line feeds."""
        _, offsets, data = lines.buffers()
        offsets = np.frombuffer(offsets, np.int32)[lines.offset : lines.offset + len(lines) + 1].astype(np.int64)
        raw = memoryview(data) if data is not None else memoryview(b"")
        ends = np.cumsum(np.diff(offsets) + 1)  # bytes of the archive up to each line's end
        at, n = 0, len(lines)
        while at < n:
            if self.state == "payload":
                before = int(ends[at - 1]) if at else 0
                to = int(np.searchsorted(ends, before + self.left, "right"))  # lines that are in the block as a whole
                body = b"\n".join([raw[offsets[k] : offsets[k + 1]] for k in range(at, to)]) + (b"\n" if to > at else b"")
                self.left -= len(body)
                if to < n and self.left:
                    body += bytes(raw[offsets[to] : offsets[to] + self.left])
                    self.left, rest = 0, bytes(raw[offsets[to] + self.left : offsets[to + 1]])
                    self._body(body)
                    if rest != b"\r":
                        raise ValueError("a record is longer than its Content-Length says")
                    self.state, at = "end", to + 1
                else:
                    self._body(body)
                    at = to
                    if not self.left:
                        self.state = "break"
                if not self.left:
                    self._closed()
                continue
            self._line(bytes(raw[offsets[at] : offsets[at + 1]]))
            at += 1

    def _line(self, line: bytes) -> None:
        if self.state in ("break", "end"):
            if line.rstrip(b"\r"):
                raise ValueError("a record is longer than its Content-Length says")
            self.state = "end" if self.state == "break" else "start"
        elif self.state == "start":
            if line.rstrip(b"\r"):
                if not line.startswith(b"WARC/"):
                    raise ValueError(f"not the start of a record: {line[:40]!r}")
                self.state, self.fields = "head", []
        elif self.state == "head":
            if line.rstrip(b"\r"):
                self._field(line)
            else:
                self._opened()
        else:  # http: the block's own head
            self.left -= len(line) + 1
            if line.rstrip(b"\r"):
                self._field(line)
            else:
                length = dict(self.fields).get("content-length", "")
                self.open["stated"] = int(length) if length.isdigit() else None
                self.state = "payload"
            if self.left <= 0:
                self.left, self.state = 0, "break"
                self._closed()

    def _field(self, line: bytes) -> None:
        text = line.decode("utf-8", "replace").rstrip("\r")
        if text[:1] in " \t" and self.fields:
            self.fields[-1] = (self.fields[-1][0], f"{self.fields[-1][1]} {text.strip()}")
        else:
            name, _, value = text.partition(":")
            self.fields.append((name.strip().lower(), value.strip()))

    def _opened(self) -> None:
        head = dict(self.fields)
        self.left, kind = int(head["content-length"]), head.get("warc-type", "")
        http = head.get("content-type", "").startswith("application/http")
        if kind == "continuation" and self.open and head.get("warc-segment-origin-id") == self.open["record_id"]:
            self.open["ends"] = "warc-segment-total-length" in head
        else:
            self._cut_off()
            refers = head.get("warc-refers-to")
            digest = head.get("warc-payload-digest", "").partition(":")[2] or None
            self.open = {
                "record_id": head.get("warc-record-id"), "record_type": kind, "target_uri": head.get("warc-target-uri"), "refers_to": refers, "digest": digest, "stated": None,
                "ends": "warc-segment-number" not in head, "sha1": hashlib.sha1(), "size": 0, "chunk_no": 0, "parts": [], "held": 0,
            }
        self.state, self.fields = "http" if http else "payload", []
        if not self.left:
            self.state = "break"
            self._closed()

    def _body(self, body: bytes) -> None:
        now = self.open
        now["sha1"].update(body)
        now["size"] += len(body)
        if self.chunk:
            now["parts"].append(body)
            now["held"] += len(body)
            if now["held"] >= self.chunk:
                self._row(False)

    def _row(self, last: bool, whole: bool = True) -> None:
        now = self.open
        size, digest, intact = None, None, None
        if last:
            revisit = now["record_type"] == "revisit"
            size, digest = (now["stated"], now["digest"]) if revisit else (now["size"], base32(now["sha1"]))
            intact = whole and (revisit or now["digest"] in (None, digest)) and now["stated"] in (None, size)
        body = b"".join(now["parts"]) if self.chunk else None
        self.rows.append((now["record_id"], now["record_type"], now["target_uri"], now["chunk_no"], body, base32(now["sha1"]), size, digest, now["refers_to"], intact))
        now["parts"], now["held"], now["chunk_no"] = [], 0, now["chunk_no"] + 1

    def _closed(self) -> None:
        if self.open["ends"]:
            self._row(True)
            self.open = None

    def _cut_off(self) -> None:
        if self.open:
            self._row(True, whole=False)
            self.open = None

    def ended(self) -> None:
        """The archive is over; a record that was not is given as not intact."""
        self._cut_off()


_ROWS = "record_id string, record_type string, target_uri string, chunk_no int, body binary, sha1 string, payload_bytes long, payload_digest string, refers_to string, intact boolean"


def read_archives(spark: SparkSession, path: str, chunk: int | None = None) -> DataFrame:
    """The records of gzipped WARC archives: record_id, record_type, target_uri, chunk_no, body, sha1, payload_bytes, payload_digest, refers_to, intact.

    With `chunk`, a row for about every so many bytes of payload, with body and the digest so far; the last one of a record has the
    other columns. Without, that last row only, and no body. Revisits have the size and digest that they state. intact: digest
    and length are those stated. A task reads an archive from its start, so archives that Spark would split (not gzipped) are refused.
    """
    lines = spark.read.option("lineSep", "\n").text(path)
    lines = lines.select(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("line"))
    names = [f.split()[0] for f in _ROWS.split(", ")]

    def made(rows):
        types = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.binary(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.bool_()]
        columns = zip(*rows, strict=True) if rows else [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    def parse(batches):
        reader, file = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            if max(batch.column(1).to_numpy()) > 0:
                raise ValueError("an archive that is not gzipped was split: gzip it, or raise spark.sql.files.maxPartitionBytes above its size")
            files = batch.column(0).to_numpy()
            bounds = [0, *(np.flatnonzero(np.diff(files)) + 1).tolist(), len(files)]
            rows: list[tuple] = []
            for a, b in zip(bounds, bounds[1:], strict=False):
                if reader is None or files[a] != file:
                    if reader:
                        reader.ended()
                        rows += reader.rows
                    reader, file = _Reader(chunk), files[a]
                reader.feed(batch.column(2).slice(a, b - a))
                rows += reader.rows
                reader.rows = []
            yield made(rows)
        if reader:
            reader.ended()
            yield made(reader.rows)

    return lines.mapInArrow(parse, _ROWS)


def archive(pages: DataFrame, path: str | None = None, least: int = 0, chunk: int = CHUNK, id_col: str = "page_id", url_col: str = "url", text_col: str = "html", date: str = "2000-01-01T00:00:00Z") -> DataFrame:
    """Writes a record for each row into WARC archives and reads them back: page_id, payload_bytes, payload_digest (base32 SHA-1), record_type,
    refers_to (the response's page_id), target_uri and intact.

    Of records with equal payloads of at least `least` bytes the one with the largest page_id is the response and the others revisit it;
    null ids are the smallest, and a revisit of a response without id has none. Of repeated rows one is the response. A null text
    is an empty payload, a null address becomes the record's own name; no rows give none.
    """
    spark = pages.sparkSession
    chunks = stored(record_chunks(pages, chunk, id_col, url_col, text_col), "chunks")
    again = stored(revisits(chunks, least), "revisits")
    path = path or shared_path(spark, "archives")
    write_archives(chunks, path, again, date)
    rows = read_archives(spark, path).where(F.col("record_type").isin("response", "revisit"))
    kind = chunks.schema["page_id"].dataType

    def page(name: str):
        return F.nullif(F.url_decode(F.split(name, ":")[2]), F.lit("")).cast(kind)

    return rows.select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"), "target_uri", "intact")
