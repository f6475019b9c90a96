"""Archives: what is written is read back, by this reader and by a plain one."""

import base64
import glob
import gzip
import hashlib
import random

import pytest
from pyspark.errors import PySparkException

from granary.llm.common import stored
from granary.llm.warc import archive, read_archives, record_chunks, revisits, write_archives

SCHEMA = "page_id long, url string, html string, record long, chunk_no int, body string, first int"
FAKE = "head\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nabc\r\n\r\n"


def pages():
    rnd = random.Random(4)
    long = "".join(rnd.choice(["é", "日本", "\r\n", "a", "\n", "\r", "😀", "\r\n\r\n"]) for _ in range(3000))
    texts = [None, "", "a", "a", "A", FAKE, long, long, "x" * 1000, "\n", "\r", "\r\n", "\r\n\r\n", "no end\r", "é" * 333, None, "a", FAKE, "  line\u0085"]
    made = [(i, None if i == 3 else f"http://h/{i}?q=a b\r\nX: y", t, 1, 2, "x", 3) for i, t in enumerate(texts)]
    return [*made, made[2], (None, "http://h/null", "a", 1, 2, "x", 3), (None, None, "only null", 1, 2, "x", 3), (None, None, "only null", 1, 2, "x", 3), (-5, None, "only negative", 1, 2, "x", 3)]


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def sha1(raw):
    return base64.b32encode(hashlib.sha1(raw).digest()).decode()


def brute(rows, least=0):
    raws = [(r[2] or "").encode() for r in rows]
    out, best = [], {}
    for k, (r, raw) in enumerate(zip(rows, raws, strict=True)):
        key = (r[0] is not None, r[0] or 0)
        if raw not in best or key >= best[raw][0]:
            best[raw] = key, k
    for k, (r, raw) in enumerate(zip(rows, raws, strict=True)):
        top = best[raw][1]
        again = len(raw) >= least and top != k
        out.append((r[0], len(raw), sha1(raw), "revisit" if again else "response", rows[top][0] if again else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("least, chunk", [(0, 1 << 20), (2, 64), (0, 4)])
def test_round_trip(spark, least, chunk):
    found = archive(frame(spark, pages()), least=least, chunk=chunk).collect()
    assert sorted([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found], key=str) == brute(pages(), least)
    assert all(r.intact for r in found)


def test_no_rows(spark):
    assert archive(frame(spark, pages()[:0])).collect() == []


def plain(raw):
    """The records of an archive, by lengths alone."""
    out = []
    while raw:
        head, _, rest = raw.partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        assert lines[0] == "WARC/1.1"
        fields = dict(line.split(": ", 1) for line in lines[1:])
        n = int(fields["Content-Length"])
        assert rest[n : n + 4] == b"\r\n\r\n"
        out.append((fields, rest[:n]))
        raw = rest[n + 4 :]
    return out


def test_files_are_archives(spark, tmp_path):
    chunks = stored(record_chunks(frame(spark, pages()), chunk=100), "chunks")
    assert all(len(r.body) <= 100 and r.body.decode() is not None for r in chunks.collect())
    write_archives(chunks, str(tmp_path / "w"), stored(revisits(chunks), "revisits"))
    segments, kinds = {}, []
    for name in glob.glob(str(tmp_path / "w" / "*.gz")):
        records = plain(gzip.open(name).read())
        assert records[0][0]["WARC-Type"] == "warcinfo"
        for fields, block in records[1:]:
            kinds.append(fields["WARC-Type"])
            assert fields["WARC-Block-Digest"] == f"sha1:{sha1(block)}" and "\n" not in fields["WARC-Target-URI"] and " " not in fields["WARC-Target-URI"]
            if kinds[-1] != "revisit":
                own = segments.setdefault(fields.get("WARC-Segment-Origin-ID", fields["WARC-Record-ID"]), [])
                own.append(block if kinds[-1] == "continuation" else block.partition(b"\r\n\r\n")[2])
                assert fields.get("WARC-Segment-Number", "1") == str(len(own))
    assert sorted(b"".join(s) for s in segments.values()) == sorted({(r[2] or "").encode() for r in pages()})
    assert kinds.count("revisit") == len(pages()) - len(segments) and "continuation" in kinds


def test_chunks_are_read_back(spark, tmp_path):
    chunks = stored(record_chunks(frame(spark, pages()), chunk=64), "chunks")
    write_archives(chunks, str(tmp_path / "w"))
    bodies, digests = {}, {}
    for r in sorted(read_archives(spark, str(tmp_path / "w"), chunk=50).where("record_type = 'response'").collect(), key=lambda r: (r.record_id, r.chunk_no)):
        bodies[r.record_id] = bodies.get(r.record_id, b"") + r.body
        assert r.sha1 == sha1(bodies[r.record_id])
        digests[r.record_id] = r.payload_digest
    assert sorted(bodies.values()) == sorted((r[2] or "").encode() for r in pages())
    assert all(digests[k] == sha1(v) for k, v in bodies.items())


def test_damaged_archives(spark, tmp_path):
    def record(kind, block, length=None, extra=""):
        return f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <r:{kind}>\r\n{extra}Content-Length: {len(block) if length is None else length}\r\n\r\n".encode() + block + b"\r\n\r\n"

    def put(name, raw):
        (tmp_path / name).mkdir()
        (tmp_path / name / "a.warc.gz").write_bytes(raw)
        return read_archives(spark, str(tmp_path / name)).collect()

    good = gzip.compress(record("resource", b"\x00\xff\n\x80binary")) + gzip.compress(record("metadata", b"folded: 1", extra="X-Long: a\r\n b\r\n"))
    assert [(r.record_type, r.payload_bytes, r.intact) for r in put("members", good)] == [("resource", 10, True), ("metadata", 9, True)]
    assert [r.payload_digest for r in put("again", good)][0] == sha1(b"\x00\xff\n\x80binary")
    cut = put("cut", gzip.compress(record("resource", b"a" * 90)[:-40]))
    assert [(r.record_type, r.intact) for r in cut] == [("resource", False)]
    wrong = put("wrong", gzip.compress(record("resource", b"abc", extra=f"WARC-Payload-Digest: sha1:{sha1(b'abd')}\r\n")))
    assert [r.intact for r in wrong] == [False]
    for name, raw in (("longer", record("resource", b"abcdef", 3)), ("other", b"<html>\n")):
        with pytest.raises(PySparkException):
            put(name, gzip.compress(raw))
