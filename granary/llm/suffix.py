"""Repeated byte strings: a logarithmic family of sampled suffixes, whose suffixes are sorted and compared where they can match.

A string of `length` bytes that occurs twice has the same least k-mer in both places. So every start of such a string is
put under the k-mer (the anchor) that is least among those inside it, by a hash; neighbouring starts with the same anchor
are one segment. Equal strings are in segments of equal anchors. A level of the family is a table of segments in the shared
folder. A new batch is scanned against every level for anchors that both have, and what meets under an anchor goes to a task
that keeps suffix arrays of it, in levels of growing size as well.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import KeyFilter, Runs, covered, fresh, mix, pick, scratch, slices, stored, tidy, utf8, windows

KMER = 80
#: Unlike contents under one anchor beyond which they are cut in WAYS parts, with longer anchors.
MOST_CONTENTS = 1024
WAYS = 8
#: Parts that texts are added in.
BATCHES = 2
_POSITION = 22
_MASK = np.uint64((1 << _POSITION) - 1)
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_KEYS = ["text_hash", "text_sum"]


def _least(keys: np.ndarray, width: int) -> np.ndarray:
    """The least of every `width` consecutive keys: the rest of one block of `width` keys and the head of the next."""
    n = len(keys)
    blocks = np.full(-(-n // width) * width, ~np.uint64(0))
    blocks[:n] = keys
    blocks = blocks.reshape(-1, width)
    head = np.minimum.accumulate(blocks, 1).ravel()
    rest = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(rest[: n - width + 1], head[width - 1 : n])


def segments(data: np.ndarray, offsets: np.ndarray, length: int, kmer: int = KMER):
    """(row, start, count, anchor, place) of the segments: `count` neighbouring starts of strings with one anchor, its hash, and how far
    behind the first start its k-mer lies. kmer: a multiple of 8."""
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none, none.view(np.uint64), none
    anchors = windows(mix(Runs(data).loads[: len(data) - 7]), kmer // 8, 8)
    # Places are kept in the low bits: among equal k-mers the first one is taken, in either copy.
    keys = (anchors & ~_MASK) | np.arange(len(anchors), dtype=np.uint64)
    starts = np.arange(len(data) - length + 1)
    least = (_least(keys, length - kmer + 1) & _MASK).astype(np.int64)
    row = np.searchsorted(offsets, starts, "right") - 1
    inside = starts + length <= offsets[row + 1]
    starts, least, row = starts[inside], least[inside], row[inside]
    if not len(starts):
        return none, none, none, none.view(np.uint64), none
    new = np.append(True, (least[1:] != least[:-1]) | (row[1:] != row[:-1]) | (starts[1:] != starts[:-1] + 1))
    first = np.flatnonzero(new)
    start, row = starts[first], row[first]
    return row, start - offsets[row], np.diff(np.append(first, len(starts))), anchors[least[first]], least[first] - start


def all_segments(data: np.ndarray, offsets: np.ndarray, length: int, most: int = 1 << (_POSITION - 1)):
    """segments(), text by text and in overlapping parts where there are more bytes than places in the keys' low bits; a
    segment may then be two, with the same anchor."""
    if len(data) <= most:
        return segments(data, offsets, length)
    found = []
    for row, (lo, hi) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        for at in range(lo, max(lo + 1, hi - length + 1), most):
            part = data[at : min(hi, at + most + length - 1)]
            got = segments(part, np.array([0, len(part)]), length)
            found.append((got[0] + row, got[1] + at - lo, *got[2:]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


class SuffixFamily:
    """Suffix arrays of growing size: the starts of strings of `length` bytes in the order of their bytes. A new batch gets an array, is
    scanned in order against every level, and is merged with the levels that are no larger than it: there are as many
    levels as the logarithm of what was added.

    low and high: for each text added, the first and the last of its starts whose string occurs elsewhere too; high is -1 if there is none.
    """

    def __init__(self, length: int) -> None:
        self.length, self.levels = length, []
        self.low, self.high = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, texts: list[bytes]) -> None:
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        base = len(self.low)
        data = np.frombuffer(b"".join(texts), np.uint8)
        self.low, self.high = np.append(self.low, np.full(len(texts), np.iinfo(np.int64).max)), np.append(self.high, np.full(len(texts), -1))
        n = np.maximum(sizes - self.length + 1, 0)
        if not n.sum():
            return
        of = np.repeat(np.arange(len(texts)), n)
        offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        strings = np.lib.stride_tricks.sliding_window_view(data, self.length)[(np.cumsum(sizes) - sizes)[of] + offset]
        strings = strings.view(f"S{self.length}").ravel()  # all of one length: equal only if all their bytes are
        order = np.argsort(strings, kind="stable")
        level = (strings[order], of[order] + base, offset[order])
        same = level[0][1:] == level[0][:-1]
        self._found(level, np.append(same, False) | np.append(False, same))
        for old in self.levels:
            first, last = (np.searchsorted(old[0], level[0], side) for side in ("left", "right"))
            met = last > first
            self._found(level, met)
            self._found(old, covered(len(old[0]), first[met], (last - first)[met]))
        while self.levels and len(self.levels[-1][0]) <= len(level[0]):
            old = self.levels.pop()
            at = np.searchsorted(old[0], level[0], "right") + np.arange(len(level[0]))
            ours = np.zeros(len(old[0]) + len(level[0]), bool)
            ours[at] = True
            merged = []
            for x, y in zip(old, level, strict=True):
                both = np.empty(len(ours), x.dtype)
                both[ours], both[~ours] = y, x
                merged.append(both)
            level = tuple(merged)
        self.levels.append(level)

    def _found(self, level, which: np.ndarray) -> None:
        _, of, offset = level
        np.maximum.at(self.high, of[which], offset[which])
        np.minimum.at(self.low, of[which], offset[which])


def _keyed(docs: DataFrame) -> DataFrame:
    """text with text_hash and text_sum, which stand for it: equal texts share their segments."""
    return docs.select(F.xxhash64("text").alias("text_hash"), F.crc32(F.col("text").cast("binary")).alias("text_sum"), "text")


def _digest(content: bytes) -> bytes:
    return hashlib.blake2b(content, digest_size=16).digest()


def _segment_rows(docs: DataFrame, length: int) -> DataFrame:
    """The segments of docs: anchor, content (a digest of 128 bits of their bytes, which stands for them), the text's keys, start, count
    and place (see segments())."""

    def make(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                data, offsets = utf8(part.column(2))
                row, start, count, anchor, place = all_segments(data, offsets, length)
                raw, begin = data.tobytes(), offsets[row] + start
                content = [_digest(raw[a:b]) for a, b in zip(begin.tolist(), (begin + count - 1 + length).tolist(), strict=True)]
                of = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(content, pa.binary()), part.column(0).take(of), part.column(1).take(of), *(pa.array(x.astype(np.int32)) for x in (start, count, place))], names=["anchor", "content", *_KEYS, "start", "count", "place"])

    return _keyed(docs).mapInArrow(make, "anchor long, content binary, text_hash long, text_sum long, start int, count int, place int")


def _cut(lo: int, hi: int) -> list[tuple[int, int]]:
    """The range in up to WAYS others."""
    step = -(-(hi - lo) // WAYS)
    return [(at, min(at + step, hi)) for at in range(lo, hi, step)]


def _all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.union, frames)


class SuffixIndex:
    """A family of levels, each a table of the segments of the batches in it. add() scans a batch against itself and all levels; before
    that, a level that is no larger than the one after it is merged with it, so that there are as many levels as the
    logarithm of the number of batches."""

    def __init__(self, length: int = 200, most_contents: int = MOST_CONTENTS) -> None:
        self.length, self.most_contents = length, most_contents
        self.levels: list[tuple[DataFrame, int, DataFrame]] = []  # segments, how many, and the texts they are of

    def add(self, docs: DataFrame) -> DataFrame:
        """text_hash, text_sum, start and end of strings of docs (text) and of earlier batches that occur elsewhere too, so far as docs
        shows it: overlapping and repeated spans, which together hold every byte of such strings."""
        while len(self.levels) > 1 and self.levels[-2][1] <= self.levels[-1][1]:
            (a, m, x), (b, n, y) = self.levels[-2:]
            merged = a.union(b).repartition("anchor").sortWithinPartitions("anchor", "content")
            self.levels[-2:] = [(stored(merged, "level"), m + n, x.union(y))]
        docs = docs.where(F.octet_length("text") >= self.length)
        fresh_rows = stored(_segment_rows(docs, self.length), "level")
        older = [level for level, _, _ in self.levels]
        self.levels.append((fresh_rows, fresh_rows.count(), docs))
        seen = _all([fresh_rows.select("anchor", F.lit(1).alias("new")), *(x.select("anchor", F.lit(0).alias("new")) for x in older)])
        # Written first, so that the join below is of two tables and a hot anchor's rows can be split.
        shared = stored(seen.groupBy("anchor").agg(F.count("*").alias("n"), F.max("new").alias("new")).where("n > 1 and new = 1").select("anchor"), "shared")
        some, _ = KeyFilter(shared, "anchor").split(_all([fresh_rows, *older]), "anchor")
        members = stored(some.join(shared, "anchor"), "members")
        tidy(docs.sparkSession)
        contents = stored(members.groupBy("anchor", "content").agg(F.count("*").alias("n"), F.min(F.struct(*_KEYS, "start", "count", "place")).alias("rep")), "contents")
        anchors = contents.groupBy("anchor").agg(F.count("*").alias("contents"), F.min("n").alias("least"))
        # Contents that occur once, under anchors with others: is a part of their strings in one of these?
        doubt = stored(anchors.where("contents > 1 and least = 1").select("anchor"), "doubt")
        known = contents.where("n > 1").select("anchor", "content", F.lit(0).alias("low"), (F.col("rep.count") - 1).alias("high"))
        known = known.union(self._resolved(contents.join(doubt, "anchor")))
        got = members.join(known, ["anchor", "content"])
        return stored(got.select(*_KEYS, (F.col("start") + F.col("low")).alias("start"), (F.col("start") + F.col("high") + self.length).alias("end")).distinct(), "spans")

    def _pieces(self, doubts: DataFrame) -> DataFrame:
        """The bytes of the contents: anchor, sub (their digest), n, owner (anchor and content), base (0), place and bytes. One copy of each
        text that is needed moves."""
        wanted = doubts.select(*[F.col(f"rep.{c}").alias(c) for c in _KEYS], F.struct("anchor", "content", "n", "rep.start", "rep.count", "rep.place").alias("w"))
        wanted = stored(wanted.groupBy(_KEYS).agg(F.collect_list("w").alias("wanted")), "wanted")  # of one text each
        texts = KeyFilter(wanted, "text_hash").split(_keyed(_all([x for _, _, x in self.levels])), "text_hash")[0].groupBy(_KEYS).agg(F.first("text").alias("text"))
        length = self.length

        def cut(batches):
            for batch in batches:
                for part in slices(batch, "text"):
                    out = [[] for _ in range(7)]
                    for text, wanted in zip(part.column(0), part.column(1).to_pylist(), strict=True):
                        raw = text.as_buffer().to_pybytes()
                        for w in wanted:
                            piece = raw[w["start"] : w["start"] + w["count"] - 1 + length]
                            for x, v in zip(out, (w["anchor"], w["content"], w["n"], {"anchor": w["anchor"], "content": w["content"]}, 0, w["place"], piece), strict=True):
                                x.append(v)
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, _PIECE.values(), strict=True)], names=list(_PIECE))

        return texts.join(wanted, _KEYS).select("text", "wanted").mapInArrow(cut, _PIECE_TYPE)

    def _resolved(self, doubts: DataFrame) -> DataFrame:
        """anchor, content, low and high of the contents of which some strings occur elsewhere, by their bytes."""
        pieces, found, calm = stored(self._pieces(doubts), "pieces"), [], []
        tidy(doubts.sparkSession)
        cuts = [(0, self.length - KMER + 1)]
        while any(hi - lo > 1 for lo, hi in cuts):  # else they are whole strings: those that are equal have been found
            hot = KeyFilter(pieces.groupBy("anchor").count().where(F.col("count") > self.most_contents), "anchor")
            if hot.words.isEmpty():
                break
            crowded, rest = hot.split(pieces, "anchor")
            calm.append(rest)
            cuts = [part for lo, hi in cuts for part in _cut(lo, hi)]
            made = stored(self._parts(crowded, cuts), "cut")
            # Parts of equal bytes are repeats; one of each goes on.
            per = stored(made.groupBy("anchor", "sub").agg(F.count("*").alias("k"), F.max("n").alias("n"), *[F.first(c).alias(c) for c in ("owner", "base", "place", "bytes")]), "parts")
            equal = made.join(per.where("k > 1").select("anchor", "sub"), ["anchor", "sub"])
            found.append(equal.select("owner.anchor", "owner.content", F.col("base").alias("low"), (F.col("base") + F.octet_length("bytes") - self.length).alias("high")))
            pieces = per.select("anchor", "sub", F.greatest("n", "k").alias("n"), "owner", "base", "place", "bytes")
        return stored(_all([*found, self._scanned(_all([*calm, pieces]))]), "resolved")

    def _parts(self, pieces: DataFrame, cuts: list[tuple[int, int]]) -> DataFrame:
        """Each piece's strings by how far before its k-mer they start, in the ranges of `cuts`. The anchor of a part is made of the bytes that
        all strings of that range have in common, so equal strings are in parts of equal anchors. A part of one distance
        has a whole string as its anchor."""
        length = self.length

        def cut(batches):
            for batch in batches:
                out = [[] for _ in range(7)]
                for row in batch.to_pylist():
                    raw, place, count = row["bytes"], row["place"], len(row["bytes"]) - length + 1
                    for lo, hi in cuts:
                        first, last = max(0, place - hi + 1), min(count - 1, place - lo)
                        if first > last:
                            continue
                        own = raw[first : last + length]
                        key = hashlib.blake2b(raw[place - lo : place - hi + 1 + length], digest_size=8, salt=b"%d-%d" % (lo, hi)).digest()
                        for x, v in zip(out, (int.from_bytes(key, "little", signed=True), _digest(own), row["n"], row["owner"], row["base"] + first, place - first, own), strict=True):
                            x.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, _PIECE.values(), strict=True)], names=list(_PIECE))

        return pieces.mapInArrow(cut, _PIECE_TYPE)

    def _scanned(self, pieces: DataFrame) -> DataFrame:
        """anchor, content, low and high of pieces whose strings are elsewhere, by suffix arrays of the pieces of each anchor."""
        length = self.length

        def scan(batches):
            for n, owner, base, own in _whole_anchors(batches):
                family = SuffixFamily(length)
                for lo in range(0, len(own), 1024):
                    family.add(own[lo : lo + 1024])
                some = np.flatnonzero((family.high >= 0) & (np.array(n) == 1))  # the others are wholly known already
                rows = [owner[k] for k in some.tolist()]
                shift = np.array(base, np.int64)[some]
                yield pa.RecordBatch.from_arrays([pa.array([r["anchor"] for r in rows], pa.int64()), pa.array([r["content"] for r in rows], pa.binary()), *(pa.array((x[some] + shift).astype(np.int32)) for x in (family.low, family.high))], names=["anchor", "content", "low", "high"])

        dealt = pieces.select("anchor", "n", "owner", "base", "bytes").repartition("anchor").sortWithinPartitions("anchor")
        return dealt.mapInArrow(scan, "anchor long, content binary, low int, high int")


_OWNER = pa.struct([("anchor", pa.int64()), ("content", pa.binary())])
_PIECE = {"anchor": pa.int64(), "sub": pa.binary(), "n": pa.int64(), "owner": _OWNER, "base": pa.int32(), "place": pa.int32(), "bytes": pa.binary()}
_PIECE_TYPE = "anchor long, sub binary, n long, owner struct<anchor:long,content:binary>, base int, place int, bytes binary"


def _whole_anchors(batches, most: int = 2048):
    """(n, owner, base, bytes) of up to `most` rows, never with a part of an anchor's rows only (so more if one anchor has more)."""
    held: pa.Table | None = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        held = rows if held is None else pa.concat_tables([held, rows])
        held, ready = _cut_before_last(held)
        yield from _in_parts(ready, most)
    if held is not None:
        yield from _in_parts(held, most)


def _cut_before_last(rows: pa.Table) -> tuple[pa.Table, pa.Table]:
    """The rows of the last anchor, which may go on in the next batch, and those before."""
    keys = rows.column("anchor").to_numpy()
    end = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0
    return rows.slice(end), rows.slice(0, end)


def _in_parts(rows: pa.Table, most: int):
    keys = rows.column("anchor").to_numpy()
    ends = np.append(np.flatnonzero(np.diff(keys)) + 1, len(keys)) if len(keys) else np.zeros(0, np.int64)
    at = 0
    while at < len(keys):
        end = int(ends[max(np.searchsorted(ends, at, "right"), np.searchsorted(ends, at + most, "right") - 1)])
        yield tuple(rows.column(c).slice(at, end - at).to_pylist() for c in ("n", "owner", "base", "bytes"))
        at = end


def repeats(docs: DataFrame, length: int = 200, text_col: str = "text", most_contents: int = MOST_CONTENTS, batches: int = BATCHES) -> DataFrame:
    """text_hash, text_sum and spans (start, end: bytes, sorted, apart from each other) of the texts of which something
    occurs elsewhere: every byte in a string of `length` bytes that also starts at another place of any text. The texts are
    added to an index in `batches` parts."""
    docs = pick(docs, text=text_col)
    index = SuffixIndex(length, most_contents)
    spans = _all([index.add(docs.where(F.pmod(F.xxhash64("text"), F.lit(batches)) == k)) for k in range(batches)])
    gathered = spans.groupBy(_KEYS).agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("spans"))  # of one text each

    def merge(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(map(_merged, batch.column(2).to_pylist()), _SPANS)], names=[*_KEYS, "spans"])

    return gathered.mapInArrow(merge, "text_hash long, text_sum long, spans array<struct<start:long,end:long>>")


def _merged(spans: list[dict]) -> list[dict]:
    out: list[dict] = []
    for span in spans:
        if out and span["start"] <= out[-1]["end"]:
            out[-1]["end"] = max(out[-1]["end"], span["end"])
        else:
            out.append(dict(span))
    return out


def _with_spans(docs: DataFrame, length: int, text_col: str, most_contents: int, batches: int) -> tuple[DataFrame, str]:
    """docs with a column of spans, null where there are none, and its name. Texts without spans do not move, but for a few that a bitmap of
    fixed size lets through."""
    with scratch(docs.sparkSession):
        found = stored(repeats(docs, length, text_col, most_contents, batches), "spans", keep=True)
    names = [fresh(docs, c) for c in (*_KEYS, "spans")]
    known, found = KeyFilter(found, "text_hash"), found.toDF(*names)
    keyed = docs.withColumns({names[0]: F.xxhash64(docs[text_col]), names[1]: F.crc32(docs[text_col].cast("binary"))})
    met, rest = known.split(keyed, names[0])
    met = met.join(found, names[:2], "left").select(*docs.columns, names[2])
    rest = rest.select(*docs.columns, F.lit(None).cast(found.schema[names[2]].dataType).alias(names[2]))
    return rest.union(met), names[2]


def _kept(raw: bytes, spans) -> bytes:
    at, kept = 0, []
    for span in () if spans is None else spans:
        kept.append(raw[at : span["start"]])
        at = span["end"]
    return b"".join([*kept, raw[at:]])


def repeat_digests(docs: DataFrame, length: int = 200, id_col: str = "doc_id", text_col: str = "text", most_contents: int = MOST_CONTENTS, batches: int = BATCHES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of each row (null text: empty; repeated rows are each other's
    repeats, as any texts are)."""
    cut, name = _with_spans(pick(docs, doc_id=id_col, text=text_col), length, "text", most_contents, batches)
    cut = cut.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), name)
    id_type = cut.schema["doc_id"].dataType.simpleString()

    def digest(batches):
        for batch in (part for whole in batches for part in slices(whole, "text")):
            n, removed, count, sha = [], [], [], []
            for text, spans in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                raw = text.as_buffer().to_pybytes()
                kept = _kept(raw, spans)
                n.append(len(raw))
                removed.append(len(raw) - len(kept))
                count.append(len(spans or ()))
                sha.append(hashlib.sha256(kept).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (n, removed, count)), pa.array(sha, pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return cut.mapInArrow(digest, f"doc_id {id_type}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove_repeats(docs: DataFrame, length: int = 200, text_col: str = "text", most_contents: int = MOST_CONTENTS, batches: int = BATCHES) -> DataFrame:
    """The rows of docs with every repeated string cut out of their texts; characters that are cut in two go whole. Rows stay,
    with an empty text where nothing is left; null texts stay null."""
    cut, name = _with_spans(docs, length, text_col, most_contents, batches)

    @F.arrow_udf("string")
    def keep(texts: pa.Array, spans: pa.Array) -> pa.Array:
        out = []
        for part in slices(pa.RecordBatch.from_arrays([texts, spans], names=["text", "spans"]), "text"):
            own = zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)
            out.append(pa.array([t if s is None else _kept(t.encode(), s).decode(errors="ignore") for t, s in own], pa.string()))
        return pa.concat_arrays(out) if out else texts

    return cut.select(*[F.when(cut[name].isNull(), cut[c]).otherwise(keep(cut[c], cut[name])).alias(c) if c == text_col else cut[c] for c in docs.columns])
