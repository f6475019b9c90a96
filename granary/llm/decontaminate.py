"""Benchmark decontamination by a broadcast set of normalised n-grams, or, for large benchmarks, by joins of windows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import KeyFilter, Words, byte_set, covered, fresh, in_filter, per_row, pick, slices, stored, text_column, utf8, windows

#: A-Z count as a-z; words are runs of ASCII letters, digits and any other characters beyond ASCII.
OUTSIDE = bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
IS_WORD = byte_set(OUTSIDE)
IS_WORD[65:91] = True
#: Bytes of benchmark texts and ids up to which they are broadcast: some 80 bytes of arrays a word in each worker, 200 MB in all.
MOST_BYTES = 16 << 20


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_SPANS_TYPE = "array<struct<start:long,end:long>>"


def _words(texts: pa.Array) -> Words:
    return Words(*utf8(texts), IS_WORD, lower=True)


def _item_windows(words: Words, n: int):
    """(length, first words) of the windows of the items: all of n words, and items with fewer as one each."""
    counts = np.diff(words.bounds)
    for length in np.unique(np.minimum(counts[counts > 0], n)).tolist():
        if length < n:
            yield length, words.bounds[:-1][counts == length]
        else:
            at = np.arange(max(0, len(words.hashes) - n + 1))
            yield n, at[words.rows[at] == words.rows[at + n - 1]]


def benchmark_items(items: DataFrame, item_col: str = "item_id", text_col: str = "text", most_bytes: int = MOST_BYTES) -> pa.Table | None:
    """item and text of the items with a text; None if they have over most_bytes, which is asked before anything is collected."""
    items = pick(items, item=item_col, text=text_col).where(F.octet_length("text") > 0).select(F.col("item").cast("string").alias("item"), "text")
    size = items.agg(F.sum(F.octet_length("text") + F.coalesce(F.octet_length("item"), F.lit(0)) + 16)).first()[0] or 0
    return items.toArrow() if size <= most_bytes else None


class Matcher:
    """The broadcast items, ready to scan texts; made once in a task."""

    def __init__(self, items: pa.Table, n: int) -> None:
        self.names = sorted({x for x in items.column("item").to_pylist() if x is not None})
        place = {x: k for k, x in enumerate(self.names)}
        self.item = np.array([place.get(x, -1) for x in items.column("item").to_pylist()], np.int64)
        self.words = _words(items.column("text"))
        self.grams = []
        for length, at in _item_windows(self.words, n):
            hashes = windows(self.words.hashes, length)[at]
            order = np.argsort(hashes, kind="stable")
            seen = np.zeros(1 << 20, bool)
            seen[(hashes & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
            self.grams.append((length, hashes[order], at[order], seen))

    def scan(self, texts: pa.Array):
        """(words, hit words, items by row, spans by row) of each text. A window found by its hash counts if its words are equal."""
        words = _words(texts)
        starts, lengths, pairs = [], [], []
        for length, hashes, places, seen in self.grams:
            h = windows(words.hashes, length)
            at = np.flatnonzero(seen[(h & np.uint64((1 << 20) - 1)).astype(np.int64)])
            at = at[words.rows[at] == words.rows[at + length - 1]]
            low = np.searchsorted(hashes, h[at])
            counts = np.searchsorted(hashes, h[at], "right") - low
            ends = np.cumsum(counts)
            for lo in range(0, int(ends[-1]) if len(ends) else 0, 1 << 16):  # (window, window of an item) with equal hashes
                pair = np.arange(lo, min(lo + (1 << 16), int(ends[-1])))
                k = np.searchsorted(ends, pair, "right")
                other = places[low[k] + pair - (ends[k] - counts[k])]
                same = words.equal(at[k], length, self.words, other)
                starts.append(np.unique(at[k][same]))
                lengths.append(np.full(len(starts[-1]), length))
                who = self.item[self.words.rows[other[same]]]
                pairs.append(np.unique(words.rows[at[k][same]][who >= 0] * len(self.names) + who[who >= 0]))
        found = np.unique(np.concatenate(pairs)).tolist() if pairs else []
        who: dict[int, list[str]] = {}
        for x in found:
            who.setdefault(x // len(self.names), []).append(self.names[x % len(self.names)])
        none = np.zeros(0, np.int64)
        hit = covered(len(words.hashes), np.concatenate(starts) if starts else none, np.concatenate(lengths) if lengths else none)
        return np.diff(words.bounds), per_row(hit, words.bounds), who, _runs(words, hit, len(texts))


def _runs(words: Words, hit: np.ndarray, n: int) -> list[list[dict]]:
    """The runs of hit words of each text, in bytes of it."""
    spans: list[list[dict]] = [[] for _ in range(n)]
    at = np.flatnonzero(hit)
    if len(at):
        new = np.append(True, (np.diff(at) > 1) | (np.diff(words.rows[at]) > 0))
        opens = at[new]
        stops = np.append(at[:-1][new[1:]], at[-1])
        for a, b in zip(opens.tolist(), stops.tolist(), strict=True):
            row = int(words.rows[a])
            spans[row].append({"start": int(words.starts[a] - words.offsets[row]), "end": int(words.ends[b] - words.offsets[row])})
    return spans


def find_hits(docs: DataFrame, items: DataFrame, n: int = 13, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", most_bytes: int = MOST_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, items (sorted as strings) and spans (start, end in bytes of the runs of hit words).

    A benchmark of up to most_bytes is broadcast and whole texts are scanned in one pass without a shuffle; a larger one is
    joined, see joined_hits(). Null and empty texts have no words; repeated rows each give a row; an empty benchmark gives no
    hits; items without a word or a text are passed over; items that share a window are each listed; windows of items
    without an id hit as well, but the list has no entry for them.
    """
    docs = pick(docs, doc_id=id_col, text=text_col)
    held = benchmark_items(items, item_col, item_text, most_bytes)
    if held is None:
        found = joined_hits(docs, items, n, item_col, item_text)
        none = {"n_hit": "0L", "items": "cast(array() as array<string>)", "spans": f"cast(array() as {_SPANS_TYPE})"}
        counted = docs.select("doc_id", *_keys(F.col("text")), text_column("long", lambda t: pa.array(np.diff(_words(t).bounds)))(F.col("text")).alias("n_words"))
        return counted.join(found, ["text_hash", "text_sum"], "left").select("doc_id", "n_words", *[F.coalesce(c, F.expr(v)).alias(c) for c, v in none.items()])
    id_type = docs.schema["doc_id"].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(held)

    def scan(batches):
        matcher = Matcher(sent.value, n)
        for batch in batches:
            for part in slices(batch, "text"):
                n_words, n_hit, who, spans = matcher.scan(part.column(1))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n_words), pa.array(n_hit), pa.array([who.get(i, []) for i in range(part.num_rows)], pa.list_(pa.string())), pa.array(spans, _SPANS)], names=["doc_id", "n_words", "n_hit", "items", "spans"]
                )

    return docs.mapInArrow(scan, f"doc_id {id_type}, n_words long, n_hit long, items array<string>, spans {_SPANS_TYPE}")


def _keys(text: Column) -> list[Column]:
    text = F.coalesce(text, F.lit(""))
    return [F.xxhash64(text).alias("text_hash"), F.crc32(text.cast("binary")).alias("text_sum")]


def joined_hits(docs: DataFrame, items: DataFrame, n: int, item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """text_hash, text_sum, n_hit, items and spans of the texts with hits, for a benchmark of any size: a bitmap of fixed size sorts
    most windows of the texts out, the rest are joined with those of the items by their words."""

    def item_rows(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                words = _words(part.column(1))
                for length, at in _item_windows(words, n):
                    h, rows = windows(words.hashes, length)[at], pa.array(words.rows[at])
                    yield pa.RecordBatch.from_arrays([part.column(0).take(rows), pa.array(h.view(np.int64)), _spelled(words, at, length)], names=["item", "hash", "words"])

    grams = pick(items, item=item_col, text=item_text).where(F.octet_length("text") > 0).select(F.col("item").cast("string").alias("item"), "text")
    grams = stored(grams.mapInArrow(item_rows, "item string, hash long, words string").distinct(), "grams")
    held = KeyFilter(grams, "hash").sent()

    def doc_rows(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                words = _words(part.column(2))
                for length in range(1, n + 1):
                    h = windows(words.hashes, length)
                    at = np.flatnonzero(in_filter(held.value, h))
                    at = at[words.rows[at] == words.rows[at + length - 1]]
                    rows = words.rows[at]
                    begin, end = words.starts[at] - words.offsets[rows], words.ends[at + length - 1] - words.offsets[rows]
                    places = (at - words.bounds[rows], np.full(len(at), length), begin, end)
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows)), part.column(1).take(pa.array(rows)), *map(pa.array, places), _spelled(words, at, length)], names=names)

    names = ["text_hash", "text_sum", "at", "length", "begin", "end", "words"]
    keyed = docs.where(F.octet_length("text") > 0).select(*_keys(F.col("text")), "text")
    met = keyed.mapInArrow(doc_rows, "text_hash long, text_sum long, at long, length long, begin long, end long, words string").distinct()
    met = stored(met.join(grams.select("words").distinct(), "words", "left_semi"), "windows")
    keys = ["text_hash", "text_sum"]
    who = met.select(*keys, "words").distinct().join(grams.where("item is not null").select("words", "item"), "words").groupBy(keys).agg(F.array_sort(F.collect_set("item")).alias("items"))
    gathered = met.groupBy(keys).agg(F.array_sort(F.collect_list(F.struct("at", "length", "begin", "end"))).alias("hits"))

    def merge(batches):
        for batch in batches:
            counts, spans = [], []
            for hits in batch.column(2).to_pylist():
                stop, count, own = -1, 0, []
                for x in hits:  # by the number of their first word
                    last = x["at"] + x["length"]
                    count += max(0, last - max(stop, x["at"]))
                    if own and x["at"] <= stop:
                        own[-1]["end"] = max(own[-1]["end"], x["end"])
                    else:
                        own.append({"start": x["begin"], "end": x["end"]})
                    stop = max(stop, last)
                counts.append(count)
                spans.append(own)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(counts, pa.int64()), pa.array(spans, _SPANS)], names=[*keys, "n_hit", "spans"])

    hits = gathered.mapInArrow(merge, f"text_hash long, text_sum long, n_hit long, spans {_SPANS_TYPE}")
    return stored(hits.join(who, keys, "left").select(*keys, "n_hit", "items", "spans"), "hits")


def _spelled(words: Words, at: np.ndarray, length: int) -> pa.Array:
    """The words of each window with blanks between."""
    return pa.array([b" ".join(words.text(k) for k in range(i, i + length)).decode() for i in at.tolist()], pa.string())


def is_contaminated():
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def decontaminate(docs: DataFrame, items: DataFrame, n: int = 13, remove: str = "documents", id_col: str = "doc_id", text_col: str = "text", most_bytes: int = MOST_BYTES) -> DataFrame:
    """The documents without the contaminated ones (remove="documents"), or all of them with every hit span cut out of
    its text (remove="spans"; what stands around a span stays as it is). The columns are those of docs. Rows keep a null text."""
    if remove not in ("documents", "spans"):
        raise ValueError("remove is documents or spans")
    held = benchmark_items(items, most_bytes=most_bytes)
    if held is None:
        return _decontaminate_joined(docs, joined_hits(pick(docs, text=text_col), items, n), remove, text_col)
    sent = docs.sparkSession.sparkContext.broadcast(held)
    made: list[Matcher] = []  # one in each worker

    def matcher() -> Matcher:
        if not made:
            made.append(Matcher(sent.value, n))
        return made[0]

    def clean(texts: pa.Array) -> pa.Array:
        words, hit, _, _ = matcher().scan(texts)
        return pa.array((hit == 0) | (20 * hit < words))

    def cut(texts: pa.Array) -> pa.Array:
        _, hit, _, spans = matcher().scan(texts)
        return pa.array([_cut(t, s) if h else t for t, s, h in zip(texts.to_pylist(), spans, hit.tolist(), strict=True)], pa.string())

    if remove == "documents":
        return docs.where(text_column("boolean", clean)(docs[text_col]))
    return docs.select(*[text_column("string", cut)(docs[c]).alias(c) if c == text_col else docs[c] for c in docs.columns])


def _decontaminate_joined(docs: DataFrame, hits: DataFrame, remove: str, text_col: str) -> DataFrame:
    names = [fresh(docs, c) for c in ("text_hash", "text_sum", "n_hit", "spans")]
    hits = hits.select("text_hash", "text_sum", "n_hit", "spans").toDF(*names)
    keyed = docs.withColumns(dict(zip(names, _keys(docs[text_col]), strict=False)))
    met, rest = KeyFilter(hits, names[0]).split(keyed, names[0])
    rest, met = rest.select(docs.columns), met.join(hits, names[:2], "left")
    if remove == "documents":
        words = text_column("long", lambda t: pa.array(np.diff(_words(t).bounds)))(F.col(text_col))
        return rest.union(met.where(F.col(names[2]).isNull() | (20 * F.col(names[2]) < words)).select(docs.columns))

    @F.arrow_udf("string")
    def cut(texts: pa.Array, spans: pa.Array) -> pa.Array:
        return pa.array([_cut(t, s) if s else t for t, s in zip(texts.to_pylist(), spans.to_pylist(), strict=True)], pa.string())

    return rest.union(met.select(*[cut(F.col(c), F.col(names[3])).alias(c) if c == text_col else F.col(c) for c in docs.columns]))


def _cut(text: str, spans: list[dict]) -> str:
    raw, kept, at = text.encode(), [], 0
    for span in spans:
        kept.append(raw[at : span["start"]])
        at = span["end"]
    return b"".join([*kept, raw[at:]]).decode()
