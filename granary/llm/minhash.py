"""Near-duplicate documents: fast similarity sketches, banding, and exact verification on whole shingle sets."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .common import SPACE_BYTES, KeyFilter, Words, byte_set, fresh, in_filter, mix, pick, rng_table, scratch, slices, stored, utf8, windows

IS_WORD = byte_set(SPACE_BYTES)
#: A pair of similarity 0.8 misses all of 32 bands of 4 coordinates with probability 5e-8; one of 0.2 meets with 5e-2.
BANDS, ROWS = 32, 4
#: Bytes of whole sets in a block of a hot bucket, about.
BLOCK_BYTES = 4 << 20
_STEPS = rng_table(29, 512)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's shingles of `width` words; of a text with fewer, but not none, of all of them."""
    words = Words(data, offsets, IS_WORD, lower=True)
    full = windows(words.hashes, width)
    found = []
    for lo, hi in zip(words.bounds[:-1].tolist(), words.bounds[1:].tolist(), strict=True):
        found.append(np.unique(full[lo : hi - width + 1] if hi - lo >= width else windows(words.hashes[lo:hi], hi - lo) if hi > lo else full[:0]))
    return found


def sketch(sets: list[np.ndarray], bins: int) -> np.ndarray:
    """Fast similarity sketching: in round i < bins each element falls into one bin with a value, and each bin keeps the
    least of the first round that reaches it; in round bins + j every element falls into bin j, so that all bins are full
    after twice as many rounds. Sets of some bins * log(bins) elements are done in the first rounds. Equal coordinates have
    the probability of the Jaccard similarity, and their number is as concentrated as with independent samples.

    Gives (sets, bins) of round << 40 | value; empty sets have all ones.
    """
    bits = np.uint64(bins.bit_length() - 1)
    if bins != 1 << int(bits):
        raise ValueError("bins is a power of two")
    if len(sets) * bins > 1 << 24:  # a slot and a value share 64 bits
        half = len(sets) // 2
        return np.vstack([sketch(sets[:half], bins), sketch(sets[half:], bins)])
    out = np.full((len(sets), bins), ~np.uint64(0))
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    todo = np.flatnonzero(sizes)
    left = np.full(len(sets), bins)
    x = np.concatenate([sets[i] for i in todo]) if len(todo) else np.zeros(0, np.uint64)
    of = np.repeat(todo, sizes[todo])
    for i in range(2 * bins):
        if not len(todo):
            break
        h = mix(x + _STEPS[i % len(_STEPS)] * np.uint64(1 + i // len(_STEPS)))
        value = (h << bits) >> np.uint64(24)  # 40 bits beside those of the bin
        bin_ = (h >> (np.uint64(64) - bits)).astype(np.int64) if i < bins else np.full(len(x), i - bins)
        slot = of * bins + bin_
        both = np.sort((slot.astype(np.uint64) << np.uint64(40)) | value)
        slot, value = (both >> np.uint64(40)).astype(np.int64), both & np.uint64((1 << 40) - 1)
        first = np.append(True, slot[1:] != slot[:-1])
        slot, value = slot[first], value[first]
        free = out.reshape(-1)[slot] == ~np.uint64(0)
        out.reshape(-1)[slot[free]] = (np.uint64(i) << np.uint64(40)) | value[free]
        left -= np.bincount(slot[free] // bins, minlength=len(sets))
        if (left[todo] == 0).any():
            keep = left[of] > 0
            x, of = x[keep], of[keep]
            todo = todo[left[todo] > 0]
    return out


def bands(coordinates: np.ndarray, rows: int) -> np.ndarray:
    """A 64-bit key for each band of each sketch; the band's number is part of it."""
    n = coordinates.shape[1] // rows
    keys = np.broadcast_to(mix(np.arange(1, n + 1, dtype=np.uint64)), (len(coordinates), n)).copy()
    for r in range(rows):
        keys = mix(keys + coordinates[:, r::rows][:, :n])
    return keys


def content_keys(data: np.ndarray, offsets: np.ndarray) -> list[bytes | None]:
    """A digest of 128 bits of each text's words, A-Z as a-z; None without any."""
    raw = data.tobytes()
    cut = [raw[a:b].lower().split() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
    return [hashlib.blake2b(b" ".join(w), digest_size=16).digest() if w else None for w in cut]


def _row_key() -> Column:
    return F.xxhash64("doc_id", "text").alias("at")


def sketched(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, at (a hash of the row), content (the digest of the words: texts of equal words are one class; null without words),
    n_shingles and bands of each row."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def make(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                data, offsets = utf8(part.column(2))
                sets = shingle_sets(data, offsets, width)
                keys = bands(sketch(sets, BANDS * ROWS), ROWS).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(content_keys(data, offsets), pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.FixedSizeListArray.from_arrays(pa.array(keys.ravel()), BANDS).cast(pa.list_(pa.int64()))], names=["doc_id", "at", "content", "n_shingles", "bands"])

    return docs.select("doc_id", _row_key(), "text").mapInArrow(make, f"doc_id {id_type}, at long, content binary, n_shingles long, bands array<long>")


def whole_sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """cid and shingles (sorted 64-bit hashes) of the wanted classes (cid, content, at), from the rows they name. Texts do not move: a
    task makes the sets of the rows in a bitmap of `at`, and only sets are joined."""
    held = KeyFilter(wanted, "at").sent()

    def make(batches):
        for batch in batches:
            for some in slices(batch.filter(pa.array(in_filter(held.value, batch.column(0).to_numpy()))), "text"):
                data, offsets = utf8(some.column(1))
                sets = shingle_sets(data, offsets, width)
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(content_keys(data, offsets), pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["at", "content", "shingles"])

    found = docs.select(_row_key(), "text").mapInArrow(make, "at long, content binary, shingles binary")
    return found.join(wanted, ["at", "content"]).select("cid", "shingles")


def similar(inter, size_a, size_b, percent: int):
    return 100 * inter >= percent * (size_a + size_b - inter)


def _check_pairs(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that are links, by their whole sets."""
    left = sets.select(F.col("cid").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("cid").alias("b"), F.col("shingles").alias("y"))

    def check(batches):
        for batch in batches:
            a, b, x, y = batch.columns
            keep = []
            for p, q in zip(x.to_pylist(), y.to_pylist(), strict=True):
                p, q = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
                keep.append(similar(len(np.intersect1d(p, q, assume_unique=True)), len(p), len(q), percent))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([a.filter(keep), b.filter(keep)], names=["a", "b"])

    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(check, "a long, b long")


def _forest(links: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Links that connect what all of them connect."""
    parent = list(range(n))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    kept = []
    for i, j in links.tolist():
        if (p := root(i)) != (q := root(j)):
            parent[max(p, q)] = min(p, q)
            kept.append((i, j))
    return kept


def _links(sets: list[np.ndarray], labels: np.ndarray, first: int, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links of sets[:first] with the rest, or of all if first is their number; those of one label are linked
    already. The sizes of all intersections at once, by products of 0/1 matrices over the shingles that two or more sets have."""
    n = len(sets)
    sizes = np.fromiter(map(len, sets), np.int64, n)
    values, column, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    place = np.full(len(values), -1)
    shared = np.flatnonzero(counts > 1)
    place[shared] = np.arange(len(shared))
    row, column = np.repeat(np.arange(n), sizes), place[column]
    row, column = row[column >= 0], column[column >= 0]
    start = first if first < n else 0
    inter = np.zeros((first, n - start), np.float32)
    for lo in range(0, len(shared), 4096):
        part = (column >= lo) & (column < lo + 4096)
        m = np.zeros((n, min(4096, len(shared) - lo)), np.float32)
        m[row[part], column[part] - lo] = 1
        inter += m[:first] @ m[start:].T
    linked = similar(np.rint(inter).astype(np.int64), sizes[:first, None], sizes[None, start:], percent) & (labels[:first, None] != labels[None, start:])
    i, j = np.nonzero(linked)
    j = j + start
    return _forest(np.column_stack([i, j])[i < j], n)


def _check_blocks(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links by whole sets within jobs: rows (job, side, cid, label), each job in one task, where side 0 meets side 1, or itself if
    there is no side 1. Of the links a spanning forest is kept: none that connects anything is left out."""

    def check(table):
        side = table.column("side").to_numpy()
        order = np.argsort(side, kind="stable")
        ids, labels, raw = table.column("cid").to_numpy()[order], table.column("label").to_numpy()[order], table.column("shingles").to_pylist()
        held = [np.frombuffer(raw[k], np.uint64) for k in order.tolist()]
        first = int((side == 0).sum())
        kept = _links(held, labels, first, percent) if first and len(held) > 1 else []
        return pa.table({"a": pa.array([int(ids[i]) for i, _ in kept], pa.int64()), "b": pa.array([int(ids[j]) for _, j in kept], pa.int64())})

    return rows.join(sets, "cid").groupBy("job").applyInArrow(check, "a long, b long")


def _blocks(count, total, block: int):
    """Into how many blocks `count` sets of `total` hashes go: `block` sets or BLOCK_BYTES each, about."""
    return F.greatest(F.lit(1), F.ceil(count / block), F.ceil(8 * total / BLOCK_BYTES)).cast("int")


def _star_jobs(large: DataFrame, block: int) -> DataFrame:
    """Each hot bucket's members against one of them: as many sets are compared and sent as there are members. Buckets share
    their pivots where they can, and each two classes meet once."""
    pivots = large.groupBy("bucket").agg(F.min(F.struct(F.xxhash64("cid").alias("h"), "cid")).alias("p"), F.first("members").alias("members"), F.first("total").alias("total")).select("bucket", F.col("p.cid").alias("pivot"), _blocks(F.col("members"), F.col("total"), block).alias("salts"))
    pivots = pivots.select("bucket", "pivot", F.explode(F.expr("sequence(0, salts - 1)")).alias("salt"))
    salted = large.withColumn("salt", F.pmod(F.xxhash64("cid"), _blocks(F.col("members"), F.col("total"), block)).cast("int"))
    met = stored(salted.join(pivots, ["bucket", "salt"]).where("cid <> pivot").select("pivot", "cid", F.col("n").cast("long").alias("n")).distinct(), "stars")
    size = met.groupBy("pivot").agg(_blocks(F.count("*"), F.sum("n"), block).alias("blocks"))
    size = stored(size, "pivots")
    parts = met.join(size, "pivot").select(F.struct("pivot", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int").alias("part")).alias("job"), F.lit(1).alias("side"), "cid")
    heads = size.select("pivot", F.explode(F.expr("sequence(0, blocks - 1)")).alias("part")).select(F.struct("pivot", "part").alias("job"), F.lit(0).alias("side"), F.col("pivot").alias("cid"))
    return parts.union(heads).withColumn("label", F.col("cid"))


def _open_jobs(large: DataFrame, labels: DataFrame, block: int) -> DataFrame:
    """Hot buckets whose members are not all linked yet: those of the most common label in blocks of their own, the others in blocks
    that meet each other and them. Two classes of one label are never compared."""
    tagged = stored(large.select("bucket", "cid", "n").join(labels, "cid", "left").withColumn("label", F.coalesce("label", "cid")), "tagged")
    per = tagged.groupBy("bucket", "label").agg(F.count("*").alias("k"), F.sum("n").alias("size"))
    per = per.groupBy("bucket").agg(F.max(F.struct("k", "label", "size")).alias("main"), F.sum("k").alias("k"), F.sum("size").alias("size"), F.count("*").alias("labels")).where("labels > 1")
    shape = stored(per.select("bucket", F.col("main.label").alias("main"), _blocks(F.col("k") - F.col("main.k"), F.col("size") - F.col("main.size"), block).alias("others"), _blocks(F.col("main.k"), F.col("main.size"), block).alias("mains")), "open")
    placed = tagged.join(shape, "bucket").withColumn("x", F.when(F.col("label") == F.col("main"), F.col("others") + F.pmod(F.xxhash64("cid"), F.col("mains"))).otherwise(F.pmod(F.xxhash64("cid"), F.col("others"))).cast("int"))
    sent = placed.select("bucket", "cid", "label", "x", F.explode(F.expr("sequence(0, if(x < others, others + mains, others) - 1)")).alias("y"))
    return sent.select(F.struct("bucket", F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j")).alias("job"), (F.col("x") > F.col("y")).cast("int").alias("side"), "cid", "label")


def _labelled(docs: DataFrame, width: int, percent: int, hot: int, block: int) -> DataFrame:
    """doc_id, at, n_shingles and component_id of each row of docs (doc_id, text)."""
    with scratch(docs.sparkSession):
        made = stored(sketched(docs, width), "sketches")
        classes = made.where("content is not null").groupBy("content").agg(F.min("doc_id").alias("min_id"), F.min(F.struct("doc_id", "at")).alias("rep"), F.max("n_shingles").alias("n"), F.first("bands").alias("bands"))
        classes = stored(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")  # numbers that stay: they are written
        banded = classes.select("cid", F.col("n").cast("int").alias("n"), F.explode("bands").alias("bucket"))
        counts = banded.groupBy("bucket").agg(F.count("*").alias("members"), F.sum("n").alias("total")).where("members > 1")
        members = stored(banded.join(counts, "bucket"), "buckets")
        large = members.where(F.col("members") > hot)

        small = members.where(F.col("members") <= hot).select("bucket", "cid", "n")
        other = small.select("bucket", F.col("cid").alias("b"), F.col("n").alias("m"))
        fits = F.least("n", "m") * 100 >= F.greatest("n", "m") * percent
        pairs = stored(small.join(other, "bucket").where((F.col("cid") < F.col("b")) & fits).select(F.col("cid").alias("a"), "b").distinct(), "pairs")

        wanted = pairs.select(F.col("a").alias("cid")).union(pairs.select("b")).union(large.select("cid")).distinct()
        wanted = stored(wanted.join(classes.select("cid", "content", "rep.at"), "cid"), "wanted")
        sets = stored(whole_sets(docs, wanted, width), "sets")
        near = components(_check_pairs(pairs, sets, percent).union(_check_blocks(_star_jobs(large, max(1, block // 8)), sets, percent)))
        labels = near.select(F.col("node").alias("cid"), "label")
        # What is left of hot buckets links whole components.
        more = stored(_check_blocks(_open_jobs(large, labels, block), sets, percent), "links")
        end = lambda c: more.join(labels.toDF(c, "to"), c, "left").select("a", "b", F.coalesce("to", c).alias("to"))
        joined = end("a").toDF("a", "b", "x").join(end("b").toDF("a", "b", "y"), ["a", "b"]).select(F.col("x").alias("a"), F.col("y").alias("b"))
        outer = components(joined).toDF("label", "outer")

        known = classes.select("cid", "content", "min_id").join(labels, "cid", "left").withColumn("label", F.coalesce("label", "cid"))
        linked = stored(known.join(outer, "label", "left").select("content", "min_id", F.coalesce("outer", "label").alias("label")), "linked", keep=True)
        made = stored(made.select("doc_id", "at", "content", "n_shingles"), "rows", keep=True)
    least = linked.groupBy("label").agg(F.min("min_id").alias("component_id"))
    found = linked.join(least, "label").select("content", "component_id")
    return made.select("doc_id", "at", "content", "n_shingles").join(found, "content", "left").select("doc_id", "at", "n_shingles", F.when(F.col("content").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", hot: int = 40, block: int = 512) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each row: components of documents linked by a Jaccard similarity of
    percent / 100 or more of their sets of distinct `width`-word shingles (A-Z as a-z, words between ASCII white space).

    Equal word sequences are one class, so that copies, however many, go on as one. Classes share buckets by bands of their
    sketches. Buckets of up to `hot` classes give pairs, once each and only if the sizes allow the similarity. In larger ones all
    members meet one of them first; only where that does not link them all, blocks of those outside the largest component
    meet the others. All links are verified on whole sets, of 64-bit hashes of shingles. A pair at the threshold itself is
    missed with a probability of 5e-8; nothing else is.

    A text with fewer words than `width` has one shingle of all of them; one without words, or null, has none and is linked
    with nothing. component_id: the least doc_id of the component, nulls aside (null if it has only such); kept: doc_id is
    component_id, also where both are null. Repeated rows each give a row.
    """
    found = _labelled(pick(docs, doc_id=id_col, text=text_col), width, percent, hot, block)
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", hot: int = 40, block: int = 512) -> DataFrame:
    """The rows of docs, with all their columns, without those that near_duplicates() doesn't keep: the document of the least
    id of each component stays. Of rows with the same id and text one stays."""
    key, name = fresh(docs, "row_key"), fresh(docs, "row_id")
    with scratch(docs.sparkSession):
        found = _labelled(pick(docs, doc_id=id_col, text=text_col), width, percent, hot, block)
        rows = found.groupBy("doc_id", "at").agg(F.count("*").alias("n"), F.bool_and(F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("kept"))
        marked = stored(rows.where("n > 1 or not kept").select(F.col("doc_id").alias(name), F.col("at").alias(key), "kept"), "verdicts", keep=True)
    gone, again = (stored(marked.where(c).drop("kept"), "verdicts") for c in ("not kept", "kept"))
    # Rows outside the bitmap, most of them, stay where they are.
    met, rest = KeyFilter(marked, key).split(docs.withColumn(key, F.xxhash64(docs[id_col], docs[text_col])), key)
    same = lambda other: [met[key] == other[key], met[id_col].eqNullSafe(other[name])]
    repeated = met.join(again, same(again), "left_semi").dropDuplicates([id_col, text_col])
    left = met.join(gone, same(gone), "left_anti").join(again, same(again), "left_anti")
    return rest.union(left).union(repeated).select(docs.columns)
