"""Packing of token sequences: combinations of lengths that fill a window, with counts by non-negative least squares."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import encoder
from .common import KeyFilter, pick, slices, stored


def combinations(lengths: np.ndarray, width: int) -> np.ndarray:
    """All multisets of two or three of the lengths whose sum is width, as rows of places in lengths; -1 pads pairs."""
    where = np.full(width + 1, -1)
    where[lengths] = np.arange(len(lengths))
    a, b = np.triu_indices(len(lengths))  # lengths are sorted: a <= b
    total = lengths[a] + lengths[b]
    pairs = total == width
    found = [np.column_stack([a[pairs], b[pairs], np.full(pairs.sum(), -1)])]
    rest = width - total
    triple = (rest >= lengths[b]) & (rest <= width)
    a, b, rest = a[triple], b[triple], rest[triple]
    c = where[rest]
    found.append(np.column_stack([a[c >= 0], b[c >= 0], c[c >= 0]]))
    return np.concatenate(found)


def nnls(combos: np.ndarray, counts: np.ndarray, rounds: int = 300) -> np.ndarray:
    """x >= 0 with little |A x - counts|, where column j of A counts the lengths of combination j: accelerated projected
    gradients with restarts. A is never made: a product is a sum by places."""
    n, pad = len(counts), len(counts)
    at = np.where(combos < 0, pad, combos)
    forward = lambda x: np.bincount(at.ravel(), np.repeat(x, 3), n + 1)[:n]
    back = lambda r: np.append(r, 0.0)[at].sum(1)
    v = np.ones(n)
    for _ in range(20):  # the largest eigenvalue of A A'
        v = forward(back(v))
        bound = np.linalg.norm(v)
        v /= max(bound, 1e-300)
    step = 1 / max(1.05 * bound, 1e-300)
    x = y = np.zeros(len(combos))
    t, last = 1.0, np.inf
    for _ in range(rounds):
        r = forward(y) - counts
        new = np.maximum(0, y - step * back(r))
        value = float(r @ r)
        if value > last:
            t = 1.0
        t, before = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        y = new + (before - 1) / t * (new - x)
        x, last = new, value
    return x


def plan(counts: dict[int, int], width: int) -> dict:
    """How pieces shorter than width are placed, from the number of each length: uses of combinations by least squares, rounded
    down; then more of any combination that still fits; then what is left, end to end, longest first.

    For each length: rank (the first pieces of each use of it, ascending), sequence, offset; and used (pieces beyond these
    are left over) and base (where the left-over ones of this length start in the final row of tokens). first_left is
    the sequence where that row begins; sequences is how many there are.
    """
    lengths = np.array(sorted(k for k, n in counts.items() if 0 < k < width and n), np.int64)
    have = np.array([counts[int(k)] for k in lengths], np.int64)
    runs: dict[int, list] = {int(k): [] for k in lengths}
    left, sequence = have.copy(), 0
    if len(lengths):
        combos = combinations(lengths, width)
        if len(combos):
            x = np.floor(nnls(combos, have.astype(float))).astype(np.int64)
            for wanted in (x, np.full(len(x), np.iinfo(np.int64).max)):
                for j in np.argsort(-wanted, kind="stable").tolist():
                    if wanted[j] < 1:
                        break
                    parts = [p for p in combos[j].tolist() if p >= 0]
                    uses = min(int(wanted[j]), *(int(left[p]) // parts.count(p) for p in parts))
                    if uses < 1:
                        continue
                    offset = 0
                    for p in parts:
                        k = int(lengths[p])
                        runs[k].append((int(have[p] - left[p]), sequence, offset))
                        left[p] -= uses
                        offset += k
                    sequence += uses
    base = np.zeros(len(lengths), np.int64)
    sizes = (left * lengths)[::-1]
    base[::-1] = np.cumsum(sizes) - sizes
    by_length = {int(k): (*(np.array(c, np.int64) for c in (zip(*runs[int(k)], strict=True) if runs[int(k)] else ((), (), ()))), int(have[i] - left[i]), int(base[i])) for i, k in enumerate(lengths)}
    return {"lengths": by_length, "first_left": sequence, "sequences": sequence - int(-sizes.sum() // width) if sizes.sum() else sequence}


def _encoded(docs: DataFrame, tokenizer: str, width: int, end_id: int) -> DataFrame:
    """The pieces of each row: whole windows and one that is shorter, which keeps its ids. part and at say where it is: the
    task, and its number among the task's pieces of this length."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def make(batches):
        encode = encoder(tokenizer).encode
        part, seen = TaskContext.get().partitionId(), np.zeros(width + 1, np.int64)
        for batch in batches:
            for rows in slices(batch, "text"):
                ids, bounds = encode([t or "" for t in rows.column(1).to_pylist()])
                of, start, length, crc, total, at, kept = [], [], [], [], [], [], []
                end = np.array([end_id], np.uint32)
                for row in range(rows.num_rows):
                    own = np.concatenate([ids[bounds[row] : bounds[row + 1]], end])
                    for lo in range(0, len(own), width):
                        piece = own[lo : lo + width].tobytes()
                        n = len(piece) // 4
                        of.append(row)
                        start.append(lo)
                        length.append(n)
                        crc.append(zlib.crc32(piece))
                        total.append(len(own))
                        at.append(int(seen[n]))
                        seen[n] += 1
                        kept.append(piece if n < width else None)
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0).take(pa.array(of, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total)), pa.array([part] * len(of), pa.int32()), pa.array(at, pa.int64()), pa.array(kept, pa.binary())],
                    names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "at", "ids"],
                )

    return docs.mapInArrow(make, f"doc_id {id_type}, start long, length long, ids_crc32 long, doc_tokens long, part int, at long, ids binary")


def pack(docs: DataFrame, tokenizer: str, width: int = 1024, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of the rows' token ids (each text's, then end_id) in sequences of at most `width`: doc_id, start (ids of the row
    before the piece), length, ids_crc32 (of the ids as little-endian 32-bit numbers), doc_tokens, sequence_id and offset.

    Each text is cut every `width` ids: whole windows are sequences of their own. The shorter rests are counted by length;
    width - 1 counts reach the driver, which plans (see plan()). A rest's place follows from its number among those of its
    length: partition's first number, by a sum over partitions, plus its own. What no combination takes is laid end to
    end and cut at the windows' ends, so that one sequence in all has padding. Null texts count as empty and have one id,
    end_id; repeated rows each have their own pieces; no rows give none.
    """
    if width < 2:
        raise ValueError("a sequence holds two ids at least")
    pieces = stored(_encoded(pick(docs, doc_id=id_col, text=text_col), tokenizer, width, end_id), "pieces")
    tally = stored(pieces.groupBy("part", "length").agg(F.count("*").alias("n")), "tally")
    counts = {int(r["length"]): int(r["n"]) for r in tally.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    firsts = tally.select("part", "length", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("first"))
    sent = docs.sparkSession.sparkContext.broadcast(plan(counts, width))  # bounded by the combinations that fill the width
    id_type = pieces.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    keys = ["part", "at"]

    def place(batches):
        """sequence_id and offset; first_part: ids before the end of the sequence if the piece goes on in the next, else 0."""
        made = sent.value
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            sequence, offset, cut = made["sequences"] + rank, np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for k in np.unique(length[length < width]).tolist():
                ranks, sequences, offsets, used, base = made["lengths"][k]
                mine = np.flatnonzero(length == k)
                own = rank[mine]
                run = mine[own < used]
                if len(run):
                    at = np.searchsorted(ranks, rank[run], "right") - 1
                    sequence[run], offset[run] = sequences[at] + rank[run] - ranks[at], offsets[at]
                rest = mine[own >= used]
                position = base + (rank[rest] - used) * k
                sequence[rest], offset[rest] = made["first_left"] + position // width, position % width
                cut[rest] = np.where(offset[rest] + k > width, width - offset[rest], 0)
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)) for c in [*names[:5], *keys]] + [pa.array(x) for x in (sequence, offset, cut)], names=[*names[:5], *keys, "sequence_id", "offset", "first_part"])

    ranked = pieces.drop("ids").join(firsts, ["part", "length"]).withColumn("rank", F.col("first") + F.col("at"))
    kinds = f"doc_id {id_type}, start long, length long, ids_crc32 long, doc_tokens long, part int, at long, sequence_id long, offset long, first_part long"
    placed = stored(ranked.mapInArrow(place, kinds), "placed")
    whole = placed.where("first_part = 0").select(names)
    split = placed.where("first_part > 0")
    split = stored(split.drop("doc_id", "ids_crc32").withColumn("key", F.xxhash64("part", "length", "at")), "split")
    shorter = pieces.where(F.col("length") < width).select("part", "length", "at", "doc_id", "ids", F.xxhash64("part", "length", "at").alias("key"))
    again = KeyFilter(split, "key").split(shorter, "key")[0].drop("key").join(split, ["part", "length", "at"])
    columns = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "first_part", "ids"]

    def halves(batches):
        for batch in batches:
            get = dict(zip(batch.schema.names, batch.columns, strict=True))
            start, length, sequence, offset, first = (get[c].to_numpy() for c in ("start", "length", "sequence_id", "offset", "first_part"))
            raw = get["ids"].to_pylist()
            crc = [[zlib.crc32(x[: 4 * int(k)]) for x, k in zip(raw, first, strict=True)], [zlib.crc32(x[4 * int(k) :]) for x, k in zip(raw, first, strict=True)]]
            for part, columns in enumerate(((start, first, sequence, offset), (start + first, length - first, sequence + 1, np.zeros(len(start), np.int64)))):
                yield pa.RecordBatch.from_arrays([get["doc_id"], pa.array(columns[0]), pa.array(columns[1]), pa.array(crc[part], pa.int64()), get["doc_tokens"], pa.array(columns[2]), pa.array(columns[3])], names=names)

    cut = again.select(columns).mapInArrow(halves, f"doc_id {id_type}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    return whole.union(cut)
