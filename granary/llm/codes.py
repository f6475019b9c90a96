"""Vector codes: each vector is cut into parts, and each part is replaced by the number of its nearest codebook entry.

Vectors become integers once and are stored so. A round sends the codebooks (parts x entries x width numbers) to the tasks,
which find every part's nearest entry by partial distances and give back sums for each entry; Spark adds those up.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, met, pick, stored

#: Integer components stay below this, so that squared distances of up to 64 places fit 64 bits.
MOST = 1 << 27


def nearest(points: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of the book (ties: the first) and the squared distance to it, for each point.

    Places are taken in descending variance of the book. The entry nearest in the first place gives each point a complete distance;
    all pairs of points and entries go on from place to place, and a pair is dropped as soon as its sum exceeds that distance.
    """
    n, width = points.shape
    if not n or not width:
        return np.zeros(n, np.int64), np.zeros(n, np.int64)
    order = np.argsort(-book.var(0), kind="stable")
    points, book = points[:, order], book[:, order]
    first = (points[:, :1] - book[:, 0]) ** 2
    best = ((points - book[first.argmin(1)]) ** 2).sum(1)
    row, entry = np.nonzero(first <= best[:, None])
    sums = first[row, entry]
    for place in range(1, width):
        sums = sums + (points[row, place] - book[entry, place]) ** 2
        alive = sums <= best[row]
        row, entry, sums = row[alive], entry[alive], sums[alive]
    starts = np.flatnonzero(np.diff(row, prepend=-1))  # every point still has the entry that gave its distance
    least = np.minimum.reduceat(sums, starts)
    at = np.flatnonzero(sums == least[row])
    return entry[at[np.flatnonzero(np.diff(row[at], prepend=-1))]], least


def _points(column: pa.Array, parts: int) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), parts, len(values) // max(1, len(column)) // parts)


def _tallied(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    """The books after one round: every used entry is the floor of its parts' mean."""
    parts, entries, width = books.shape

    def tally(batches):
        counts, sums = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
        for batch in batches:
            points = _points(batch.column(0), parts)
            for p in range(parts):
                entry, _ = nearest(points[:, p], books[p])
                counts[p] += np.bincount(entry, minlength=entries)
                np.add.at(sums[p], entry, points[:, p])
        used = np.argwhere(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used[:, 0]), pa.array(used[:, 1]), pa.array(counts[counts > 0]), pa.array(sums[counts > 0].tolist(), pa.list_(pa.int64()))], names=["part", "entry", "n", "sums"])

    made = rows.select("numbers").mapInArrow(tally, "part long, entry long, n long, sums array<long>")
    total = made.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.get("sums", F.lit(k))) for k in range(width)]).alias("sums"))
    books = books.copy()
    for r in total.collect():  # parts x entries rows
        books[r["part"], r["entry"]] = [s // r["n"] for s in r["sums"]]
    return books


def integers(vectors: DataFrame, scale: int = 4096, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, label and numbers: floor(scale * x) of each component. Rows go whose vector is null or has a null or non-finite component."""
    rows = pick(vectors, vec_id=id_col, vector=vector_col, label=label_col)
    wrong = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(math.inf)))
    return rows.where(F.col("vector").isNotNull() & ~wrong).select("vec_id", "label", F.transform("vector", lambda x: F.floor(x.cast("double") * scale)).alias("numbers"))


def learn(rows: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6) -> np.ndarray:
    """The codebooks (parts, entries, width) of the rows of integers(). They start as the parts of the rows with the least ids (null ids
    last, equal ids by their numbers); with fewer rows there are fewer entries. An entry that no part is nearest to stays as it is."""
    first = rows.select("vec_id", "numbers").orderBy(F.col("vec_id").asc_nulls_last(), "numbers").limit(entries).collect()
    books = np.array([r["numbers"] for r in first], np.int64)
    books = books.reshape(len(first), parts, -1 if books.size else 0).transpose(1, 0, 2)
    for _ in range(rounds if len(first) else 0):
        books = _tallied(rows, books)
    return books


def encode(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id, label, code (two hex digits for each part's entry) and error (the sum of the parts' squared distances)."""
    parts = len(books)
    digits = np.array([f"{k:02x}" for k in range(256)])

    def name(batches):
        for batch in batches:
            points = _points(batch.column(2), parts)
            found = [nearest(points[:, p], books[p]) for p in range(parts)]
            code = [""] * batch.num_rows
            for entry, _ in found:
                code = np.char.add(code, digits[entry]) if batch.num_rows else code
            error = np.sum([d for _, d in found], 0, np.int64) if batch.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(list(code), pa.string()), pa.array(error, pa.int64())], names=["vec_id", "label", "code", "error"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.select("vec_id", "label", "numbers").mapInArrow(name, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long")


def decode(code: str, books: np.ndarray) -> np.ndarray:
    """The integer vector that a code stands for."""
    return np.concatenate([books[p, int(code[2 * p : 2 * p + 2], 16)] for p in range(len(books))])


def books_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, np.ndarray]:
    """vec_id, label, code, error, label_error (the sum of error over equal labels, nulls together) of each row of integers(), and the codebooks.

    Null ids and labels are values; repeated rows each have a row; no rows give none. Vectors must be of one length that `parts`
    divides, at most 256 entries fit two digits, and components must be below MOST / scale in size: anything else is an error.
    """
    if not 1 <= entries <= 256:
        raise ValueError("codes have two hex digits for an entry: from 1 to 256 entries")
    rows = stored(integers(vectors, scale, id_col, vector_col, label_col), "integers")
    shape = rows.agg(F.min(F.size("numbers")).alias("least"), F.max(F.size("numbers")).alias("most"), F.max(F.greatest(F.array_max("numbers"), -F.array_min("numbers"))).alias("size")).first()
    if shape["least"] is not None and (shape["least"] != shape["most"] or shape["most"] % parts):
        raise ValueError(f"vectors must have one length that {parts} divides, not {shape['least']} to {shape['most']}")
    if (shape["size"] or 0) >= MOST:
        raise ValueError(f"components must be below {MOST // scale} in size")
    books = learn(rows, parts, entries, rounds)
    coded = stored(encode(rows, books), "codes")
    totals = stored(coded.groupBy("label").agg(F.count("*").alias(n := fresh(coded, "n")), F.sum("error").alias("label_error")), "labels")
    return met(coded, totals, "label", n).select("vec_id", "label", "code", "error", "label_error"), books
