"""Quality scores by regularised quadratic discriminant analysis of document statistics."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE_BYTES, Words, byte_set, held_out, per_row, pick, slices, text_column, utf8
from .rules import repeated_words

IS_WORD = byte_set(SPACE_BYTES)
FEATURES = ("log_words", "word_length", "symbols", "separators", "shouts", "capitals", "digits", "stops", "repeated", "distinct", "beyond_ascii", "short_words")
SHRINKAGE = 0.1


def _members(chars: str) -> np.ndarray:
    found = np.zeros(256, bool)
    found[list(chars.encode())] = True
    return found


SETS = {"symbols": _members("#*$%&<>{}\\^~"), "separators": _members("|"), "shouts": _members("!?"), "capitals": _members("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), "digits": _members("0123456789"), "stops": _members(".,;:")}
CONTINUES = np.array([b & 0xC0 == 0x80 for b in range(256)])
BEYOND = np.array([b >= 0xC0 for b in range(256)])


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of transformed statistics for each text: logs of counts, square roots of rates. The rates have a few words or
    characters more in their denominators, so short texts are near the rest and empty ones have zeros."""
    words = Words(data, offsets, IS_WORD)
    n = np.diff(words.bounds)
    total = {k: per_row(s[data], offsets) for k, s in SETS.items()}
    chars = per_row(IS_WORD[data] & ~CONTINUES[data], offsets)
    size = words.ends - words.starts
    repeat = per_row(np.asarray(repeated_words(words, 8)), words.bounds)
    order = np.lexsort((words.hashes, words.rows))
    fresh = np.ones(len(order), bool)
    if len(order):
        h, r = words.hashes[order], words.rows[order]
        fresh[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    distinct = per_row(fresh, words.bounds)  # the order keeps the rows in place
    by_word, by_char = n + 8.0, chars + 40.0
    return np.column_stack([
        np.log(n + 8.0), np.log1p((chars + 40.0) / by_word), np.sqrt(total["symbols"] / by_word), np.sqrt(total["separators"] / by_word), np.sqrt(total["shouts"] / by_word), np.sqrt(total["capitals"] / by_char),
        np.sqrt(total["digits"] / by_char), np.sqrt(total["stops"] / by_word), np.sqrt(repeat / by_word), np.log(distinct + 8.0) - 0.7 * np.log(n + 8.0), np.sqrt(per_row(BEYOND[data], offsets) / by_char), np.sqrt(per_row(size <= 3, words.bounds) / by_word),
    ])


class Discriminant:
    """Two Gaussians. The covariance of each class is shrunk toward its diagonal, with a floor; Cholesky factors are kept."""

    def __init__(self, moments: dict[int, tuple[float, np.ndarray, np.ndarray]], shrinkage: float = SHRINKAGE) -> None:
        """moments: for class 0 and 1 the number of rows, the sum of x and the sum of x x'."""
        self.classes = {}
        rows = sum(n for n, _, _ in moments.values())
        for k, (n, s, ss) in moments.items():
            if n < 1:
                continue
            mean = s / n
            cov = ss / n - np.outer(mean, mean)
            share = max(shrinkage, min(1.0, 2.0 * len(s) / n))
            diagonal = np.maximum(np.diag(cov), 0) + 4e-3
            cov = (1 - share) * cov + share * np.diag(diagonal) + 1e-3 * np.eye(len(s))
            lower = np.linalg.cholesky(cov)
            self.classes[k] = (mean, np.linalg.inv(lower), float(np.log(n / rows) - np.log(np.diag(lower)).sum()))

    def score(self, x: np.ndarray) -> np.ndarray:
        """The probability of class 1; with one class known it is 0 or 1, with none 0.5."""
        if len(self.classes) < 2:
            return np.full(len(x), float(next(iter(self.classes), 0.5)))
        log = {k: c - 0.5 * (((x - mean) @ inverse.T) ** 2).sum(1) for k, (mean, inverse, c) in self.classes.items()}
        return 1 / (1 + np.exp(np.clip(log[0] - log[1], -500, 500)))


def learn(docs: DataFrame, labels: DataFrame, most: int | None = 50_000, shrinkage: float = SHRINKAGE, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> Discriminant:
    """Fitted on about `most` labelled documents outside the held-out fifth (None: on all). Class counts, sums and products
    are summed in the cluster; the driver gets two classes' moments. Labels are one for each document first: the greatest of
    repeated ones; null labels and ids are left out."""
    marked = pick(labels, doc_id=id_col, y=label_col).where(F.col("y").isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("y").alias("y"))
    n = marked.count() if most else 0
    if most and n > most:
        marked = marked.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int((1 << 20) * most / n))
    if most:
        marked = F.broadcast(marked)  # about `most` rows of two numbers
    known = pick(docs, doc_id=id_col, text=text_col).join(marked, "doc_id").select("text", F.col("y").cast("long").alias("y"))

    def moments(batches):
        d = len(FEATURES)
        total = np.zeros((2, 1 + d + d * d))
        for batch in batches:
            for part in slices(batch, "text"):
                x, y = features(*utf8(part.column(0))), part.column(1).to_numpy()
                for k in (0, 1):
                    one = x[y == k]
                    total[k] += np.concatenate([[len(one)], one.sum(0), (one.T @ one).ravel()])
        yield pa.RecordBatch.from_arrays([pa.array([0, 1]), pa.array(total.tolist(), pa.list_(pa.float64()))], names=["y", "v"])

    got = known.mapInArrow(moments, "y long, v array<double>").select("y", F.posexplode("v").alias("at", "v")).groupBy("y", "at").agg(F.sum("v").alias("v")).toPandas().sort_values(["y", "at"])
    d, made = len(FEATURES), {}
    for k, v in got.groupby("y")["v"]:
        v = v.to_numpy()
        made[int(k)] = (v[0], v[1 : 1 + d], v[1 + d :].reshape(d, d))
    return Discriminant(made, shrinkage)


def score(docs: DataFrame, model: Discriminant, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score of each row, in one pass. Null texts are scored as empty ones; repeated rows each give a row."""
    docs = pick(docs, doc_id=id_col, text=text_col)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def judge(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sent.value.score(features(*utf8(part.column(1)))))], names=["doc_id", "score"])

    return docs.mapInArrow(judge, f"doc_id {id_type}, score double")


def keep_good(docs: DataFrame, model: Discriminant, least: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that score `least` or more."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    judge = text_column("double", lambda texts: pa.array(sent.value.score(features(*utf8(texts)))))
    return docs.where(judge(docs[text_col]) >= least)
