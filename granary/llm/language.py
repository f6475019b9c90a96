"""Language identification with hyperdimensional letter n-gram profiles."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, pick, slices

DIMENSIONS = 1024
#: Documents that prototypes are learned from, about: a hash of the id picks them.
MOST_TRAINED = 20_000
DENSE_SYMBOLS = 160
#: Letters whose vectors are kept between batches, and n-grams that are bound at a time: bounds of memory.
MOST_LETTERS, MOST_BOUND = 1 << 14, 1 << 12


class Space:
    """Bipolar vectors of letters, seeded by their code points, and of n-grams of three: the first letter's vector moved
    by two places times the second's moved by one times the third's. Everything that is no letter is one blank."""

    def __init__(self, dimensions: int = DIMENSIONS, seed: int = 1) -> None:
        self.dimensions, self.seed = dimensions, seed
        self.symbol = np.full(0x110000, -1, np.int32)  # of a code point; 0 is the blank
        self.used = np.zeros(DENSE_SYMBOLS**3, bool)
        self.place = np.zeros(DENSE_SYMBOLS**3, np.int32)
        self.forget()

    def _vector(self, point: int) -> np.ndarray:
        return np.random.Generator(np.random.PCG64([self.seed, point])).integers(0, 2, self.dimensions, np.int8) * 2 - 1

    def forget(self) -> None:
        self.symbol[:] = -1
        self.letters, self.known = np.zeros((256, self.dimensions), np.int8), 1
        self.letters[0] = self._vector(32)

    def _symbols(self, points: np.ndarray) -> np.ndarray:
        got = self.symbol[points]
        if (got < 0).any():
            for p in np.unique(points[got < 0]).tolist():
                if chr(p).isalpha():
                    if self.known == len(self.letters):
                        self.letters = np.concatenate([self.letters, np.zeros_like(self.letters)])
                    self.symbol[p], self.letters[self.known] = self.known, self._vector(p)
                    self.known += 1
                else:
                    self.symbol[p] = 0
            got = self.symbol[points]
        return got

    def _distinct(self, a: np.ndarray, b: np.ndarray, c: np.ndarray):
        """The letters of the distinct n-grams, and which of them each is."""
        if self.known > DENSE_SYMBOLS:
            codes, which = np.unique((a.astype(np.int64) << 42) | (b.astype(np.int64) << 21) | c, return_inverse=True)
            return (codes >> 42, (codes >> 21) & 0x1FFFFF, codes & 0x1FFFFF), which
        codes = (a * DENSE_SYMBOLS + b) * DENSE_SYMBOLS + c
        self.used[codes] = True
        found = np.flatnonzero(self.used)
        self.used[found] = False
        self.place[found] = np.arange(len(found))
        return (found // DENSE_SYMBOLS**2, found // DENSE_SYMBOLS % DENSE_SYMBOLS, found % DENSE_SYMBOLS), self.place[codes]

    def bundles(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """For each text the sum of its n-grams' vectors, and its number of letters. Some thousand n-grams are bound at a time."""
        if self.known > MOST_LETTERS:
            self.forget()
        parts = [f" {(t or '').lower()} " for t in texts]
        points = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)
        lengths = np.fromiter(map(len, parts), np.int64, len(parts))
        rows = np.repeat(np.arange(len(parts)), lengths)
        symbols = self._symbols(points)
        letter = symbols > 0
        keep = letter.copy()
        keep[1:] |= letter[:-1]  # one blank after each word; the first blank of a text comes before its first word
        keep[np.cumsum(lengths) - lengths] = True
        symbols, rows = symbols[keep], rows[keep]
        inside = rows[2:] == rows[:-2]
        (a, b, c), which = self._distinct(symbols[:-2][inside], symbols[1:-1][inside], symbols[2:][inside])
        rows = rows[2:][inside]
        order = np.argsort(which, kind="stable") if len(a) > MOST_BOUND else np.arange(len(which))
        cuts = np.searchsorted(which[order], np.arange(0, len(a) + MOST_BOUND, MOST_BOUND)) if len(a) > MOST_BOUND else np.array([0, len(which)])
        out = np.zeros((len(parts), self.dimensions), np.float32)
        for k, lo in enumerate(range(0, len(a), MOST_BOUND)):
            some, hi = order[cuts[k] : cuts[k + 1]], min(len(a), lo + MOST_BOUND)
            bound = np.roll(self.letters[a[lo:hi]], 2, 1) * np.roll(self.letters[b[lo:hi]], 1, 1) * self.letters[c[lo:hi]]
            counts = np.bincount(rows[some] * (hi - lo) + which[some] - lo, minlength=len(parts) * (hi - lo)).reshape(len(parts), hi - lo)
            out += counts.astype(np.float32) @ bound.astype(np.float32)
        return out, np.add.reduceat(letter.astype(np.int64), np.cumsum(lengths) - lengths) if len(parts) else np.zeros(0, np.int64)


def _parts(batches, space: Space):
    for batch in batches:
        for part in slices(batch, "text"):
            for at in range(0, part.num_rows, 256):
                rows = part.slice(at, 256)
                yield rows, *space.bundles(rows.column(1).to_pylist())


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def learn_prototypes(docs: DataFrame, most: int = MOST_TRAINED, dimensions: int = DIMENSIONS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """(languages, prototypes): the sum of the unit vectors of each language's documents, less the mean of all languages.

    Learned from about `most` of the documents outside the held-out fifth that have a text and a language. Each task sends
    a vector for each language, which are summed in the cluster; the driver gets languages x dimensions numbers.
    """
    known = pick(docs, doc_id=id_col, text=text_col, lang=lang_col).where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    n = known.select("doc_id").count()
    if n > most:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int((1 << 20) * most / n))

    def bundle(batches):
        sums: dict[str, np.ndarray] = {}
        for rows, vectors, letters in _parts(batches, Space(dimensions)):
            unit = _unit(vectors)
            langs = np.array(rows.column(2).to_pylist(), object)
            for lang in set(langs[letters > 0]):
                sums[lang] = sums.get(lang, 0) + unit[(langs == lang) & (letters > 0)].sum(0, dtype=np.float64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))], names=["lang", "v"])

    found = known.mapInArrow(bundle, "lang string, v array<double>").select("lang", F.posexplode("v").alias("at", "x")).groupBy("lang", "at").agg(F.sum("x").alias("x")).toPandas()
    if not len(found):
        return [], np.zeros((0, dimensions), np.float32)
    wide = found.pivot(index="lang", columns="at", values="x").sort_index()
    vectors = _unit(wide.to_numpy())
    if len(vectors) > 1:
        vectors = vectors - vectors.mean(0)
    return list(wide.index), _unit(vectors).astype(np.float32)


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred and score of each row, from whole texts in one pass.

    lang_pred: the language of the greatest cosine, the first in order among equals; score: (1 + cosine) / 2. A null text,
    one without a letter, or a model without languages gives `und` and 0. Repeated rows each give a row.
    """
    docs = pick(docs, doc_id=id_col, text=text_col)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def compare(batches):
        langs, prototypes = sent.value
        for rows, vectors, letters in _parts(batches, Space(prototypes.shape[1])):
            near = _unit(vectors) @ prototypes.T if langs else np.zeros((len(vectors), 1))
            best = near.argmax(1)
            known = (letters > 0) & bool(langs)
            pred = [langs[b] if k else "und" for b, k in zip(best, known, strict=True)]
            score = np.where(known, np.clip((1 + near[np.arange(len(near)), best]) / 2, 0, 1), 0.0)
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(pred, pa.string()), pa.array(score.astype(np.float64))], names=["doc_id", "lang_pred", "score"])

    return docs.mapInArrow(compare, f"doc_id {id_type}, lang_pred string, score double")
