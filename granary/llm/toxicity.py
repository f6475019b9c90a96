"""Toxicity by a linear-chain conditional random field over tokens, learned from the labels of whole documents."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, byte_set, held_out, mix, pick, slices, utf8

#: Tokens are runs of ASCII letters and of characters beyond ASCII, A-Z as a-z.
OUTSIDE = bytes(b for b in range(128) if not chr(b).isalpha())
IS_WORD = byte_set(OUTSIDE)
#: Labelled documents that are learned from, about; how many of them the field itself is fitted on.
MOST_TRAINED, MOST_FITTED = 8_000, 3_000
#: Besides whole tokens, their first bytes can be features, for longer tokens: inflected forms share them.
PREFIXES = (4, 5, 6, 7)
#: Features enter the field if the log odds and the likelihood ratio of their documents' labels are over these.
LEAST_ODDS, SURPRISE = 1.5, 10.0
#: Weight of the squared distance of the weights from where the fit starts: the features' log odds.
RIDGE = 1e-3


@dataclass
class Field:
    """keys: sorted hashes of features; weights: of the toxic state for each, in that order; chain: the weights of the steps clean to toxic,
    toxic to clean and toxic to toxic, and of the toxic state of any token (clean to clean and the clean state are 0, and
    before the first token it is clean); scale: slope and intercept from the log odds of any toxic token to those of a
    document's label."""

    keys: np.ndarray
    weights: np.ndarray
    chain: np.ndarray
    scale: tuple[float, float]


def _power(m: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(log factor, matrix) of m ** n for each n: by the eigenvalues of a positive 2 x 2 matrix."""
    values, vectors = np.linalg.eig(m)
    order = np.argsort(-values)
    values, vectors = values[order], vectors[:, order]
    ratio = np.zeros((len(n), 2, 2))
    ratio[:, 0, 0] = 1
    ratio[:, 1, 1] = (values[1] / values[0]) ** n
    return n * np.log(values[0]), np.maximum(vectors @ ratio @ np.linalg.inv(vectors), 0)


def _gaps(at: np.ndarray, rows: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens without a feature before each hit of its text, and after the last one of each text."""
    before = at - np.append(-1, at[:-1]) - 1
    first = np.append(True, rows[1:] != rows[:-1]) if len(rows) else np.zeros(0, bool)
    before[first] = at[first]
    last = np.append(rows[1:] != rows[:-1], True) if len(rows) else first
    after = lengths.copy()
    after[rows[last]] = lengths[rows[last]] - at[last] - 1
    return before, after


def _steps(chain: np.ndarray) -> np.ndarray:
    """The matrix of a step onto a token without a feature."""
    a, b, c, g = chain
    return np.exp(np.array([[0.0, a + g], [b, c + g]]))


def _run_counts(plain: np.ndarray, n: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For runs of n plain steps between the vectors left and right: the expected number of steps from each state to each (runs, 2, 2). It is
    the derivative of left @ plain ** n @ right by the entries' logarithms, over its value: with eigenvectors V, the sum over
    places i of plain ** i and plain ** (n - 1 - i) has the closed form (p ** n - q ** n) / (p - q)."""
    values, vectors = np.linalg.eig(plain)
    order = np.argsort(-values)
    p, q = values[order]
    vectors = vectors[:, order]
    inverse = np.linalg.inv(vectors)
    x, y = left @ vectors, right @ inverse.T  # in the basis of the eigenvectors
    ratio = (q / p) ** n
    own_p, own_q, both = n / p, np.where(n > 0, n * (q / p) ** np.maximum(n - 1, 0) / p, 0.0), (1 - ratio) / (p - q)
    sums = np.empty((len(n), 2, 2))
    sums[:, 0, 0], sums[:, 1, 1], sums[:, 0, 1], sums[:, 1, 0] = own_p, own_q, both, both
    outer = np.einsum("np,npq,nq->npq", x, sums, y)
    # The entry (i, j) of plain in the basis: inverse[p, i] * plain[i, j] * vectors[j, q]
    counts = np.einsum("npq,pi,jq->nij", outer, inverse, vectors) * plain
    value = x[:, 0] * y[:, 0] + x[:, 1] * y[:, 1] * ratio
    return np.maximum(counts, 0) / np.maximum(value, 1e-300)[:, None, None]


def marginals(chain: np.ndarray, extra: np.ndarray, at: np.ndarray, rows: np.ndarray, lengths: np.ndarray, counted: bool = False):
    """(log Z of each text less that of its all-clean path, which has weight 1; the marginal of the toxic state of each hit; and, if
    counted, each text's expected steps from state to state (texts, 2, 2)).

    extra: the weights of the features of each hit. Forward and backward over hits only: runs of other tokens are powers of
    one matrix, so long texts cost what their hits do. Texts go side by side, hit by hit. The hits are in the order of
    (text, place).
    """
    plain = _steps(chain)
    before, after = _gaps(at, rows, lengths)
    per = np.bincount(rows, minlength=len(lengths))
    first = np.append(0, np.cumsum(per))[:-1]
    log_b, power_b = _power(plain, before)
    hits = np.broadcast_to(plain, (len(extra), 2, 2)).copy()
    hits[:, :, 1] *= np.exp(extra)[:, None]
    forward, state, log = np.zeros((len(extra), 2)), np.tile([1.0, 0.0], (len(lengths), 1)), np.zeros(len(lengths))
    into = np.zeros((len(extra), 2))  # the state before each hit's run
    most = int(per.max(initial=0))
    for k in range(most):
        texts = np.flatnonzero(per > k)
        hit = first[texts] + k
        into[hit] = state[texts]
        now = np.einsum("ni,nij,njk->nk", state[texts], power_b[hit], hits[hit])
        total = now.sum(1)
        state[texts] = forward[hit] = now / total[:, None]
        log[texts] += log_b[hit] + np.log(total)
    log_a, power_a = _power(plain, after)
    done = np.einsum("ni,nij->nj", state, power_a)
    log_z = log + log_a + np.log(np.maximum(done.sum(1), 1e-300))
    last = state.copy()
    back = power_a.sum(2)
    behind = np.zeros((len(extra), 2))  # what follows each hit
    for k in range(most - 1, -1, -1):
        texts = np.flatnonzero(per > k)
        hit = first[texts] + k
        behind[hit] = back[texts] / back[texts].sum(1, keepdims=True)
        back[texts] = np.einsum("nij,njk,nk->ni", power_b[hit], hits[hit], behind[hit])
    both = forward * behind
    p = both[:, 1] / np.maximum(both.sum(1), 1e-300)
    if not counted:
        return log_z, p
    ones = np.ones((len(lengths), 2))
    steps = _run_counts(plain, after, last, ones)
    ahead = np.einsum("nij,nj->ni", hits, behind)  # what follows each run
    np.add.at(steps, rows, _run_counts(plain, before, into, ahead))
    reached = np.einsum("ni,nij->nj", into, power_b)
    onto = reached[:, :, None] * hits * behind[:, None, :]
    np.add.at(steps, rows, onto / np.maximum(onto.sum((1, 2)), 1e-300)[:, None, None])
    return log_z, p, steps


def loss(w: np.ndarray, data, toxic: np.ndarray, start: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """Minus the mean log likelihood of the documents' labels, with its gradient. A document is clean if all of its tokens are, and toxic if
    any is: which ones is not told. As the all-clean path has weight 1 and no counts, the gradient of log Z is the expected
    counts of forward and backward, and that of the toxic ones' 1 - 1 / Z the same times 1 / (1 - Z)."""
    at, rows, lengths, of, keys = data
    chain = w[:4]
    extra = np.bincount(of, w[4:][keys], len(at)) if len(of) else np.zeros(len(at))
    log_z, p, steps = marginals(chain, np.clip(extra, -30, 30), at, rows, lengths, counted=True)
    log_z = np.maximum(log_z, 1e-12)
    value = np.where(toxic, -np.log(-np.expm1(-log_z)), log_z)
    by = np.where(toxic, -1 / np.expm1(np.minimum(log_z, 700)), 1.0) / len(lengths)
    grad = np.zeros(len(w))
    counts = np.einsum("n,nij->ij", by, steps)
    grad[:4] = counts[0, 1], counts[1, 0], counts[1, 1], counts[:, 1].sum()
    np.add.at(grad, 4 + keys, (p * by[rows])[of])
    away = w - start
    return float(value.mean() + 0.5 * ridge * away @ away), grad + ridge * away


def _minimise(f, w: np.ndarray, rounds: int = 60, memory: int = 8) -> np.ndarray:
    """Limited-memory quasi-Newton steps with halving."""
    pairs: list[tuple] = []
    value, grad = f(w)
    for _ in range(rounds):
        step, alphas = -grad, []
        for s, y, r in reversed(pairs):
            alphas.append(r * (s @ step))
            step = step - alphas[-1] * y
        if pairs:
            step = step * (pairs[-1][0] @ pairs[-1][1]) / (pairs[-1][1] @ pairs[-1][1])
        for (s, y, r), a in zip(pairs, reversed(alphas), strict=True):
            step = step + s * (a - r * (y @ step))
        t = min(1.0, 4.0 / max(1e-12, float(abs(step).max())))
        while t > 1e-7:
            new, new_grad = f(w + t * step)
            if new <= value + 1e-4 * t * float(grad @ step):
                break
            t /= 2
        else:
            return w
        s, y = t * step, new_grad - grad
        if s @ y > 1e-12:
            pairs = [*pairs[1 - memory :], (s, y, 1 / float(s @ y))]
        gain, w, value, grad = value - new, w + s, new, new_grad
        if gain < 1e-7:
            break
    return w


def _platt(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    a, b = 1.0, 0.0
    y = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))  # Platt's targets: no certainty
    loss = lambda a, b: float((np.logaddexp(0, a * x + b) - y * (a * x + b)).sum() + 5 * (a - 1) ** 2 + 5e-3 * b * b)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        v = np.maximum(p * (1 - p), 1e-6)
        grad = np.array([((p - y) * x).sum() + 10 * (a - 1), (p - y).sum() + 1e-2 * b])
        hess = np.array([[(v * x * x).sum() + 10, (v * x).sum()], [(v * x).sum(), v.sum() + 1e-2]])
        step = np.linalg.solve(hess, grad)
        t = 1.0
        while t > 1e-6 and not loss(a - t * step[0], b - t * step[1]) <= loss(a, b) - 1e-4 * t * (grad @ step):  # whole steps can diverge
            t /= 2
        if t <= 1e-6:
            break
        a, b = a - t * step[0], b - t * step[1]
        if abs(t * step).max() < 1e-6:
            break
    return float(max(a, 1e-3)), float(b)


def _any_toxic(log_z: np.ndarray) -> np.ndarray:
    """Log odds that any token is toxic: the all-clean path has the share exp(-log_z)."""
    z = np.maximum(log_z, 1e-9)
    return np.where(z > 30, z, np.log(np.expm1(np.minimum(z, 30))))


def _features(words: Words) -> list[np.ndarray]:
    """Hashes of each token's features, 0 for none: itself and its first bytes."""
    return [words.hashes, *words.prefixes]


def _hits(words: Words, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tokens with features, and for each feature of these: which of them, place in keys)."""
    none = np.zeros(0, np.int64)
    if not len(keys):
        return none, none, none
    low = np.uint64((1 << 18) - 1)
    seen = np.zeros(1 << 18, bool)
    seen[(keys & low).astype(np.int64)] = True
    tokens, places = [], []
    for h in _features(words):
        at = np.flatnonzero(seen[(h & low).astype(np.int64)])
        place = np.minimum(np.searchsorted(keys, h[at]), len(keys) - 1)
        same = keys[place] == h[at]
        tokens.append(at[same])
        places.append(place[same])
    token, place = np.concatenate(tokens), np.concatenate(places)
    at, of = np.unique(token, return_inverse=True)
    return at, of, place


def fitted_part(got, most: int = MOST_FITTED):
    """All toxic rows, and of the others every n-th by length, so that `most` or more are left; rows of one length stay in their order."""
    others = got[got["y"] != 1].sort_values("length", kind="stable")
    return pd.concat([got[got["y"] == 1].sort_values("length", kind="stable"), others.iloc[:: max(1, len(others) // most)]])


def learn(docs: DataFrame, labels: DataFrame, most: int = MOST_TRAINED, most_fitted: int = MOST_FITTED, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text") -> Field:
    """Features first, then the field, then the scale, from about `most` labelled documents outside the held-out
    fifth (the most toxic of repeated labels; null labels and ids are left out).

    Features are tokens and their first 4 to 7 bytes. One enters if its log odds between toxic and other
    documents are over LEAST_ODDS, the likelihood ratio against chance over e ** SURPRISE, and it is in 3 toxic documents and 1
    in 400 of them. Copies would make any token of theirs look like evidence, so documents of the same features count once
    (toxic if any is). Which tokens of a toxic document are toxic is nowhere labelled: see loss(). The field is fitted on every
    toxic document and on most_fitted to twice as many of the others, evenly by length (on all, if they are fewer). Rows are put in
    an order of their own first, so the same rows give the same field however they are partitioned.
    """
    marked = pick(labels, doc_id=id_col, y=label_col).where(F.col("y").isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("y").alias("y"))
    n = marked.count()
    if n > most:
        marked = marked.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int((1 << 20) * most / n))
    known = pick(docs, doc_id=id_col, text=text_col).join(F.broadcast(marked), "doc_id").select("y", "text", F.xxhash64("text").alias("mark"))  # about `most` rows

    def bags(batches):
        """(labels, rows and hashes of the distinct features, text by text; a hash of each text's set)."""
        for batch in batches:
            for part in slices(batch, "text"):
                words = Words(*utf8(part.column(1)), IS_WORD, True, PREFIXES)
                found = _features(words)
                h, r = np.concatenate(found), np.concatenate([words.rows] * len(found))
                some = h > 0
                order = np.lexsort((h[some], r[some]))
                h, r = h[some][order], r[some][order]
                new = np.append(True, (h[1:] != h[:-1]) | (r[1:] != r[:-1])) if len(h) else np.zeros(0, bool)
                h, r = h[new], r[new]
                of = np.zeros(part.num_rows, np.uint64)
                np.add.at(of, r, mix(h))
                yield part.column(0).to_numpy(), r, h, of.view(np.int64)

    def tokens(batches):
        for y, r, h, of in bags(batches):
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(of[r]), pa.array(y[r].astype(np.int32))], names=["token", "of", "y"])

    def units(batches):
        for y, r, _, of in bags(batches):
            some = np.unique(r)
            yield pa.RecordBatch.from_arrays([pa.array(of[some]), pa.array(y[some].astype(np.int32))], names=["of", "y"])

    pairs = known.mapInArrow(tokens, "token long, of long, y int").groupBy("token", "of").agg(F.max("y").alias("y"))
    groups = known.mapInArrow(units, "of long, y int").groupBy("of").agg(F.max("y").alias("y")).groupBy("y").count().toPandas().set_index("y")["count"].to_dict()
    n1, n0 = groups.get(1, 0), groups.get(0, 0)
    least = max(3, n1 // 400)
    odds = F.log((F.col("n1") + 0.1) / (n1 + 1)) - F.log((F.col("n") - F.col("n1") + 0.5) / (n0 + 1))
    q = (n1 + 1) / (n1 + n0 + 2)
    rest = F.col("n") - F.col("n1")
    surprise = F.col("n1") * F.log(F.col("n1") / (F.col("n") * q)) + F.when(rest > 0, rest * F.log(rest / (F.col("n") * (1 - q)))).otherwise(0)
    lexicon = pairs.groupBy("token").agg(F.sum("y").alias("n1"), F.count("*").alias("n")).where(f"n1 >= {least}").withColumn("odds", odds).where((F.col("odds") > LEAST_ODDS) & (surprise > SURPRISE)).select("token", "odds").toPandas()
    keys = lexicon["token"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(keys)
    keys, first = keys[order], np.minimum(lexicon["odds"].to_numpy(float)[order], 6.0)
    sent = docs.sparkSession.sparkContext.broadcast(keys)

    def sequences(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                words = Words(*utf8(part.column(1)), IS_WORD, True, PREFIXES)
                at, of, place = _hits(words, sent.value)
                rows, n = words.rows[at], part.num_rows
                cut = lambda x, r: pa.array([v.tolist() for v in np.split(x, np.searchsorted(r, np.arange(1, n)))], pa.list_(pa.int64()))
                order = np.argsort(of, kind="stable")
                own = of[order] - np.searchsorted(rows, rows[of[order]])  # which hit of its text
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int32()), pa.array(np.diff(words.bounds)), cut(at - words.bounds[rows], rows), cut(own, rows[of[order]]), cut(place[order], rows[of[order]]), part.column(2)], names=["y", "length", "at", "of", "key", "mark"])

    got = known.mapInArrow(sequences, "y int, length long, at array<long>, of array<long>, key array<long>, mark long").toPandas()  # about `most` rows
    got = got.sort_values(["length", "mark", "y"], ignore_index=True)

    def columns(rows):
        size, many = (rows[c].map(len).to_numpy(np.int64) for c in ("at", "of"))
        flat = lambda c: np.concatenate([np.zeros(0, np.int64), *[np.asarray(x, np.int64) for x in rows[c]]])
        return flat("at"), np.repeat(np.arange(len(rows)), size), rows["length"].to_numpy(np.int64), flat("of") + np.repeat(np.cumsum(size) - size, many), flat("key")

    chain = np.array([-2.0, 0.0, 1.0, -6.0])
    if not len(got):
        return Field(keys, first, chain, (1.0, -3.0))
    fitted = fitted_part(got, most_fitted)
    start = np.concatenate([chain, first])
    data, toxic = columns(fitted), fitted["y"].to_numpy() == 1
    w = _minimise(lambda w: loss(w, data, toxic, start, RIDGE), start)
    field = Field(keys, w[4:], w[:4], (1.0, 0.0))
    field.scale = _platt(np.clip(_any_toxic(_scored(field, *columns(got))[0]), -12, 12), got["y"].to_numpy(float))
    return field


def _scored(field: Field, at, rows, lengths, of, place):
    extra = np.bincount(of, field.weights[place], len(at)) if len(of) else np.zeros(len(at))
    return marginals(field.chain, np.clip(extra, -30, 30), at, rows, lengths)


def tag(docs: DataFrame, field: Field, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score and spans (start and end in UTF-8 bytes, p) of each row; spans are tokens whose marginal is `least` or more.

    One pass over whole texts. Null texts count as empty; they, and texts without a token, get the score of no evidence.
    Repeated rows each give a row.
    """
    docs = pick(docs, doc_id=id_col, text=text_col)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(field)

    def judge(batches):
        field = sent.value
        a, b = field.scale
        for batch in batches:
            for part in slices(batch, "text"):
                words = Words(*utf8(part.column(1)), IS_WORD, True, PREFIXES)
                at, of, place = _hits(words, field.keys)
                rows = words.rows[at]
                log_z, p = _scored(field, at - words.bounds[rows], rows, np.diff(words.bounds), of, place)
                score = 1 / (1 + np.exp(-np.clip(a * np.clip(_any_toxic(log_z), -12, 12) + b, -500, 500)))
                toxic = np.flatnonzero(p >= least)
                tagged = [pa.array((x[at[toxic]] - words.offsets[rows[toxic]]).astype(np.int64)) for x in (words.starts, words.ends)]
                cuts = np.searchsorted(rows[toxic], np.arange(part.num_rows + 1)).astype(np.int32)
                spans = pa.ListArray.from_arrays(pa.array(cuts), pa.StructArray.from_arrays([*tagged, pa.array(p[toxic])], names=["start", "end", "p"]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score), spans], names=["doc_id", "score", "spans"])

    return docs.mapInArrow(judge, f"doc_id {id_type}, score double, spans array<struct<start:long,end:long,p:double>>")
