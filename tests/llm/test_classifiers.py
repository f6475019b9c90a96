import numpy as np
import pytest
from cases import empty, table
from pyspark.sql import functions as F

from granary.llm import language, quality, toxicity
from granary.llm.common import held_out

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").limit(4000).cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


def test_held_out_is_crc32(spark):
    import zlib

    rows = spark.range(50).select("id", held_out(F.col("id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 5 == 0) for r in rows)


def test_language(spark, docs):
    model = language.learn_prototypes(docs)
    assert model[0] == ["de", "en", "es", "fr"]
    found = language.identify(docs, model).join(docs, "doc_id").where(held_out(F.col("doc_id")) & (F.length("text") > 60))
    assert found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.98
    odd = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(table(spark), model).collect() if r.doc_id is not None}
    assert odd[0] == odd[1] == odd[2] == ("und", 0.0) and len(odd) == 19 and all(0 <= s <= 1 for _, s in odd.values())
    assert language.identify(empty(spark), model).collect() == [] and language.learn_prototypes(empty(spark))[0] == []
    assert {r.lang_pred for r in language.identify(table(spark), language.learn_prototypes(empty(spark))).collect()} == {"und"}


def test_many_letters_are_bound_in_parts(monkeypatch):
    """Texts of scripts with many letters: bounded memory, and the same sums by every way."""
    rng = np.random.default_rng(6)
    texts = ["".join(map(chr, rng.integers(0x4E00, 0x9FA5, 20_000))), "ab " * 300, "ÀÉ ünï"]
    one = language.Space(64).bundles(texts)[0]
    monkeypatch.setattr(language, "MOST_BOUND", 1 << 20)
    assert (language.Space(64).bundles(texts)[0] == one).all() and abs(one[0]).sum() > 0
    monkeypatch.setattr(language, "DENSE_SYMBOLS", 3)
    assert (language.Space(64).bundles(texts[1:])[0] == one[1:]).all()


def test_bundles_are_sums_of_bound_letters():
    space = language.Space(64, 5)
    v = {c: space._vector(ord(c)) for c in "ab "}
    gram = lambda x, y, z: np.roll(v[x], 2).astype(int) * np.roll(v[y], 1) * v[z]
    got, letters = space.bundles(["Ab, b", "", None, "7"])
    want = gram(" ", "a", "b") + gram("a", "b", " ") + gram("b", " ", "b") + gram(" ", "b", " ")
    assert got[0].tolist() == want.tolist() and letters.tolist() == [3, 0, 0, 0]


def accuracy(scored, labels, column, at):
    joined = scored.join(labels, "doc_id").where(held_out(F.col("doc_id"))).select((F.col("score") >= at).cast("int").alias("p"), column).toPandas()
    return {y: float((joined[joined[column] == y]["p"] == y).mean()) for y in (0, 1)}


def test_quality(spark, docs, labels):
    model = quality.learn(docs, labels)
    right = accuracy(quality.score(docs, model), labels, "quality", 0.3)
    assert right[1] > 0.97 and right[0] > 0.9
    odd = quality.score(table(spark), model).collect()
    assert len(odd) == 22 and all(0 <= r.score <= 1 for r in odd)
    assert quality.score(empty(spark), model).collect() == []
    none = quality.learn(empty(spark), labels)
    assert {r.score for r in quality.score(table(spark), none).collect()} == {0.5}
    kept = quality.keep_good(table(spark), model)
    assert kept.columns == table(spark).columns


def test_discriminant_against_the_formula():
    rng = np.random.default_rng(2)
    moments, raw = {}, {}
    for k in (0, 1):
        x = rng.normal(k, 1 + k, (400, 3))
        raw[k], moments[k] = x, (len(x), x.sum(0), x.T @ x)
    model = quality.Discriminant(moments, shrinkage=0.1)
    x = rng.normal(0.5, 1, (20, 3))
    log = []
    for k in (0, 1):
        m = raw[k].mean(0)
        c = np.cov(raw[k].T, bias=True)
        c = 0.9 * c + 0.1 * np.diag(np.diag(c) + 4e-3) + 1e-3 * np.eye(3)
        log.append(np.log(0.5) - 0.5 * np.linalg.slogdet(c)[1] - 0.5 * np.einsum("ni,ij,nj->n", x - m, np.linalg.inv(c), x - m))
    assert np.allclose(model.score(x), 1 / (1 + np.exp(log[0] - log[1])))


def brute_field(chain, extra, at, n):
    """log Z, marginals and expected steps by all 2 ** n labelings."""
    of, (a, b, c, g) = dict(zip(at, extra, strict=True)), chain
    total, toxic, steps = 0.0, np.zeros(n), np.zeros((2, 2))
    for code in range(2**n):
        y, w, last, k = [(code >> t) & 1 for t in range(n)], 0.0, 0, np.zeros((2, 2))
        for t in range(n):
            w += [[0, a], [b, c]][last][y[t]] + y[t] * (g + of.get(t, 0))
            k[last, y[t]] += 1
            last = y[t]
        total += np.exp(w)
        toxic += np.exp(w) * np.array(y)
        steps += np.exp(w) * k
    return np.log(total), toxic / total, steps / total


def some_hits(rng):
    lengths, rows, at = rng.integers(0, 9, 4), [], []
    for r, n in enumerate(lengths):
        hits = np.flatnonzero(rng.random(n) < 0.4)
        rows += [r] * len(hits)
        at += hits.tolist()
    return np.array(at, int), np.array(rows, int), lengths


def test_forward_backward_against_all_labelings():
    rng = np.random.default_rng(8)
    for _ in range(40):
        chain, (at, rows, lengths) = rng.normal(0, 1, 4), some_hits(rng)
        extra = rng.normal(1, 2, len(at))
        log_z, p, steps = toxicity.marginals(chain, extra, at, rows, lengths, counted=True)
        for r, n in enumerate(lengths.tolist()):
            mine = rows == r
            z, m, k = brute_field(chain, extra[mine], at[mine].tolist(), n)
            assert np.isclose(log_z[r], z) and np.allclose(p[mine], m[at[mine]]) and np.allclose(steps[r], k)


def test_the_gradient_is_that_of_the_loss():
    rng = np.random.default_rng(9)
    for _ in range(10):
        at, rows, lengths = some_hits(rng)
        of = np.append(np.arange(len(at)), rng.integers(0, max(1, len(at)), min(3, len(at))))
        data = (at, rows, np.maximum(lengths, 1), of, rng.integers(0, 3, len(of)))
        w, start, toxic = rng.normal(0, 1, 7), rng.normal(0, 1, 7), np.array([True, False, True, False])
        value = lambda x: toxicity.loss(x, data, toxic, start, 1e-2)  # noqa: E731, B023
        number = [(value(w + e)[0] - value(w - e)[0]) / 2e-6 for e in 1e-6 * np.eye(7)]
        assert np.allclose(value(w)[1], number, atol=1e-6)
        assert value(toxicity._minimise(value, w))[0] < value(w)[0]


def test_toxicity(spark, labels):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    field = toxicity.learn(docs, labels)
    right = accuracy(toxicity.tag(docs, field), labels, "toxic", 0.5)
    assert right[0] > 0.99 and right[1] > 0.85
    probe = spark.createDataFrame([(1, "You are an Idiot, and stupid."), (2, "A kind word."), (3, None), (4, "")], "doc_id long, text string")
    got = {r.doc_id: r for r in toxicity.tag(probe, field).collect()}
    assert got[1].score >= 0.5 > max(got[k].score for k in (2, 3, 4))
    assert [("You are an Idiot, and stupid."[s.start : s.end]).lower() for s in got[1].spans] == ["idiot", "stupid"]
    assert len(toxicity.tag(table(spark), field).collect()) == 22 and toxicity.tag(empty(spark), field).collect() == []
    none = toxicity.learn(empty(spark), labels)
    assert all(r.score < 0.5 for r in toxicity.tag(table(spark), none).collect())


def test_distinct_texts_with_the_same_least_token_are_evidence_each(spark):
    from granary.llm.common import Words

    made = [a + b + c for a in "bdfgk" for b in "aeiou" for c in "lmnrst"]  # too short for prefixes
    raw = " ".join(made).encode()
    order = np.argsort(Words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), toxicity.IS_WORD, True).hashes)
    least, rest = made[order[0]], [made[i] for i in order[1:]]
    some = lambda i: " ".join(w for k, w in enumerate(rest) if (i * 7919 + k * 104729) % 11 == 0 or k == i % len(rest))
    mean = rest[-1]
    rows = [(i, f"{least} {some(i).replace(mean, '')} {mean if i % 8 == 0 else ''}", int(i % 8 == 0)) for i in range(800)]
    data = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    field = toxicity.learn(data.select("doc_id", "text"), data.select("doc_id", "toxic"))
    one = np.frombuffer(mean.encode(), np.uint8)
    assert Words(one, np.array([0, len(one)]), toxicity.IS_WORD, True).hashes.tolist() == field.keys.tolist()


def test_the_field_is_fitted_on_every_toxic_document():
    import pandas as pd

    got = pd.DataFrame({"y": [1] * 900 + [0] * 7100, "length": range(8000)})
    part = toxicity.fitted_part(got)
    assert (part["y"] == 1).sum() == 900 and toxicity.MOST_FITTED <= (part["y"] == 0).sum() < 2 * toxicity.MOST_FITTED


def test_the_scale_does_not_diverge():
    for low in (-12.0, -9.0, -4.0, -1.0):
        for n in (5, 30, 300):
            x = np.concatenate([np.full(3000, low), np.full(n, 12.0)])
            a, b = toxicity._platt(x, (x > 0).astype(float))
            assert a < 10 and a * low + b < 0 < a * 12 + b
