"""Vector codes against plain loops."""

import hashlib
import math
import random

import numpy as np
import pytest

from granary.llm.codes import books_digest, compress, decode, nearest
from granary.llm.common import met, stored

SCHEMA = "vec_id long, embedding array<float>, label int, numbers string, n long, code string, other_key int"


def brute(data, parts=8, entries=16, rounds=6):
    kept = [(i, [math.floor(4096 * x) for x in v], label) for i, v, label in data if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = len(kept[0][1]) // parts
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for _, v, _ in kept]
    first = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, kept[k][1]))[:entries]
    books = [[cut[k][p] for k in first] for p in range(parts)]

    def assign():
        return [[min((sum((a - b) ** 2 for a, b in zip(row[p], e, strict=True)), k) for k, e in enumerate(books[p])) for p in range(parts)] for row in cut]

    for _ in range(rounds):
        found = assign()
        for p in range(parts):
            for k in range(len(books[p])):
                mine = [row[p] for row, f in zip(cut, found, strict=True) if f[p][1] == k]
                if mine:
                    books[p][k] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    found = assign()
    errors = [sum(d for d, _ in f) for f in found]
    totals = {}
    for (_, _, label), e in zip(kept, errors, strict=True):
        totals[label] = totals.get(label, 0) + e
    text = ",".join(str(x) for book in books for entry in book for x in entry)
    return sorted([(i, "".join(f"{k:02x}" for _, k in f), e, totals[label]) for (i, _, label), f, e in zip(kept, found, errors, strict=True)], key=str), hashlib.sha256(text.encode()).hexdigest()


def vectors(n, seed=1, dims=16, labels=5):
    rnd = random.Random(seed)
    made = [(rnd.randint(-50, 500), [float(np.float32(rnd.choice([0.0, 0.5, -0.25, rnd.gauss(0, 1)]))) for _ in range(dims)], rnd.choice([None, *range(labels)])) for _ in range(n)]
    return [*made, made[0], (None, made[1][1], 1), (7, None, 1), (8, [None, *made[0][1][1:]], 1), (9, [math.nan, *made[0][1][1:]], 1), (10, [-math.inf, *made[0][1][1:]], 2)]


def frame(spark, data):
    return spark.createDataFrame([(i, v, label, "x", 1, "y", 2) for i, v, label in data], SCHEMA).repartition(3)


@pytest.mark.parametrize("n", [3, 40, 300])
def test_codes(spark, n):
    data = vectors(n)
    coded, books = compress(frame(spark, data))
    got = sorted([(r.vec_id, r.code, r.error, r.label_error) for r in coded.collect()], key=str)
    assert (got, books_digest(books)) == brute(data)


def test_codes_decode_to_the_error_given(spark):
    data = [v for v in vectors(80, seed=3) if v[0] is not None]
    coded, books = compress(frame(spark, [(k, v, label) for k, (_, v, label) in enumerate(data)]))
    for r in coded.collect():
        number = np.array([math.floor(4096 * x) for x in data[r.vec_id][1]])
        assert ((number - decode(r.code, books)) ** 2).sum() == r.error


def test_nearest_is_exact_with_ties():
    rnd = np.random.default_rng(5)
    for width in (1, 2, 8):
        points, book = rnd.integers(-3, 4, (400, width)), rnd.integers(-3, 4, (16, width))
        book[7] = book[3]
        far = ((points[:, None] - book) ** 2).sum(2)
        entry, distance = nearest(points, book)
        assert (entry == far.argmin(1)).all() and (distance == far.min(1)).all()


def test_empty_and_refused(spark):
    coded, books = compress(frame(spark, []))
    assert coded.collect() == [] and books_digest(books) == hashlib.sha256(b"").hexdigest()
    with pytest.raises(ValueError):
        compress(frame(spark, [(1, [0.0] * 16, 1), (2, [0.0] * 8, 1)]))
    with pytest.raises(ValueError):
        compress(frame(spark, [(1, [1e30] * 16, 1)]))


def test_groups_are_met_whether_hot_or_not(spark):
    rows = spark.range(6000).selectExpr("id", "case when id % 3 = 0 then null when id % 3 = 1 then 1 else id end as k")
    rows = stored(rows, "rows")
    groups = stored(rows.groupBy("k").count().withColumn("twice", rows["k"] * 2), "groups")
    got = met(rows, groups, "k", "count").collect()
    assert len(got) == 6000 and all((r["count"], r.twice) == ((2000, None if r.k is None else 2 * r.k) if r.id % 3 < 2 else (1, 2 * r.k)) for r in got)
