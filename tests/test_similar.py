"""Lists without near repeats against a fold in order."""

import random

import pytest
from pyspark.sql import functions as F

from granary.functions import text as X
from granary.operators import similar


def fold(names, threshold):
    """Places that stay: each goes that is like one that stayed."""
    done = []
    for place, name in names:
        bare = "".join(c for c in name if not c.isspace() and c not in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
        tokens = {bare[i : i + 2] for i in range(len(bare) - 1)}
        if not any(name == n or (tokens and t and len(tokens & t) / len(tokens | t) > threshold) for _, n, t in done):
            done.append((place, name, tokens))
    return [p for p, _, _ in done]


@pytest.mark.parametrize("seed", range(2))
def test_first_unlike(spark, seed):
    rnd = random.Random(seed)
    lists = {}
    for g in range(5):
        base = ["".join(rnd.choice("abcdef ") for _ in range(rnd.randint(0, 30))) for _ in range(8)]
        names = []
        for place in range(70):
            name = list(rnd.choice(base))
            for _ in range(rnd.randint(0, 3)):
                if name:
                    name[rnd.randrange(len(name))] = rnd.choice("abcdef!")
            names.append((place * 3, "".join(name)))
        lists[g] = names
    lists[9] = [(k, "one and the same title") for k in range(200)]
    rows = spark.createDataFrame([(g, p, n) for g, ns in lists.items() for p, n in ns], "q int, place int, name string").repartition(3)
    items = rows.withColumn("tokens", F.array_sort(X.title_bigrams(F.col("name"))))
    got = {}
    for r in similar.first_unlike(items, "q", 0.8).collect():
        got.setdefault(r.q, []).append(r.place)
    assert {g: sorted(ps) for g, ps in got.items()} == {g: fold(ns, 0.8) for g, ns in lists.items()}
    assert similar.first_unlike(items.where("q = 77"), "q", 0.8).collect() == []


@pytest.mark.parametrize("threshold", [0.3, 0.5, 2 / 3, 0.8])
def test_like_pairs_are_all_pairs(spark, threshold):
    rnd = random.Random(int(threshold * 100))
    sets = []
    for base in ([f"t{i}" for i in range(12)], [f"u{i}" for i in range(40)], [f"v{i}" for i in range(600)]):  # of over 256 tokens too
        sets += [sorted(rnd.sample(base, rnd.randint(len(base) // 2, len(base)))) for _ in range(40)] + [base, base[:-1]]
    sets += [[], [], ["t1"], ["t1", "t2"]]
    rows = [(k % 2, k, s) for k, s in enumerate(sets)]
    items = spark.createDataFrame(rows, "q int, place int, tokens array<string>").repartition(3)
    want = set()
    for q, a, s in rows:
        for p, b, t in rows:
            if q == p and a < b and s and t and len(set(s) & set(t)) / len(set(s) | set(t)) > threshold:
                want.add((q, a, b))
    got = [(r.q, r.a, r.b) for r in similar.like_pairs(items, "q", threshold).collect()]
    assert set(got) == want and len(got) == len(want) > 0


def test_unlike_pairs_of_shared_tokens_are_not_compared(spark):
    """A thousand sets of twenty out of forty tokens are unlike, but share rare ones: hundreds of thousands of pairs were compared in full."""
    rnd = random.Random(3)
    rows = [(0, k, rnd.sample([f"t{i}" for i in range(40)], 20)) for k in range(1000)]
    assert similar.met_pairs(spark.createDataFrame(rows, "q int, place int, tokens array<string>"), "q", 0.8).count() < 100
