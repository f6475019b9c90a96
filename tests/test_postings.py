"""The stored index against a full scan."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from granary.operators import postings as P


def scan(docs, terms, counts, k):
    n = len(docs)
    tfs = {i: counts(t or "") for i, t in docs}
    out = []
    df = {t: sum(1 for c in tfs.values() if c[t]) for t in terms}
    for i, c in tfs.items():
        s = sum((3 if t[0].isascii() else 1) * (1 + math.log(1 + n / df[t])) * c[t] for t in set(terms) if c[t])
        if s > 0:
            out.append((-round(s, 9), i))
    return [(i, -s) for s, i in sorted(out)[:k]]


def pairs(text):
    low = text.lower()
    return Counter(a + b for a, b in zip(low, low[1:], strict=False) if a.isalnum() and b.isalnum())


def data(n=300, seed=3):
    rnd = random.Random(seed)
    made = [(i, " ".join(rnd.choice(["the", "Theatre", "hat", "日本語", "日本", "x1", "É", "éa", "😀b", "a-b", "\n"]) for _ in range(int(rnd.expovariate(0.03)) + 1))) for i in range(n)]
    return [*made, (n, None), (n + 1, ""), (n + 2, "q"), (n + 3, made[0][1])]


@pytest.mark.parametrize("block", [4, 1024])
def test_top_k_of_batches_and_merges(spark, tmp_path, block):
    docs = data()
    frame = spark.createDataFrame(docs, "id long, text string").repartition(3)
    index = P.Postings(spark, str(tmp_path / "i"), block=block, buckets=8)
    assert index.topk(["th"], 5).collect() == [] and index.merge() is None
    for part in range(3):
        index.add(frame.where(F.col("id") % 3 == part), P.bigrams)
    ask = lambda terms, k: [(r.id, round(r.score, 9)) for r in index.topk(terms, k).collect()]
    queries = [(["th", "he", "日本"], 7), (["éa"], 3), (["x1", "zz", "th"], 500), (["th", "th"], 1), (P.text_bigrams("the hat 日本!"), 10)]
    for terms, k in queries:
        assert ask(terms, k) == scan(docs, terms, pairs, k), terms
    before = {r.batch for r in index.live()}
    merged = index.merge()
    assert before == {0, 1, 2} and [r.batch for r in index.live()] == [merged] and index.live()[0].status == str(len(docs)) and index.merge() is None
    for terms, k in queries:
        assert ask(terms, k) == scan(docs, terms, pairs, k), terms
    sizes = index.blocks(["th", "he", "at"]).select("term", "most", "tfs").collect()
    assert all(len(r.tfs) <= block and r.most == r.tfs[0] == max(r.tfs) and list(r.tfs) == sorted(r.tfs, reverse=True) for r in sizes)


def test_a_query_opens_few_blocks_and_folders(spark, tmp_path):
    rnd = random.Random(5)
    docs = spark.createDataFrame([(i, "ab " * (200 if i < 5 else rnd.randint(1, 3)) + ("cd " if i % 2 else "")) for i in range(2000)], "id long, text string")
    index = P.Postings(spark, str(tmp_path / "i"), block=50)
    index.add(docs, P.bigrams)
    all_blocks, opened = index.blocks(["ab", "cd"]).count(), index.needed(["ab", "cd"], 5).count()
    assert opened < all_blocks / 2 and index.needed(["ab"], 5).count() == 1 and [r.id for r in index.topk(["ab", "cd"], 5).collect()] == [1, 3, 0, 2, 4]
    plan = index.blocks(["ab"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters")[1].split("PushedFilters")[0]


def test_words_and_batches_of_growing_size(spark, tmp_path):
    docs = data(120, 9)
    frame = spark.createDataFrame(docs, "id long, text string")
    index = P.Postings(spark, str(tmp_path / "i"))
    index.add(frame.where("id < 100"))
    index.add(frame.where("id >= 100"))
    assert index.merge() is None and len(index.live()) == 2  # the older one is over twice as large
    import re

    counts = lambda t: Counter(w for w in re.findall("[a-z][a-z0-9_]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)) if w not in ("the",))
    assert [(r.id, round(r.score, 9)) for r in index.topk(["theatre", "hat"], 9).collect()] == scan(docs, ["theatre", "hat"], counts, 9)
