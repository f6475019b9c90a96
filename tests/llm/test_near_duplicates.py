import random
import re
from collections import defaultdict

import numpy as np
import pytest
from cases import empty, rows, table

from granary.llm.components import components
from granary.llm.minhash import drop_near_duplicates, near_duplicates, sketch

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute(data, width, percent):
    sets = []
    for _, text in data:
        w = WORD.findall((text or "").translate(LOWER))
        sets.append(frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else []))
    parent = list(range(len(data)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(data)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    groups = defaultdict(list)
    for i in range(len(data)):
        groups[root(i)].append(i)
    out = []
    for members in groups.values():
        ids = [data[i][0] for i in members if data[i][0] is not None]
        least = min(ids, default=None)
        out += [(data[i][0], len(sets[i]), least, data[i][0] == least) for i in members]
    return sorted(out, key=str)


def got(df):
    return sorted([(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in df.collect()], key=str)


@pytest.mark.parametrize("width", [4, 5])
def test_cases(spark, width):
    assert got(near_duplicates(table(spark), width)) == brute([(r[0], r[1]) for r in rows()], width, 80)
    assert near_duplicates(empty(spark), width).collect() == []


def test_groups_of_near_copies_by_every_path(spark):
    rnd = random.Random(7)
    data = []
    for g in range(3):
        base = [f"w{g}{rnd.randint(0, 999)}" for _ in range(90)]
        for _ in range(40):
            t = base.copy()
            for _ in range(rnd.randint(0, 5)):
                t[rnd.randrange(90)] = f"n{rnd.random()}"
            data.append((len(data), " ".join(t)))
    want = brute(data, 4, 80)
    df = spark.createDataFrame(data, "doc_id long, text string")
    for hot, block in ((40, 512), (3, 8), (3, 500)):
        assert got(near_duplicates(df, 4, hot=hot, block=block)) == want


def test_sketches_fill_and_estimate():
    rng = np.random.default_rng(3)
    universe = rng.integers(1, 2**63, 4000, np.uint64)
    pairs = [(universe[:n], universe[k : n + k]) for n, k in ((1, 0), (3, 1), (50, 5), (500, 55), (3000, 500))]
    s = sketch([x for p in pairs for x in p] + [universe[:0]], 128)
    assert (s[:-1] != ~np.uint64(0)).all() and (s[-1] == ~np.uint64(0)).all()
    for i, (a, b) in enumerate(pairs):
        real = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs((s[2 * i] == s[2 * i + 1]).mean() - real) < 0.2


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 130)] + [(200, 200)]
    labels = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(labels[i] == 0 for i in range(61)) and all(labels[i] == 100 for i in range(100, 130))
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_one_row_of_each_group_stays(spark):
    kept = drop_near_duplicates(table(spark), 5)
    assert kept.columns == table(spark).columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [0, 1, 2, 3, 5, 6, 10, 11, 12, 13, 15, 16, 17, 18]


def test_two_runs_in_one_driver(spark):
    """Each run has its own stored tables, and neither changes the session's settings for the other's result."""
    from concurrent.futures import ThreadPoolExecutor

    from granary.llm.suffix import repeat_digests

    want = brute([(r[0], r[1]) for r in rows()], 4, 80)
    digests = sorted(map(str, repeat_digests(table(spark), 200).collect()))
    with ThreadPoolExecutor(4) as pool:
        near = [pool.submit(lambda: got(near_duplicates(table(spark), 4))) for _ in range(2)]
        same = [pool.submit(lambda: sorted(map(str, repeat_digests(table(spark), 200).collect()))) for _ in range(2)]
        assert all(f.result() == want for f in near) and all(f.result() == digests for f in same)
