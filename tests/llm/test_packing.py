import zlib
from collections import defaultdict

import numpy as np
import pytest
from cases import empty, rows, table

from granary.llm.packing import combinations, nnls, pack, plan
from granary.llm.queries import tokenizer_path


def check(df, data, width, ids_of):
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in df.collect():
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append((r["offset"], r.length))
    want = defaultdict(list)
    for key, text in data:
        want[key].append(ids_of(text))
    for key, versions in want.items():
        left = sorted((r.start, r.length, r.ids_crc32, r.doc_tokens) for r in pieces[key])
        real = []
        for ids in versions:
            real.append(len(ids))
        assert sum(x[1] for x in left) == sum(real)
        if len(versions) == 1:
            at = 0
            for start, length, crc, total in left:
                assert start == at and total == len(versions[0]) and crc == zlib.crc32(versions[0][start : start + length].tobytes())
                at += length
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= width
    return sum(width - sum(n for _, n in s) for s in sequences.values())


@pytest.mark.parametrize("width", [16, 64, 1024])
def test_cases(spark, width):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path())
    ids = lambda t: np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], np.uint32)
    data = [(r[0], r[1]) for r in rows()]
    assert check(pack(table(spark), tokenizer_path(), width), data, width, ids) < width
    assert pack(empty(spark), tokenizer_path(), width).collect() == []


def test_combinations_fill_the_window():
    lengths = np.array([1, 2, 5, 7, 8, 9, 14])
    found = {tuple(sorted(lengths[p] for p in row if p >= 0)) for row in combinations(lengths, 16)}
    want = {tuple(sorted((a, b))) for a in lengths for b in lengths if a + b == 16} | {tuple(sorted((a, b, c))) for a in lengths for b in lengths for c in lengths if a + b + c == 16}
    assert found == want


def test_least_squares_and_plan():
    rng = np.random.default_rng(5)
    counts = {int(k): int(n) for k, n in zip(range(1, 64), rng.integers(0, 50, 63), strict=True)}
    lengths = np.array([k for k in counts if counts[k]])
    combos = combinations(lengths, 64)
    have = np.array([counts[k] for k in lengths.tolist()], float)
    x = nnls(combos, have)
    assert (x >= 0).all()
    a = np.zeros((len(lengths), len(combos)))
    for j, row in enumerate(combos):
        for p in row[row >= 0]:
            a[p, j] += 1
    gradient = a.T @ (a @ x - have)
    assert gradient.min() > -0.5 and abs(gradient[x > 1]).max(initial=0) < 0.5  # the conditions of the least squares
    made = plan(counts, 64)
    tokens = sum(k * n for k, n in counts.items())
    assert made["sequences"] == -(-tokens // 64)
    assert plan({}, 64)["sequences"] == 0
