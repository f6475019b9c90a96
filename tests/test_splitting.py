"""Recursive chunks against a plain recursion."""

import random

import pytest

from granary.operators import splitting as S


def plain(text, start, end, size, level=0):
    inner = text[start:end].strip()
    if not inner:
        return []
    start += len(text[start:end]) - len(text[start:end].lstrip())
    end = start + len(inner)
    if end - start <= size:
        return [(start, end)]
    if level == len(S.SEPARATORS):
        out = []
        for a in range(start, end, size):
            out += plain(text, a, min(a + size, end), size)
        return out
    groups, at = [], start
    for part in text[start:end].split(S.SEPARATORS[level]):
        a, b = at, at + len(part)
        at = b + len(S.SEPARATORS[level])
        if not part.strip():
            continue
        a, b = a + len(part) - len(part.lstrip()), b - (len(part) - len(part.rstrip()))
        if groups and b - groups[-1][0] <= size:
            groups[-1] = (groups[-1][0], b)
        else:
            groups.append((a, b))
    return [x for a, b in groups for x in plain(text, a, b, size, level + 1)]


@pytest.mark.parametrize("seed", range(3))
def test_pieces_equal_a_plain_recursion(seed):
    rnd = random.Random(seed)
    for _ in range(150):
        text = "".join(rnd.choice(["word ", "a. ", "日本。", "\n", "\n\n", "# H\n", "x" * 40, "！", " ", "? "]) for _ in range(rnd.randint(0, 120)))
        size = rnd.choice([1, 7, 20, 90])
        assert list(S.pieces(text, 0, len(text), size)) == plain(text, 0, len(text), size)
        spans = S.recursive_spans(text, size, 0)
        assert all(0 < b - a <= size and not text[a].isspace() and not text[b - 1].isspace() for a, b in spans) and all(a[1] <= b[0] for a, b in zip(spans, spans[1:], strict=False))
        covered = {i for a, b in spans for i in range(a, b)}
        assert all(i in covered or c.isspace() or c in "。！.?" for i, c in enumerate(text))
        lapped = S.recursive_spans(text, size, 5)
        assert [b for _, b in lapped] == [b for _, b in spans] and all(0 <= a[0] - b[0] <= 5 for a, b in zip(spans, lapped, strict=True))


def test_sections_merges_and_long_texts():
    text = "# One\n" + "a" * 30 + "\n# Two\nb\n# Three\n" + "c" * 60
    assert [text[a:b] for a, b in S.recursive_spans(text, 60, 0)] == ["# One\n" + "a" * 30 + "\n# Two\nb\n# Three", "c" * 60]
    assert S.recursive_spans(None) == [] == S.recursive_spans(" \n\n ") and len(S.recursive_spans("x" * 1_000_000, 500)) == 2000 and len(S.recursive_spans("ab. " * 200_000, 500)) == 1600


def test_table_of_chunks(spark):
    rows = [(1, "alpha beta. gamma"), (2, None), (3, ""), (None, "delta"), (1, "alpha beta. gamma")]
    got = S.recursive_chunks(spark.createDataFrame(rows, "doc_id long, text string"), size=11, overlap=0).collect()
    assert sorted(((r.doc_id, r.ordinal, r.content) for r in got), key=str) == sorted([(1, 1, "alpha beta"), (1, 2, "gamma")] * 2 + [(None, 1, "delta")], key=str)
