"""The Merkle manifest against a plain tree built in memory."""

import hashlib
import zlib

import pytest
from cases import SCHEMA, empty, rows, table
from pyspark.sql import functions as F

from granary.llm.merkle import manifest

COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(level):
    """The levels of a tree, leaves first."""
    levels = [level]
    while len(levels[-1]) > 1:
        now = levels[-1]
        levels.append([sha("".join(now[i : i + 16])) for i in range(0, len(now), 16)])
    return levels


def climb(levels, index, mine):
    siblings = []
    for now in levels[:-1]:
        start = index // 16 * 16
        run = now[start : start + 16]
        before, after = run[: index - start], run[index - start + 1 :]
        siblings += before + after
        mine, index = sha("".join([*before, mine, *after])), index // 16
    return siblings, mine


def brute(data):
    groups = {}
    for r in data:
        groups.setdefault(r[3], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = []
    for g in order:
        made = sorted(((r[0] is not None, r[0] or 0, leaf([r[0], r[3], r[2], r[4], r[1]])), r) for r in groups[g])
        trees.append((made, tree([m[0][2] for m in made])))
    top = tree([levels[-1][0] for _, levels in trees])
    out = []
    for at, (made, levels) in enumerate(trees):
        for i, ((_, _, mine), r) in enumerate(made):
            other = mine
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[1] is not None:
                other = leaf([r[0], r[3], r[2], r[4], "".join(c.lower() if "A" <= c <= "Z" else c for c in r[1])])
            below, ends = climb(levels, i, other)
            above, ends = climb(top, at, ends)
            out.append((r[0], mine, levels[-1][0], top[-1][0], sha("".join(below + above)), ends, ends == top[-1][0]))
    return sorted(out, key=str)


def got(df, **how):
    lowered = {"text": F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")}
    made = manifest(df, COLUMNS, claimed=lowered, when=F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, **how)
    return sorted(((r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in made.collect()), key=str)


def test_cases(spark):
    assert got(table(spark)) == brute(rows())
    assert got(empty(spark)) == []
    one = [rows()[3]]
    assert got(spark.createDataFrame(one, SCHEMA)) == brute(one)


@pytest.mark.parametrize("part_rows, fan", [(40, 2), (257, 3)])
def test_hot_group_over_many_partitions(spark, part_rows, fan):
    """One group of a third of all rows, groups of every small size, and the rows of a group in several partitions."""
    data = [(i, f"Text {i % 7}", None, "hot", i, 0.0, True, 0, 0, "x") for i in range(700)]
    data += [(i, f"T{i}", "en", f"s{i % 90 if i % 2 else i}", None, 0.0, True, 0, 0, "x") for i in range(700, 2100)]
    data += [(5, "Same", "en", None, 1, 0.0, True, 0, 0, "x")] * 20
    want = brute(data)
    assert any(not w[-1] for w in want) and got(spark.createDataFrame(data, SCHEMA).repartition(5), part_rows=part_rows, fan=fan) == want
