import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from cases import empty, rows, table

from granary.llm.suffix import SuffixFamily, all_segments, remove_repeats, repeat_digests, segments


def brute(data, length):
    raw = [(key, (text or "").encode()) for key, text in data]
    seen = Counter(b[i : i + length] for _, b in raw for i in range(len(b) - length + 1))
    out = []
    for key, b in raw:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        out.append((key, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted([(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()], key=str)


def test_cases(spark):
    want = brute([(r[0], r[1]) for r in rows()], 200)
    assert got(repeat_digests(table(spark), 200)) == want
    assert got(repeat_digests(table(spark), 200, batches=3)) == want
    assert repeat_digests(empty(spark), 200).collect() == []


@pytest.mark.parametrize("most_contents", [4096, 2])
def test_shared_passages_in_many_contexts(spark, most_contents):
    rnd = random.Random(11)
    passage = "".join(rnd.choice("abcd ") for _ in range(430))
    data = []
    for i in range(40):
        cut = rnd.randint(0, 200)
        body = passage[cut:] if i % 3 else passage[: 430 - cut]
        data.append((i, "".join(rnd.choice("abcd é") for _ in range(rnd.randint(0, 300))) + body + "".join(rnd.choice("abcd ") for _ in range(rnd.randint(0, 300)))))
    data.append((99, "ab" * 400))
    df = spark.createDataFrame(data, "doc_id long, text string")
    assert got(repeat_digests(df, 200, most_contents=most_contents)) == brute(data, 200)


def test_texts_are_cut_and_rows_stay(spark):
    before = table(spark)
    after = remove_repeats(before, 200)
    assert after.columns == before.columns and after.count() == before.count()
    kept = {r.doc_id: r.text for r in after.collect() if r.doc_id is not None}
    assert kept[0] is None and kept[1] == "" and kept[6] == "" and kept[13].startswith("head") and len(kept[13]) < 20


def test_long_texts_in_parts():
    rng = np.random.default_rng(1)
    data = rng.integers(97, 101, 30000).astype(np.uint8)
    offsets = np.array([0, 150, 150, 20000, 30000])
    starts = lambda s: {(int(r), int(p) + k, int(a)) for r, p, c, a, _ in zip(*s, strict=True) for k in range(int(c))}
    assert starts(segments(data, offsets, 200)) == starts(all_segments(data, offsets, 200, most=3000))


def test_family_levels_are_geometric_and_scan_finds_all():
    rnd = random.Random(4)
    pieces = ["".join(rnd.choice("ab") for _ in range(rnd.randint(8, 14))).encode() for _ in range(200)]
    family = SuffixFamily(8)
    for lo in range(0, 200, 7):
        family.add(pieces[lo : lo + 7])
        sizes = [len(level[0]) for level in family.levels]
        assert all(a > b for a, b in zip(sizes, sizes[1:], strict=False))
    seen = Counter(p[i : i + 8] for p in pieces for i in range(len(p) - 7))
    for k, p in enumerate(pieces):
        twice = [i for i in range(len(p) - 7) if seen[p[i : i + 8]] > 1]
        assert (int(family.low[k]), int(family.high[k])) == (twice[0], twice[-1]) if twice else family.high[k] == -1


def test_copies_of_a_text_are_dealt_out_once(spark, monkeypatch):
    rnd = random.Random(12)
    text = "".join(rnd.choice("abcd ") for _ in range(900))
    near = [text[:at] + "#" + text[at + 1 :] for at in (100, 330, 450, 700)]
    data = [(i, text) for i in range(60)] + [(100 + i, t) for i, t in enumerate(near)]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    dealt, deal = [], type(df).repartition

    def kept(self, *args):
        if args == ("anchor",):
            dealt.append((self.count(), self.select("anchor", "owner").distinct().count(), self.where("bytes is null").count()))
        return deal(self, *args)

    monkeypatch.setattr(type(df), "repartition", kept)
    assert got(repeat_digests(df, 200)) == brute(data, 200)
    assert all(n == distinct and not nulls for n, distinct, nulls in dealt) and sum(n for n, _, _ in dealt) > 0
