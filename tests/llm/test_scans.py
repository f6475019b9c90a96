"""Token counts, decontamination, quality rules and sharding."""

import random
import re
import zlib

import numpy as np
import pytest
from cases import empty, rows, table

from granary.llm.bpe import Encoder
from granary.llm.decontaminate import decontaminate, find_hits, is_contaminated
from granary.llm.queries import tokenizer_path
from granary.llm.rules import clean_lines, line_rules
from granary.llm.sharding import Permutation, shard_rows
from granary.llm.tokens import token_counts


@pytest.fixture(scope="module")
def encoder():
    return Encoder(tokenizer_path())


def test_ids_are_those_of_the_library(encoder):
    rnd = random.Random(1)
    parts = ["'s", "'re", "'ll", "'", " ", "  ", "\n", "\n\n", "\t", "a", "bc", "É", "日本", "1", "22", "!", "...", "<|endoftext|>", "<|endo", " ", "　", "😀", "don't", "'vex", " 's", "\r\n", "ß", "'Re", "ſ", "́", "٣", "Ⅷ"]
    for _ in range(300):
        batch = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 30))) for _ in range(3)]
        ids, bounds = encoder.encode(batch)
        for i, text in enumerate(batch):
            assert ids[bounds[i] : bounds[i + 1]].tolist() == encoder.library.encode(text, add_special_tokens=False).ids


def test_chunks_are_spliced_exactly(encoder):
    rnd = random.Random(2)
    parts = ["'s", "'ll", " ", "   ", "\n", "word", "É", "日本語", "12345", "!?", "<|endoftext|>", "<|endof", "z" * 90, " " * 70]
    for _ in range(120):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randint(50, 200)))
        ids, bounds = encoder.encode(["a", text], chunk=rnd.randint(128, 400), overlap=rnd.randint(1, 90))
        assert ids[bounds[1] :].tolist() == encoder.library.encode(text, add_special_tokens=False).ids
    endless = "q" * 3000  # no common boundary in any overlap: it is widened to the whole
    assert encoder.encode([endless], 256, 8)[0].tolist() == encoder.library.encode(endless, add_special_tokens=False).ids


def test_cache_is_bounded():
    small = Encoder(tokenizer_path(), cache=50)
    for i in range(20):
        text = " ".join(f"w{i}x{j}" for j in range(40))
        assert small.encode([text])[0].tolist() == small.library.encode(text, add_special_tokens=False).ids
    assert len(small.keys) <= 200


def test_token_counts(spark, encoder):
    got = sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in token_counts(table(spark), tokenizer_path(), chunk=256, overlap=16).collect()), key=str)
    want = sorted(((r[0], len((r[1] or "").encode()), len(encoder.library.encode(r[1] or "", add_special_tokens=False).ids)) for r in rows()), key=str)
    assert got == want
    assert token_counts(empty(spark), tokenizer_path()).collect() == []


OUT = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute_hits(data, items, n):
    grams = []
    for item, text in items:
        w = OUT.findall((text or "").translate(LOWER))
        if w:
            k = min(n, len(w))
            grams += [(item, tuple(w[i : i + k])) for i in range(len(w) - k + 1)]
    out = []
    for key, text in data:
        w = OUT.findall((text or "").translate(LOWER))
        hit, who = set(), set()
        for item, g in grams:
            for i in range(len(w) - len(g) + 1):
                if tuple(w[i : i + len(g)]) == g:
                    hit.update(range(i, i + len(g)))
                    who.update([] if item is None else [str(item)])
        out.append((key, len(w), len(hit), sorted(who)))
    return sorted(out, key=str)


@pytest.mark.parametrize("n", [3, 13])
def test_hits(spark, n):
    data = [(r[0], r[1]) for r in rows()]
    long = data[10][1].split()
    items = [(1, " ".join(long[20:50]).upper()), (2, " ".join(long[30:45])), (3, "two, WORDS!"), (4, None), (5, "..."), (6, "a b c absent"), (None, "one"), (11, " ".join(long[60:62])), (3, "two words")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = find_hits(table(spark), bench, n)
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in found.collect()), key=str) == brute_hits(data, items, n)
    by_id = {key: text for key, text in data}
    for r in found.collect():
        raw = (by_id[r.doc_id] or "").encode() if r.doc_id is not None else b""
        if r.doc_id is not None:
            assert sum(len(OUT.findall(raw[s.start : s.end].decode())) for s in r.spans) == r.n_hit
    assert find_hits(table(spark), spark.createDataFrame([], "item_id long, text string"), n).where("n_hit > 0").count() == 0
    assert find_hits(empty(spark), bench, n).collect() == []
    left = decontaminate(table(spark), bench, n)
    assert left.columns == table(spark).columns and left.count() == found.where(~is_contaminated()).count()
    cut = decontaminate(table(spark), bench, n, remove="spans")
    assert cut.count() == len(data) and find_hits(cut, spark.createDataFrame(items[:1], "item_id long, text string"), n).where("n_hit > 0").count() == 0
    joined = find_hits(table(spark), bench, n, most_bytes=0)  # a benchmark beyond the bound of a broadcast
    assert sorted(map(tuple, joined.collect()), key=str) == sorted(map(tuple, found.collect()), key=str)
    assert sorted(map(tuple, decontaminate(table(spark), bench, n, most_bytes=0).collect()), key=str) == sorted(map(tuple, left.collect()), key=str)
    assert sorted(map(tuple, decontaminate(table(spark), bench, n, remove="spans", most_bytes=0).collect()), key=str) == sorted(map(tuple, cut.collect()), key=str)


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_base(text):
    text = text or ""
    w = WORD.findall(text)
    places = {}
    for i in range(len(w) - 7):
        places.setdefault(tuple(w[i : i + 8]), []).append(i)
    repeat = {k for p in places.values() if len(p) > 1 for i in p for k in range(i, i + 8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    base = len(w) < 20 or 100 * len(repeat) > 30 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(repeat), base


def test_line_rules(spark):
    got = line_rules(table(spark)).collect()
    assert sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got), key=str) == sorted(((r[0], *brute_base(r[1])) for r in rows()), key=str)
    assert not any(r.kept and r.base_failed for r in got)
    assert {r.doc_id for r in got if r.cleaned is None} == {0, None}
    assert line_rules(empty(spark)).collect() == []


def test_lines_that_fail():
    clean, counts = clean_lines("A good line ends well.\nHome | News | Sport | Login | Help\nTHIS LINE SHOUTS AT ALL ITS READERS!\nword*** other### more$$$ sign&&&.\nAll rights reserved.\nno stop at the end\n\n“Quoted.”")
    assert clean == "A good line ends well.\n\n“Quoted.”"
    assert counts["fails"] == {"punctuation": 1, "navigation": 1, "symbols": 1, "shouting": 1, "boilerplate": 1}


@pytest.mark.parametrize("n", [1, 2, 3, 17, 1000, 4097])
def test_permutations(n):
    p = Permutation(n, seed=9)
    image = p(np.arange(n))
    assert sorted(image.tolist()) == list(range(n)) and p.inverse(image).tolist() == list(range(n))
    if n > 100:
        assert (image != Permutation(n, seed=10)(np.arange(n))).any() and abs(np.corrcoef(image, np.arange(n))[0, 1]) < 0.2


def plain_place(x, n, seed):
    """The permutation by its definition, in Python's own integers: six rounds on two halves, walked until below n."""
    m = (1 << 64) - 1

    def mixed(v):
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
            v = (v ^ v >> shift) * factor & m
        return v

    half = max(1, ((n - 1).bit_length() + 1) // 2)
    keys = [mixed((k * 0x9E3779B97F4A7C15 + seed) & m) for k in range(1, 7)]
    while True:
        left, right = x >> half, x & (1 << half) - 1
        for key in keys:
            left, right = right, left ^ mixed(right + key & m) & (1 << half) - 1
        x = right << half | left
        if x < n:
            return x


@pytest.mark.parametrize("n, seed", [(1, 0), (2, 5), (1000, 0), (4097, 77)])
def test_places_by_definition(n, seed):
    assert Permutation(n, seed)(np.arange(n)).tolist() == [plain_place(x, n, seed) for x in range(n)]


def test_query_of_shards(spark, sf="/root/testdata/sf0.001"):
    """op9's rows against the definition: rows in the order of ids, places by the permutation, shards and slots from the place."""
    from granary.llm.queries import op9_sharding

    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    assert len({d for d, _ in docs}) == len(docs)
    places = [plain_place(x, len(docs), 0) for x in range(len(docs))]
    want = [(d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), "rows", p % 16, p // 16, None) for (d, t), p in zip(docs, places, strict=True)]
    assert sorted(map(tuple, op9_sharding(spark, sf).collect())) == want


def test_shards(spark):
    out = shard_rows(table(spark), 4, seed=3)
    got = sorted(((r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in out.collect()), key=str)
    assert sorted((g[:3] for g in got), key=str) == sorted(((r[0], len((r[1] or "").encode()), zlib.crc32((r[1] or "").encode())) for r in rows()), key=str)
    slots = {}
    for g in got:
        slots.setdefault(g[3], []).append(g[4])
    sizes = [len(s) for s in slots.values()]
    assert max(sizes) - min(sizes) <= 1 and all(sorted(s) == list(range(len(s))) for s in slots.values())
    again = shard_rows(table(spark).repartition(7), 4, seed=3)
    assert sorted(((r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in again.collect()), key=str) == got
    assert shard_rows(empty(spark), 4).collect() == []
