"""Words whose structure makes sums of powers of any odd base collide modulo 2 ** 64: the Thue-Morse words of 1,024 letters."""

import numpy as np

from granary.llm import rules
from granary.llm.bpe import Encoder
from granary.llm.common import SPACE_BYTES, Runs, Words, byte_set
from granary.llm.minhash import near_duplicates
from granary.llm.queries import tokenizer_path

SWAP = str.maketrans("ab", "ba")
A = "a"
for _ in range(10):
    A += A.translate(SWAP)
B = A.translate(SWAP)


def words_of(text):
    raw = np.frombuffer(text.encode(), np.uint8)
    return Words(raw, np.array([0, len(raw)]), byte_set(SPACE_BYTES))


def test_unlike_words_have_unlike_hashes_and_are_compared():
    words = words_of(f"{A} {B} {A}")
    assert len(A) == 1024 and words.hashes[0] == words.hashes[2] != words.hashes[1]
    assert words.equal(np.array([0, 0]), 1, words, np.array([2, 1])).tolist() == [True, False]


def test_unlike_texts_are_not_linked(spark):
    rows = [(1, f"x {A} y"), (2, f"x {B} y"), (3, f"x {A} y")]
    got = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()}
    assert got == {1: 1, 2: 2, 3: 1}


def test_unlike_windows_are_no_repeats(monkeypatch):
    tail = " ".join("bcdefgh")
    words = words_of(f"{A} {tail} {B} {tail}")
    assert not rules.repeated_words(words, 8).any()
    again = words_of(f"{A} {tail} {A} {tail}")
    assert rules.repeated_words(again, 8).all()
    monkeypatch.setattr(rules, "windows", lambda codes, n: np.zeros(max(0, len(codes) - n + 1), np.uint64))  # every hash is the same
    assert not rules.repeated_words(words, 8).any() and rules.repeated_words(again, 8).all()


def test_ids_of_structured_words(monkeypatch):
    texts = [A, B, f"{A} {B}"]
    encoder = Encoder(tokenizer_path())
    want = [encoder.library.encode(t, add_special_tokens=False).ids for t in texts]
    split = lambda ids, bounds: [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    assert split(*encoder.encode(texts)) == want
    monkeypatch.setattr(Runs, "hashes", lambda self, starts, lengths: np.zeros(len(starts), np.uint64))  # every hash is the same
    assert split(*Encoder(tokenizer_path()).encode(texts)) == want


def test_encoder_that_forgets_gives_the_same_ids(monkeypatch):
    """Batches that overflow the number of kept pre-tokens, or their characters, between and within long texts."""
    import random

    from tokenizers import Tokenizer

    from granary.llm import bpe
    from granary.llm.queries import tokenizer_path

    library, rng = Tokenizer.from_file(tokenizer_path()), random.Random(5)
    word = lambda: "".join(rng.choices("abcdeéß漢1", k=rng.randint(1, 9)))
    batches = [[" ".join(word() for _ in range(rng.randint(0, 60))) for _ in range(5)] for _ in range(12)]
    batches[6].append(" ".join(word() for _ in range(900)))
    for cache, characters in ((40, 1 << 23), (1 << 19, 100), (1 << 19, 1 << 23)):
        monkeypatch.setattr(bpe, "CACHE_CHARACTERS", characters)
        encoder = bpe.Encoder(tokenizer_path(), cache)
        for batch in batches:
            ids, bounds = encoder.encode(batch, chunk=256, overlap=16)
            assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [library.encode(t, add_special_tokens=False).ids for t in batch]
