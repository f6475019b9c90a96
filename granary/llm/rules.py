"""Line-first quality rules: lines that fail are removed, documents that lose too much are rejected."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import SPACE_BYTES, Words, byte_set, covered, mix, pick, slices, utf8, windows

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOLS = re.compile(r"[#*$%&|<>]")
ENDS_WELL = re.compile(r"[.!?…。！？][\"'”’»)\]]*[\x20\x09-\x0D]*\Z")
SHOUTS = re.compile(r"[A-Z]")
LETTERS = re.compile(r"[A-Za-z]")
#: Phrases of notices and page furniture.
BOILERPLATE = re.compile(r"all rights reserved|licensed under|terms of (?:use|service)|privacy policy|cookie policy|use cookies|enable javascript|sign up|log in|subscribe to|click here|skip to content|share this", re.I)
NAVIGATION = re.compile(r"[|>»•]")
IS_WORD = byte_set(SPACE_BYTES)
RULES = ("punctuation", "navigation", "symbols", "shouting", "boilerplate")
#: A document is rejected if the lines that fail hold more than this share of its words' characters.
MOST_LOST = 0.5


def failed_rule(line: str, n_words: int) -> str | None:
    """The first rule that a line with words fails: too many separators (at least 3, and one for every 4 words), too many
    symbols (at least 3, and one for every 4 words), over 60 % capitals among at least 20 ASCII letters, a phrase of
    notices or page furniture, or no closing punctuation at its end."""
    if 4 * len(NAVIGATION.findall(line)) >= max(12, n_words):
        return "navigation"
    if 4 * len(SYMBOLS.findall(line)) >= max(12, n_words):
        return "symbols"
    letters = len(LETTERS.findall(line))
    if letters >= 20 and 10 * len(SHOUTS.findall(line)) > 6 * letters:
        return "shouting"
    if BOILERPLATE.search(line):
        return "boilerplate"
    return None if ENDS_WELL.search(line) else "punctuation"


def repeated_words(words: Words, n: int) -> np.ndarray:
    """Which words lie in a window of n that its text holds twice or more. Windows are found by hashes and compared word by word."""
    h = windows(words.hashes, n)
    at = np.flatnonzero(words.rows[: len(h)] == words.rows[n - 1 :]) if len(h) else np.zeros(0, np.int64)
    key = h[at] ^ mix(words.rows[at].astype(np.uint64) + np.uint64(1))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    a, b = at[order[:-1][same]], at[order[1:][same]]
    real = words.equal(a, n, words, b) & (words.rows[a] == words.rows[b])
    hit = covered(len(words.hashes), np.concatenate([a[real], b[real]]), n)
    for row in np.unique(words.rows[np.concatenate([a[~real], b[~real]])]).tolist():  # unlike windows of one hash: that text by its words
        hit[words.bounds[row] : words.bounds[row + 1]] = _repeated_exactly(words, row, n)
    return hit


def _repeated_exactly(words: Words, row: int, n: int) -> np.ndarray:
    own = [words.text(k) for k in range(words.bounds[row], words.bounds[row + 1])]
    places: dict[tuple, list[int]] = {}
    for k in range(len(own) - n + 1):
        places.setdefault(tuple(own[k : k + n]), []).append(k)
    return covered(len(own), np.array([k for p in places.values() if len(p) > 1 for k in p], np.int64), n)


def clean_lines(text: str) -> tuple[str, dict]:
    """The text without the lines that fail, and its counts."""
    seen, kept, dup, lost, total, fails = set(), [], 0, 0, 0, dict.fromkeys(RULES, 0)
    for line in text.split("\n"):
        words = WORD.findall(line)
        if not words:
            kept.append(line)
            continue
        dup += line in seen
        seen.add(line)
        n = sum(map(len, words))
        total += n
        if rule := failed_rule(line, len(words)):
            fails[rule] += 1
            lost += n
        else:
            kept.append(line)
    return "\n".join(kept), {"word_chars": total, "n_dup_lines": dup, "lost": lost, "fails": fails}


def line_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_lost: float = MOST_LOST, min_words: int = 20, most_repeated: int = 30, window: int = 8) -> DataFrame:
    """For each row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, lost_chars, failed
    lines by rule, kept, and cleaned (the text without the lines that fail).

    base_failed: fewer than min_words words, or more than most_repeated per cent of them in windows of `window` words that occur
    twice or more. kept: not base_failed and at most most_lost of the words' characters in failed lines. One pass over
    whole texts, no shuffle. Null text: no words, base_failed, cleaned null. Repeated rows each give a row.
    """
    docs = pick(docs, doc_id=id_col, text=text_col)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "lost_chars", *(f"lines_{r}" for r in RULES), "kept", "cleaned"]

    def judge(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                words = Words(*utf8(part.column(1)), IS_WORD)
                n_words = np.diff(words.bounds)
                repeat = np.bincount(words.rows[repeated_words(words, window)], minlength=part.num_rows)
                texts = part.column(1).to_pylist()
                done = [clean_lines(t or "") for t in texts]
                chars, dup, lost = (np.array([d[k] for _, d in done], np.int64) for k in ("word_chars", "n_dup_lines", "lost"))
                symbols = np.array([len(SYMBOLS.findall(t or "")) for t in texts], np.int64)
                base = (n_words < min_words) | (100 * repeat > most_repeated * n_words)
                kept = ~base & (lost <= most_lost * chars)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *map(pa.array, (n_words, chars, symbols, dup, repeat.astype(np.int64), base, lost)), *(pa.array(np.array([d["fails"][r] for _, d in done], np.int64)) for r in RULES), pa.array(kept), pa.array([None if t is None else c for t, (c, _) in zip(texts, done, strict=True)], pa.string())],
                    names=names,
                )

    kinds = {"doc_id": id_type, "base_failed": "boolean", "kept": "boolean", "cleaned": "string"}
    return docs.mapInArrow(judge, ", ".join(f"{c} {kinds.get(c, 'long')}" for c in names))
