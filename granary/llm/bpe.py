"""Byte-level BPE ids of whole texts, with the tokenizers library encoding each distinct pre-token once.

The library splits a text into pre-tokens by character classes and merges bytes within each of them only. So the ids of
a text are those of its pre-tokens, and a batch needs the library only for pre-tokens that are not cached. The classes
of characters are asked of the library itself, one character at a time, and kept.

Texts longer than a chunk are encoded in overlapping chunks. Each chunk gives its pre-tokens with offsets; two chunks
are spliced at a place where both start a pre-token. Such a place is proven on the left if it lies MARGIN characters
before the end of the left chunk: the split looks at most one match ahead, and a special string there would be whole. It
is right on the right-hand side too, as what follows a pre-token's start does not depend on what was before it. Where an
overlap has no common place, it is made twice as wide, up to the whole left chunk.
"""

from __future__ import annotations

import json
import os
from functools import lru_cache

import numpy as np

from .common import Runs

MARGIN = 64
CHUNK = 1 << 16
OVERLAP = 1 << 9
#: Pre-tokens that are kept, and characters of them.
CACHE = 1 << 19
CACHE_CHARACTERS = 1 << 23
LETTER, NUMBER, WHITE, OTHER = 1, 2, 3, 4


def splits_as_assumed(description: dict) -> bool:
    """Whether a tokenizer file is one whose pre-tokens Encoder.split() gives: byte-level BPE with its own pattern, nothing done to
    texts before, and special strings that are cut out as they are."""
    split, model = description.get("pre_tokenizer") or {}, description.get("model") or {}
    plain = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
    plain &= not description.get("normalizer") and model.get("type", "BPE") == "BPE" and not model.get("dropout")
    return plain and not any(t.get(k) for t in description.get("added_tokens", ()) for k in ("lstrip", "rstrip", "single_word"))


class Growing:
    """An array that grows at its end, in place while there is room. What all() gave before stays as it was."""

    def __init__(self, kind: type, spare: int = 0) -> None:
        self.data, self.n, self.spare = np.zeros(1024, kind), 0, spare

    def add(self, more: np.ndarray) -> None:
        n = self.n + len(more)
        if n + self.spare > len(self.data):
            data = np.zeros(max(n + self.spare, len(self.data) * 3 // 2), self.data.dtype)
            data[: self.n] = self.all()
            self.data = data
        self.data[self.n : n] = more
        self.n = n

    def all(self) -> np.ndarray:
        return self.data[: self.n]


class Pieces:
    """Pre-tokens of one or more texts: rows, starts (characters within the row's text), and ids by CSR bounds."""

    def __init__(self, rows, starts, counts, first, pool) -> None:
        self.rows, self.starts, self.counts, self.first, self.pool = rows, starts, counts, first, pool

    def ids(self) -> np.ndarray:
        """All ids in order."""
        ends = np.cumsum(self.counts)
        n = int(ends[-1]) if len(ends) else 0
        shift = np.repeat(self.first - (ends - self.counts), self.counts)
        return self.pool[np.arange(n) + shift]


class Encoder:
    """Ids of texts as the library gives them. A file of another kind than splits_as_assumed() says goes to the library whole."""

    def __init__(self, path: str, cache: int = CACHE) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        if not path.endswith(".json"):
            raise ValueError("the tokenizer is a .json file of the tokenizers library; others are not handled")
        self.library, self.cache = Tokenizer.from_file(path), cache
        if hasattr(self.library.model, "_resize_cache"):
            self.library.model._resize_cache(0)  # each pre-token comes once; keeping them again costs a quarter of the time
        self.special = {t.content: i for i, t in self.library.get_added_tokens_decoder().items()}
        self.direct = not splits_as_assumed(json.loads(self.library.to_str())) or any(len(s) >= MARGIN for s in self.special)
        self.classes = np.zeros(0x110000, np.uint8)
        self.forget()
        if not self.direct:
            self.classify(np.arange(0x250))

    def forget(self) -> None:
        self.keys, self.slot = np.zeros(0, np.uint64), np.zeros(0, np.int32)  # sorted hashes, and where the rest of each is
        self.first, self.count, self.begin, self.size = (Growing(np.int64) for _ in range(4))
        self.pool, self.texts = Growing(np.uint32), Growing(np.uint32, spare=2)

    def classify(self, points: np.ndarray) -> None:
        split = self.library.pre_tokenizer.pre_tokenize_str
        for p in points[self.classes[points] == 0]:
            c = chr(p)
            self.classes[p] = LETTER if len(split("a" + c)) == 1 else NUMBER if len(split("1" + c)) == 1 else OTHER if len(split("!" + c)) == 1 else WHITE

    def split(self, points: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Starts of the pre-tokens of segments points[bounds[i]:bounds[i + 1]]."""
        n = len(points)
        if not n:
            return np.zeros(0, np.int64)
        kinds = self.classes[points]
        if not kinds.all():
            self.classify(np.unique(points[kinds == 0]))
            kinds = self.classes[points]
        edge = np.zeros(n + 1, bool)
        edge[bounds] = True
        run = edge[:-1].copy()
        run[1:] |= kinds[1:] != kinds[:-1]
        start = run.copy()
        ends_run = np.append(run[1:], True)  # the last character of its run
        white = kinds == WHITE
        # The last character of a run of white space that something follows: a token of its own, or taken by what follows.
        last = np.flatnonzero(white & ends_run & ~edge[1:])
        start[last] = True
        blank = last[points[last] == 32]
        start[blank + 1] = False
        # 's 't 're 've 'm 'll 'd after no blank
        at = np.flatnonzero((points == 39) & run & ends_run & ~edge[1:])
        at = at[start[at]]
        if len(at):
            a, b = points[at + 1], np.where((at + 2 < n) & ~edge[np.minimum(at + 2, n)], points[np.minimum(at + 2, n - 1)], 0)
            one = np.isin(a, [115, 116, 109, 100])
            two = ((a == 114) & (b == 101)) | ((a == 118) & (b == 101)) | ((a == 108) & (b == 108))
            start[at[one | two] + 1] = False
            for then in (at[one] + 2, at[two] + 3):
                start[then[then < n]] = True
        return np.flatnonzero(start)

    def _library_ids(self, text: str, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(counts, ids) of pre-tokens."""
        counts, ids = [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)]
        for at in range(0, len(starts), 1 << 13):  # the library's results take many times the room of their ids
            spans = zip(starts[at : at + (1 << 13)].tolist(), ends[at : at + (1 << 13)].tolist(), strict=True)
            part = [x.ids for x in self.library.encode_batch_fast([text[s:e] for s, e in spans], add_special_tokens=False)]
            counts.append(np.fromiter(map(len, part), np.int64, len(part)))
            ids.append(np.fromiter((i for x in part for i in x), np.uint32, int(counts[-1].sum())))
        return np.concatenate(counts), np.concatenate(ids)

    def lookup(self, text: str, points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(counts, first places in the pool, pool) of the pre-tokens' ids. What the cache holds under a hash counts only if its
        characters are the pre-token's; others, if there ever are any, go to the library."""
        runs, sizes = Runs(points), ends - starts
        keys = runs.hashes(starts, sizes)
        distinct, where, back = np.unique(keys, return_index=True, return_inverse=True)
        place = np.searchsorted(self.keys, distinct)
        new, inside = np.ones(len(distinct), bool), place < len(self.keys)
        new[inside] = self.keys[place[inside]] != distinct[inside]
        if new.any():
            if len(self.keys) and (len(self.keys) + new.sum() > self.cache or self.texts.n + sizes[where[new]].sum() > CACHE_CHARACTERS):
                self.forget()
                new[:], place[:] = True, 0
            at = where[new]
            counts, ids = self._library_ids(text, starts[at], ends[at])
            self.slot = np.insert(self.slot, place[new], self.size.n + np.arange(len(at), dtype=np.int32))
            self.keys = np.insert(self.keys, place[new], distinct[new])
            begin = np.cumsum(sizes[at]) - sizes[at]
            for kept, more in ((self.first, self.pool.n + np.cumsum(counts) - counts), (self.count, counts), (self.begin, self.texts.n + begin), (self.size, sizes[at])):
                kept.add(more)
            self.pool.add(ids)
            shift = np.repeat(starts[at] - begin, sizes[at])
            self.texts.add(points[np.arange(len(shift)) + shift])
        at = self.slot[np.searchsorted(self.keys, distinct)][back]
        counts, first, pool = self.count.all()[at], self.first.all()[at], self.pool.all()
        known = Runs.over(self.texts.data, self.texts.n)
        other = np.flatnonzero(~runs.equal(starts, sizes, known, self.begin.all()[at], self.size.all()[at]))
        if len(other):
            own, ids = self._library_ids(text, starts[other], ends[other])
            counts[other], first[other] = own, len(pool) + np.cumsum(own) - own
            pool = np.concatenate([pool, ids])
        return counts, first, pool

    def plain(self, texts: list[str]) -> Pieces:
        """Texts in one go."""
        rows_of, segments, odd = [], [], []
        for row, text in enumerate(texts):
            if any(s in text for s in self.special):
                odd.append(row)
            else:
                rows_of.append(row)
                segments.append(text)
        joined = "".join(segments)
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        bounds = np.zeros(len(segments) + 1, np.int64)
        np.cumsum(np.fromiter(map(len, segments), np.int64, len(segments)), out=bounds[1:])
        starts = self.split(points, bounds)
        counts, first, pool = self.lookup(joined, points, starts, np.append(starts[1:], len(points))) if len(starts) else (starts, starts, self.pool.all())
        seg = np.searchsorted(bounds, starts, "right") - 1
        rows = np.asarray(rows_of, np.int64)[seg] if len(starts) else starts
        made = Pieces(rows, starts - bounds[seg], counts, first, pool)
        if not odd:
            return made
        parts = [made]
        for row in odd:  # rare: the library itself cuts at special strings and merges nothing across them
            spot = self.special_starts(texts[row])
            starts = self.odd_starts(texts[row], spot)
            counts, first, pool = self.odd_ids(texts[row], starts, spot)
            parts.append(Pieces(np.full(len(starts), row), starts, counts, first, pool))
        base, pools, firsts = 0, [], []
        for p in parts:
            firsts.append(p.first + base)
            pools.append(p.pool)
            base += len(p.pool)
        rows = np.concatenate([p.rows for p in parts])
        order = np.argsort(rows, kind="stable")
        return Pieces(rows[order], *(np.concatenate([getattr(p, k) for p in parts])[order] for k in ("starts", "counts")), np.concatenate(firsts)[order], np.concatenate(pools))

    def special_starts(self, text: str) -> dict[int, str]:
        """Leftmost occurrences that do not overlap."""
        found, at = {}, 0
        while True:
            here = [(i, -len(s), s) for s in self.special if (i := text.find(s, at)) >= 0]
            if not here:
                return found
            i, _, s = min(here)
            found[i], at = s, i + len(s)

    def odd_starts(self, text: str, spot: dict[int, str]) -> np.ndarray:
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        starts, at = [], 0
        for i, s in [*spot.items(), (len(text), "")]:
            starts += [self.split(points[at:i], np.array([0, i - at])) + at] if i > at else []
            starts += [np.array([i])] if s else []
            at = i + len(s)
        return np.concatenate(starts) if starts else np.zeros(0, np.int64)

    def odd_ids(self, text: str, starts: np.ndarray, spot: dict[int, str]):
        ends = [*starts[1:].tolist(), len(text)]
        ids = [[self.special[spot[s]]] if s in spot else self.library.encode(text[s:e], add_special_tokens=False).ids for s, e in zip(starts.tolist(), ends, strict=True)]
        counts = np.fromiter(map(len, ids), np.int64, len(ids))
        return counts, np.cumsum(counts) - counts, np.fromiter((i for x in ids for i in x), np.uint32, int(counts.sum()))

    def long(self, text: str, chunk: int, overlap: int):
        """(counts and ids) of a long text, chunk by chunk."""
        at, end, left = 0, min(len(text), chunk), None
        left = self.plain([text[:end]])
        base = 0
        while end < len(text):
            wide = overlap
            nxt = min(len(text), end + chunk)
            while True:
                begin = max(base, end - wide)
                right = self.plain([text[begin:nxt]])
                proven = left.starts[left.starts + base <= end - MARGIN] + base
                common = np.intersect1d(proven[proven >= begin], right.starts + begin, assume_unique=True)
                if len(common):
                    break
                if begin == base:  # right holds all of left
                    common = np.array([base])
                    break
                wide *= 2
            cut = int(common[-1])
            yield self.ids_between(left, base, at, cut)
            left, base, at, end = right, begin, cut, nxt
        yield self.ids_between(left, base, at, len(text))

    @staticmethod
    def ids_between(pieces: Pieces, base: int, lo: int, hi: int) -> np.ndarray:
        keep = (pieces.starts + base >= lo) & (pieces.starts + base < hi)
        return Pieces(None, None, pieces.counts[keep], pieces.first[keep], pieces.pool).ids()

    def encode(self, texts: list[str], chunk: int = CHUNK, overlap: int = OVERLAP) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and the bounds of each text in them."""
        if chunk < 2 * MARGIN or overlap < 1:
            raise ValueError("a chunk holds two margins at least, an overlap one character")
        if self.direct:
            got = [np.array(x.ids, np.uint32) for x in self.library.encode_batch(texts, add_special_tokens=False)]
            return np.concatenate([np.zeros(0, np.uint32), *got]), np.append(0, np.cumsum([len(x) for x in got])).astype(np.int64)
        short = [t if len(t) <= chunk else "" for t in texts]
        pieces = self.plain(short)
        counts = np.bincount(pieces.rows, pieces.counts, len(texts)).astype(np.int64) if len(texts) else np.zeros(0, np.int64)
        ids = pieces.ids()
        large = [i for i, t in enumerate(texts) if len(t) > chunk]
        if large:
            bounds = np.append(0, np.cumsum(counts))
            parts, done = [], 0
            for i in large:
                parts.append(ids[bounds[done] : bounds[i]])
                got = list(self.long(texts[i], chunk, overlap))
                counts[i] = sum(map(len, got))
                parts += got
                done = i
            ids = np.concatenate([*parts, ids[bounds[done] :]])
        return ids, np.append(0, np.cumsum(counts))


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder in each Python worker."""
    return Encoder(path)
