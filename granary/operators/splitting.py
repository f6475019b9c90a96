"""Chunks by ever finer separators: paragraphs, lines, sentences, words; exact stretches of the text, with overlap carried by the start."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.operators.batches import portions, small_batches

#: Separators from coarse to fine.
SEPARATORS = ("\n\n", "\n", "。", "！", "？", ". ", "! ", "? ", " ")
_HEADING = re.compile(r"^#{1,6}\s", re.M)
_SOLID = re.compile(r"\S")


def _trimmed(text: str, start: int, end: int) -> tuple[int, int] | None:
    """The stretch without white space at its ends; None if nothing is left."""
    found = _SOLID.search(text, start, end)
    if not found:
        return None
    while text[end - 1].isspace():
        end -= 1
    return found.start(), end


def _parts(text: str, start: int, end: int, separator: str) -> Iterator[tuple[int, int]]:
    while start <= end:
        at = text.find(separator, start, end)
        at = end if at < 0 else at
        if part := _trimmed(text, start, at):
            yield part
        start = at + len(separator)


def pieces(text: str, start: int, end: int, size: int) -> Iterator[tuple[int, int]]:
    """Stretches of at most `size` characters, in order. What is longer is parted at the coarsest separator it has and packed again from its
    parts, as many in a row as fit; a part that is still too long waits on a stack for the next finer one, at last for slices of `size`."""
    waiting = [(start, end, 0)]
    while waiting:
        start, end, level = waiting.pop()
        if not (inner := _trimmed(text, start, end)):
            continue
        start, end = inner
        if end - start <= size:
            yield start, end
        elif level == len(SEPARATORS):
            yield from (s for a in range(start, end, size) if (s := _trimmed(text, a, min(a + size, end))))
        else:
            groups: list[tuple[int, int]] = []
            for a, b in _parts(text, start, end, SEPARATORS[level]):
                if groups and b - groups[-1][0] <= size:
                    groups[-1] = (groups[-1][0], b)
                else:
                    groups.append((a, b))
            waiting += [(a, b, level + 1) for a, b in reversed(groups)]


def recursive_spans(text: str | None, size: int = 500, overlap: int = 50) -> list[tuple[int, int]]:
    """(start, end) of the chunks. Headings begin a section; a piece under a quarter of `size` joins the one before it if both fit, also over a
    heading; then each chunk but the first begins up to `overlap` characters earlier, not before its predecessor. No text gives none."""
    if size < 1 or overlap < 0:
        raise ValueError("chunks have one character at least, and overlap no less than none")
    text = text or ""
    cuts = sorted({0, *(m.start() for m in _HEADING.finditer(text)), len(text)})
    found: list[tuple[int, int]] = []
    for a, b in zip(cuts, cuts[1:], strict=False):
        for start, end in pieces(text, a, b, size):
            if found and end - start < size // 4 and end - found[-1][0] <= size:
                found[-1] = (found[-1][0], end)
            else:
                found.append((start, end))
    return [(max(before, start - overlap), end) for before, (start, end) in zip([found[0][0], *(a for a, _ in found)], found, strict=False)] if found else []


def recursive_chunks(docs: DataFrame, size: int = 500, overlap: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ordinal (from 1), start, end and content of every document's chunks; no shuffle."""
    kind = docs.schema[id_col].dataType.simpleString()

    small_batches(docs.sparkSession)

    def cut(batches):
        for batch in batches:
            for part in portions(batch, 1):
                texts = part.column(1).to_pylist()
                rows = [(k, n, a, b, t[a:b]) for k, t in enumerate(texts) for n, (a, b) in enumerate(recursive_spans(t, size, overlap), 1)]
                of, ordinal, start, end, content = zip(*rows, strict=True) if rows else [()] * 5
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(of, pa.int64())), *(pa.array(c, pa.int32()) for c in (ordinal, start, end)), pa.array(content, pa.string())], names=["doc_id", "ordinal", "start", "end", "content"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(cut, f"doc_id {kind}, ordinal int, start int, end int, content string")
