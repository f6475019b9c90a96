"""Guardrails: first hit of ordered rules, masks, and hit logs; rules are data."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_hit(text: Column, keywords: list[str], patterns: list[str] = ()) -> Column:
    """(stage, rule) of the first keyword in list order that the text holds, else of the first pattern; null without a hit."""
    none = F.lit(None).cast("struct<stage:string,rule:string>")
    out = F.when(F.trim(F.coalesce(text, F.lit(""))) == "", none)
    for k in keywords:
        out = out.when(F.contains(text, F.lit(k)), F.struct(F.lit("KEYWORD").alias("stage"), F.lit(k).alias("rule")))
    for p in patterns:
        out = out.when(text.rlike(p), F.struct(F.lit("REGEX").alias("stage"), F.lit(p).alias("rule")))
    return out.otherwise(none)


def check(rows: DataFrame, text: str, keywords: list[str], patterns: list[str] = (), block: bool = True) -> DataFrame:
    """rows with stage, rule and action (BLOCK, or ALLOW where hits are only logged or there is none)."""
    hit = rows.withColumn("_hit", first_hit(F.col(text), keywords, patterns))
    return hit.select(*rows.columns, "_hit.stage", "_hit.rule", F.when(F.col("_hit").isNotNull() & F.lit(block), "BLOCK").otherwise("ALLOW").alias("action"))


def hit_log(checked: DataFrame, direction: str, *keys: str) -> DataFrame:
    return checked.where("rule is not null").select(*keys, F.lit(direction).alias("direction"), "stage", "rule", "action")


def mask_in_order(text: Column, keywords: list[str], mask: str = "***") -> Column:
    """Each keyword replaced in list order: later ones see what earlier ones left."""
    for k in keywords:
        text = F.replace(text, F.lit(k), F.lit(mask))
    return text


def mask_leftmost(text: Column, keywords: list[str], mask: str = "***") -> Column:
    """What the streaming masker gives for the whole text: from the left, the longest keyword at each place."""
    words = sorted({k for k in keywords if k}, key=len, reverse=True)
    if not words:
        return text
    return F.regexp_replace(text, "|".join(r"\Q" + k.replace(r"\E", r"\E\\E\Q") + r"\E" for k in words), mask.replace("\\", r"\\").replace("$", r"\$"))


class Masker:
    """Masks keywords in text that comes in parts: what may still become a keyword is held back, the longest keyword goes first,
    and finish() lets the rest go."""

    def __init__(self, keywords: list[str], mask: str = "***", pending: str = "") -> None:
        words = sorted({k for k in keywords if k}, key=len, reverse=True)
        self.mask, self.pending = mask, pending
        self.any = re.compile("|".join(map(re.escape, words))) if words else None
        self.heads = {k[:i] for k in words for i in range(1, len(k))}
        self.longest = max(map(len, words), default=0)

    def _drain(self, end: bool) -> str:
        out, at, text = [], 0, self.pending
        while at < len(text):
            if not end and len(text) - at < self.longest and text[at:] in self.heads:
                break
            hit = self.any.match(text, at) if self.any else None
            out.append(self.mask if hit else text[at])
            at = hit.end() if hit else at + 1
        self.pending = text[at:]
        return "".join(out)

    def append(self, token: str) -> str:
        self.pending += token
        return self._drain(False)

    def finish(self) -> str:
        return self._drain(True)
