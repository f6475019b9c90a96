"""Numbers, dates and blanks in text cells, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Values of cells: 28 digits before and 10 after the point. What is a number but doesn't fit is told by overflows().
DECIMAL = "decimal(38,10)"
#: White space as the table grammar means it: with the ideographic space, without the non-breaking ones.
SPACE = r"\t-\r\x1c-\x20" + "".join(map(chr, [0x1680, *range(0x2000, 0x2007), 0x2008, 0x2009, 0x200A, 0x2028, 0x2029, 0x205F, 0x3000]))
_NUMBER = r"^[+-]?(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d{1,3})?$"
_THOUSANDS = r"^[+-]?\d{1,3}(,\d{3})+(\.\d+)?$"
_STRICT = r"^[+-]?(?:\d+|\d{1,3}(?:,\d{3})+)(?:\.\d+)?$"


def blank(c: Column) -> Column:
    return F.coalesce(c.rlike(f"^[{SPACE}]*$"), F.lit(True))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^[{SPACE}]+|[{SPACE}]+$", "")


def _let(c: Column, use) -> Column:
    """use(c) with c evaluated once, however often use names it: otherwise generated code would grow with every mention."""
    return F.transform(F.array(c), use)[0]


def _bare(c: Column) -> Column:
    return F.regexp_replace(strip(c), r"^[￥¥$]\s*", "")


def _plain(s: Column) -> Column:
    """A cell of the table grammar without its per cent sign and its thousands' commas."""
    s = F.regexp_replace(s, "%$", "")
    return F.when(s.rlike(_THOUSANDS), F.replace(s, F.lit(","), F.lit(""))).otherwise(s)


def number(c: Column) -> Column:
    """The value of a table cell, or null: a leading ￥ ¥ $, strict thousands, an exponent of up to three digits, a trailing
    per cent sign."""

    def value(s: Column) -> Column:
        parsed = _let(_plain(s), lambda p: F.when(p.rlike(_NUMBER), p.try_cast("decimal(38,12)")))
        return _let(parsed, lambda v: F.when(s.endswith("%"), (v * F.lit("0.01").cast("decimal(3,2)")).cast(DECIMAL)).otherwise(v.cast(DECIMAL)))

    return _let(_bare(c), value)


def overflows(c: Column) -> Column:
    """Whether a cell is a number by its grammar, but one that DECIMAL doesn't hold."""
    return F.coalesce(_plain(_bare(c)).rlike(_NUMBER), F.lit(False)) & number(c).isNull()


def strict_number(c: Column) -> Column:
    """The value of a cell of audited statistics, or null: parentheses for negatives, a sign before a currency sign, strict
    thousands; no per cent and no exponent."""

    def value(s: Column) -> Column:
        negative = s.startswith("(") & s.endswith(")")
        digits = F.regexp_replace(F.when(negative, F.regexp_replace(s, r"^\(|\)$", "")).otherwise(s), r"^([+-]?)[£$¥￥€]\s*", "$1")
        parsed = _let(digits, lambda d: F.when(d.rlike(_STRICT) & ~(negative & d.rlike(r"^[+-]")), F.replace(d, F.lit(","), F.lit("")).try_cast(DECIMAL)))
        return _let(parsed, lambda v: F.when(negative, -v).otherwise(v).cast(DECIMAL))

    return _let(strip(c), value)


def claim_number(c: Column) -> Column:
    """The value of a number in prose, or null: bold marks are dropped, parentheses must come in pairs."""
    s = F.replace(strip(c), F.lit("**"), F.lit(""))
    return F.when(s.startswith("(") == s.endswith(")"), strict_number(s))


def date_key(c: Column, unit: str) -> Column:
    """yyyy, yyyy-MM or yyyy-MM-dd of a cell by strict calendar dates in four spellings, or of yyyy-MM; null for others."""
    s = F.split(strip(c), "[T ]")[0]
    day = F.coalesce(
        F.when(s.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(s, "yyyy-MM-dd")),
        F.when(s.rlike(r"^\d{4}/\d{1,2}/\d{1,2}$"), F.try_to_date(s, "yyyy/M/d")),
        F.when(s.rlike(r"^\d{8}$"), F.try_to_date(s, "yyyyMMdd")),
    )
    month = F.when(strip(c).rlike(r"^\d{4}-(0[1-9]|1[0-2])$"), strip(c))
    out = {"day": "yyyy-MM-dd", "month": "yyyy-MM", "year": "yyyy"}[unit]
    return F.coalesce(F.date_format(day, out), F.substring(month, 1, 4) if unit == "year" else month)


#: The date formats that a statistics filter can declare, with their shapes.
FORMATS = {"yyyy-MM-dd": r"^\d{4}-\d{2}-\d{2}$", "dd/MM/yyyy": r"^\d{2}/\d{2}/\d{4}$", "dd-MMM-yy": r"^\d{2}-[A-Z][a-z]{2}-\d{2}$"}


def strict_date(c: Column, fmt: str) -> Column:
    return F.when(c.rlike(FORMATS[fmt]), F.try_to_date(c, fmt))


def unit_symbol(c: Column) -> Column:
    """What is left of a cell without digits, separators, signs and white space."""
    return F.regexp_replace(c, r"[0-9,.()\s+\-]", "")


def ranges(spec: str, last: int | None = None) -> list[int]:
    """Pages of `1-3,5`, ascending and once each."""
    found: set[int] = set()
    for part in spec.split(","):
        lo, _, hi = part.strip().partition("-")
        if not lo.isdigit() or (hi and not hi.isdigit()) or int(hi or lo) < int(lo) or int(lo) < 1:
            raise ValueError(f"not a range of pages: {part!r}")
        found.update(range(int(lo), int(hi or lo) + 1))
    if last is not None and found and max(found) > last:
        raise ValueError(f"there are {last} pages")
    return sorted(found)
