"""Audited statistics: every row gets a decision, and one bad row voids the result."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions import numbers as N
from granary.operators.tables import exact_average
from granary.plans.table_plan import PlanError

OPERATIONS = ("SUM", "COUNT", "AVG", "MIN", "MAX", "DISTINCT_COUNT")
COMPARISONS = ("EQ", "NE", "GT", "GE", "LT", "LE", "CONTAINS")
#: The units that can be declared, and their signs.
UNITS = {"GBP": "£", "USD": "$", "CNY": "¥", "EUR": "€"}
_MONEY_COLUMN = re.compile(r".*currency.*|.*币种.*|.*货币.*", re.I)
_UNIT_COLUMN = re.compile(r".*currency.*|.*币种.*|.*货币.*|^unit$|^单位$", re.I)


@dataclass(frozen=True)
class RowFilter:
    field: str
    operator: str
    value: str
    type: str = "TEXT"
    date_format: str | None = None


@dataclass(frozen=True)
class StatisticsPlan:
    operation: str
    value_field: str | None = None
    filters: tuple[RowFilter, ...] = ()
    group_by: tuple[str, ...] = ()
    distinct_by: str | None = None
    value_unit: str = ""

    @property
    def numeric(self) -> bool:
        return self.operation not in ("COUNT", "DISTINCT_COUNT")

    def validate(self, fields: list[str]) -> None:
        if len(set(fields)) != len(fields) or any(not f.strip() for f in fields):
            raise PlanError("the headers are blank or not unique")
        if self.operation not in OPERATIONS:
            raise PlanError(f"no such operation: {self.operation}")
        if self.value_unit and self.value_unit not in UNITS:
            raise PlanError(f"no such unit: {self.value_unit}")
        need = [f.field for f in self.filters] + list(self.group_by) + ([self.distinct_by] if self.distinct_by else [])
        need += [self.value_field] if self.operation != "COUNT" else []
        if missing := [f for f in need if f not in fields]:
            raise PlanError(f"no such field: {missing[0]}")
        if len(self.filters) > 12:
            raise PlanError("there are more than 12 filters")
        if len(self.group_by) > 3 or len(set(self.group_by)) != len(self.group_by):
            raise PlanError("groups are up to 3 different fields")
        for f in self.filters:
            if f.operator not in COMPARISONS or len(f.value) > 500 or f.type not in ("TEXT", "NUMBER", "DATE"):
                raise PlanError(f"not a filter: {f}")
            if f.operator == "CONTAINS" and f.type != "TEXT":
                raise PlanError("CONTAINS is for text")
            if f.type == "NUMBER" and not re.fullmatch(r"\(?[+-]?[£$¥￥€]?\s*(\d+|\d{1,3}(,\d{3})+)(\.\d+)?\)?", f.value.strip()):
                raise PlanError(f"not a number: {f.value}")
            if f.type == "DATE" and (f.date_format not in N.FORMATS or not re.search(N.FORMATS[f.date_format], f.value)):
                raise PlanError(f"not a date of a known format: {f.value}")


def _compared(f: RowFilter, cell: Column) -> Column:
    """True, false, or null where the cell can't be read as the declared type."""
    if f.type == "NUMBER":
        left, right = N.strict_number(cell), N.strict_number(F.lit(f.value))
    elif f.type == "DATE":
        left, right = N.strict_date(cell, f.date_format), N.strict_date(F.lit(f.value), f.date_format)
    else:
        left, right = cell, F.lit(f.value)
    tests = {"EQ": left == right, "NE": left != right, "GT": left > right, "GE": left >= right, "LT": left < right, "LE": left <= right}
    return tests.get(f.operator, F.contains(left, right))


def classify(rows: DataFrame, plan: StatisticsPlan, fields: list[str], order: list[str], ragged: Column | None = None) -> DataFrame:
    """rows with decision (SELECTED, EXCLUDED, DUPLICATE or INVALID), reason, and _value and _unit of the selected ones.

    fields: the table's columns, as text. order: what tells the rows' places, for keep-first. ragged: rows whose number of
    cells isn't that of the header. All filters are looked at even after one excluded a row, so that a cell that can't be
    read is never hidden; only rows that pass them register their distinct_by key, and one that is found invalid later
    still holds it.
    """
    plan.validate(fields)
    df = rows.withColumns({f"_f{i}": _compared(f, F.col(f.field)) for i, f in enumerate(plan.filters)})
    tests = [F.col(f"_f{i}") for i in range(len(plan.filters))]
    ragged = F.lit(False) if ragged is None else F.coalesce(ragged, F.lit(False))
    unread = reduce(lambda a, b: a | b, [t.isNull() for t in tests], F.lit(False))
    passes = reduce(lambda a, b: a & b, [F.coalesce(t, F.lit(False)) for t in tests], F.lit(True))
    df = df.withColumn("_eligible", ~ragged & ~unread & passes)
    decision = F.when(ragged, "INVALID").when(unread, "INVALID").when(~passes, "EXCLUDED")
    reason = F.when(ragged, "the number of cells is not the header's")
    for f, t in reversed(list(zip(plan.filters, tests, strict=True))):  # the last unreadable one is told
        reason = reason.when(t.isNull(), f"cannot be read as {f.type}: {f.field}")
    for f, t in zip(plan.filters, tests, strict=True):
        reason = reason.when(~t, f"{f.field} {f.operator} {f.value}")
    if plan.distinct_by:
        key = F.col(plan.distinct_by)
        registers = F.col("_eligible") & ~N.blank(key)
        cells = F.array(*[F.col(c) for c in fields])
        window = Window.partitionBy(F.when(registers, key), F.when(~registers, F.monotonically_increasing_id())).orderBy(*order)
        # A row that registers nothing is a partition of its own, so that excluded rows don't gather under one key.
        df = df.withColumns({"_first": F.first(cells).over(window), "_nth": F.row_number().over(window)})
        again = registers & (F.col("_nth") > 1)
        same = F.col("_first") == cells
        decision = decision.when(N.blank(key), "INVALID").when(again & same, "DUPLICATE").when(again, "INVALID")
        reason = reason.when(N.blank(key), "the key is blank").when(again & same, "the same key and the same cells").when(again, F.concat(F.lit("other cells under the same key: "), key))
    if plan.operation != "COUNT":
        value = F.col(plan.value_field)
        df = df.withColumn("_number", N.strict_number(value)) if plan.numeric else df
        bad = F.col("_number").isNull() | _unit_conflict(plan, value, fields) if plan.numeric else N.blank(value)
        decision, reason = decision.when(bad, "INVALID"), reason.when(bad, f"no clear value: {plan.value_field}")
    df = df.withColumns({"decision": decision.otherwise("SELECTED"), "reason": reason.otherwise("all conditions hold")})
    chosen = F.col("decision") == "SELECTED"
    df = df.withColumn("_value", F.when(chosen, F.lit("1") if plan.operation == "COUNT" else F.col(plan.value_field)))
    df = df.withColumn("_unit", F.when(chosen, _unit(plan, fields)))
    return df.drop(*[f"_f{i}" for i in range(len(plan.filters))], "_eligible", "_first", "_nth", "_number")


def _unit_conflict(plan: StatisticsPlan, value: Column, fields: list[str]) -> Column:
    if not plan.value_unit:
        return F.lit(False)
    symbol, allowed = N.unit_symbol(value), ["", UNITS[plan.value_unit], *(["￥"] if plan.value_unit == "CNY" else [])]
    bad = ~symbol.isin(allowed)
    for c in fields:
        if _MONEY_COLUMN.fullmatch(c):
            bad = bad | (F.upper(F.col(c)).isin(list(UNITS)) & (F.upper(F.col(c)) != plan.value_unit))
    return bad


def _unit(plan: StatisticsPlan, fields: list[str]) -> Column:
    """What a value is counted in: its unit columns and, for numbers, its sign; a declared unit stands for a missing one."""
    parts = [F.concat(F.lit(f"{c}="), F.col(c), F.lit(";")) for c in fields if _UNIT_COLUMN.fullmatch(c)]
    if plan.numeric:
        symbol = N.unit_symbol(F.col(plan.value_field))
        if plan.value_unit:
            expected = UNITS[plan.value_unit]
            symbol = F.when(symbol.isin("", expected, *(["￥"] if plan.value_unit == "CNY" else [])), expected).otherwise(symbol)
        parts.append(symbol)
    return F.concat(*parts) if parts else F.lit("")


def _result(plan: StatisticsPlan) -> Column:
    x = N.strict_number(F.col("_value"))
    match plan.operation:
        case "COUNT":
            return F.count("_value").cast(N.DECIMAL)
        case "DISTINCT_COUNT":
            return F.count_distinct("_value").cast(N.DECIMAL)
        case "SUM":
            return F.sum(x).cast(N.DECIMAL)
        case "AVG":
            return exact_average(x)
        case "MIN":
            return F.min(x)
    return F.max(x)


def summary(classified: DataFrame, plan: StatisticsPlan, issues: bool = False) -> DataFrame:
    """One row: total, the count of each decision, mixed (a group has two units) and accepted."""
    of = lambda d: F.count_if(F.col("decision") == d)
    counts = classified.agg(F.count(F.lit(1)).alias("total"), of("SELECTED").alias("selected"), of("EXCLUDED").alias("excluded"), of("DUPLICATE").alias("duplicate"), of("INVALID").alias("invalid"))
    chosen = classified.where("decision = 'SELECTED'")
    units = chosen.groupBy(*plan.group_by).agg(F.min("_unit").alias("a"), F.max("_unit").alias("b")).agg(F.coalesce(F.bool_or(F.col("a") != F.col("b")), F.lit(False)).alias("mixed"))
    mixed = F.col("mixed") & F.lit(plan.numeric)
    return counts.crossJoin(units).withColumn("mixed", mixed).withColumn("accepted", (F.col("invalid") == 0) & ~F.col("mixed") & F.lit(not issues))


def totals(classified: DataFrame, plan: StatisticsPlan, issues: bool = False) -> DataFrame:
    """The groups with count and value; no rows at all unless the whole is accepted. Without groups there is one row, also of
    no selected rows: a sum of 0, a count of 0, other values null."""
    chosen = classified.where("decision = 'SELECTED'")
    aggs = [F.count(F.lit(1)).alias("count"), _result(plan).alias("value")]
    if plan.group_by:
        groups = chosen.groupBy(*plan.group_by).agg(*aggs)
    else:
        groups = chosen.agg(*aggs)
        groups = groups.withColumn("value", F.coalesce("value", F.lit(0).cast(N.DECIMAL))) if plan.operation == "SUM" else groups
    gate = summary(classified, plan, issues).where("accepted").select(F.lit(True).alias("_accepted"))
    return groups.crossJoin(F.broadcast(gate)).drop("_accepted")  # one row or none


def needs_confirmed_plan(question: Column) -> Column:
    """Whether a question asks for a filtered statistic. The words are fixed values."""
    asks = r"(?i)统计|合计|总额|多少|\bsum\b|\bcount\b|\btotal\b"
    filters = r"(?i)筛选|满足|Status\s*=|Currency\s*=|Type\s*=|已付款|202[0-9]年|\bwhere\b|\bfiltered?\b|\bpaid\b"
    return question.rlike(asks) & question.rlike(filters)
