"""Plans of table analytics, validated before any job starts."""

from __future__ import annotations

from dataclasses import dataclass, field
from decimal import Decimal, InvalidOperation

FILTERS = ("eq", "ne", "contains", "gt", "gte", "lt", "lte", "notEmpty", "empty")
AGGREGATES = ("sum", "avg", "min", "max", "count", "countNumeric")


class PlanError(ValueError):
    """A plan that cannot be carried out."""


@dataclass(frozen=True)
class Filter:
    column: str
    op: str
    value: str = ""


@dataclass(frozen=True)
class Aggregate:
    op: str
    column: str = "*"
    alias: str | None = None

    @property
    def name(self) -> str:
        return self.alias or f"{self.column}_{self.op}"


@dataclass(frozen=True)
class TablePlan:
    filters: tuple[Filter, ...] = ()
    deduplicate: bool = False
    group_by: tuple[str, ...] = ()
    date_column: str | None = None
    date_unit: str = "month"
    aggregations: tuple[Aggregate, ...] = ()
    select: tuple[str, ...] = ()
    sort_by: str | None = None
    descending: bool = False
    limit: int | None = None
    most_rows: int | None = field(default=None, repr=False)

    @classmethod
    def of(cls, plan: dict) -> TablePlan:
        """From the JSON form: filters, deduplicate, groupBy, dateGroup, aggregations, select, sortBy, sortDirection, limit."""
        for name in ("groupBy", "select"):
            if not isinstance(plan.get(name, []), list):
                raise PlanError(f"{name} is a list")
        date = plan.get("dateGroup") or {}
        return cls(
            filters=tuple(Filter(f["column"], f["op"], str(f.get("value", ""))) for f in plan.get("filters", [])),
            deduplicate=bool(plan.get("deduplicate", False)),
            group_by=tuple(plan.get("groupBy", [])),
            date_column=date.get("column") or None,
            date_unit=date.get("unit", "month"),
            aggregations=tuple(Aggregate(a["op"], a.get("column", "*"), a.get("alias")) for a in plan.get("aggregations", [])),
            select=tuple(plan.get("select", [])),
            sort_by=plan.get("sortBy") or None,
            descending=plan.get("sortDirection", "asc") == "desc",
            limit=None if plan.get("limit") is None else int(plan["limit"]),
        )

    @property
    def groups(self) -> tuple[str, ...]:
        """The group columns; the date's comes first unless it is among them."""
        return self.group_by if not self.date_column or self.date_column in self.group_by else (self.date_column, *self.group_by)

    @property
    def outputs(self) -> tuple[str, ...]:
        return (*self.groups, *(a.name for a in self.aggregations)) if self.aggregations else self.select

    def validate(self, columns: list[str]) -> None:
        known = set(columns)
        used = [f.column for f in self.filters] + list(self.groups) + [a.column for a in self.aggregations if a.column != "*"] + list(self.select)
        if missing := [c for c in used if c not in known]:
            raise PlanError(f"no such column: {missing[0]}")
        for f in self.filters:
            if f.op not in FILTERS:
                raise PlanError(f"no such filter: {f.op}")
            if f.op in ("gt", "gte", "lt", "lte"):
                literal(f.value)
        for a in self.aggregations:
            if a.op not in AGGREGATES or (a.column == "*" and a.op != "count"):
                raise PlanError(f"no such aggregation: {a.op} of {a.column}")
        if self.date_column and self.date_unit not in ("day", "month", "year"):
            raise PlanError(f"no such date unit: {self.date_unit}")
        if self.groups and not self.aggregations:
            raise PlanError("groups need an aggregation")
        if self.aggregations and len(set(self.outputs)) != len(self.outputs):
            raise PlanError("two output columns have one name")
        if self.sort_by and self.sort_by not in (self.outputs or columns):
            raise PlanError(f"no such column to sort by: {self.sort_by}")
        if self.limit is not None and (self.limit < 1 or (self.most_rows is not None and self.limit > self.most_rows)):
            raise PlanError("the limit is 1 or more" if self.most_rows is None else f"the limit is between 1 and {self.most_rows}")


def literal(raw: str) -> Decimal:
    """The value of a filter's number."""
    s = raw.strip().lstrip("￥¥$").replace(",", "")
    try:
        return Decimal(s[:-1]).scaleb(-2) if s.endswith("%") else Decimal(s)
    except InvalidOperation:
        raise PlanError(f"not a number: {raw!r}") from None
