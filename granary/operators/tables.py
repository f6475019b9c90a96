"""Table analytics: filter, deduplicate, group, aggregate, sort and limit by a validated plan, with an audit."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.functions import numbers as N
from granary.plans.table_plan import Aggregate, Filter, TablePlan, literal


def _is_number(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.NumericType)


def cell_value(df: DataFrame, name: str) -> Column:
    """The exact value of a cell: of numbers as they are, of text by the table grammar."""
    c = df[name]
    return c.cast(N.DECIMAL) if _is_number(df, name) else N.number(c.cast("string"))


def cell_blank(df: DataFrame, name: str) -> Column:
    c = df[name]
    return c.isNull() if not isinstance(df.schema[name].dataType, T.StringType) else N.blank(c)


def _text(df: DataFrame, name: str) -> Column:
    return F.coalesce(df[name].cast("string"), F.lit(""))


def condition(df: DataFrame, f: Filter) -> Column:
    """A filter as a Column. Comparisons of number columns stay on the column itself, so that they reach the scan; in text
    columns a cell that is no number is false."""
    match f.op:
        case "eq" if f.value and isinstance(df.schema[f.column].dataType, T.StringType):
            return df[f.column] == f.value  # on the column itself, so that it reaches the scan; a null cell is not taken
        case "contains" if f.value and isinstance(df.schema[f.column].dataType, T.StringType):
            return F.contains(df[f.column], F.lit(f.value))
        case "eq":
            return _text(df, f.column) == f.value
        case "ne":
            return _text(df, f.column) != f.value
        case "contains":
            return F.contains(_text(df, f.column), F.lit(f.value))
        case "empty":
            return cell_blank(df, f.column)
        case "notEmpty":
            return ~cell_blank(df, f.column)
    bound = literal(f.value)
    if _is_number(df, f.column):
        kind = df.schema[f.column].dataType
        left, right = df[f.column], F.lit(float(bound)) if isinstance(kind, T.FractionalType) else F.lit(bound)
    else:
        left, right = cell_value(df, f.column), F.lit(bound)
    test = {"gt": left > right, "gte": left >= right, "lt": left < right, "lte": left <= right}[f.op]
    return F.coalesce(test, F.lit(False)) if not _is_number(df, f.column) else test


def _aggregate(df: DataFrame, a: Aggregate) -> Column:
    if a.column == "*":
        return F.count(F.lit(1))
    if a.op == "count":
        return F.count_if(~cell_blank(df, a.column))
    x = cell_value(df, a.column)
    match a.op:
        case "sum":
            return F.sum(x).cast(N.DECIMAL)
        case "min":
            return F.min(x)
        case "max":
            return F.max(x)
        case "countNumeric":
            return F.count(x)
    return exact_average(x)


def exact_average(x: Column) -> Column:
    """sum / count, rounded once, half up, to ten places: by the average of values of six places where all of them have no
    more, which is exact to ten; else by the average's own fourteen places."""
    six = x.cast("decimal(20,6)")
    return F.when(F.bool_and((six == x) | x.isNull()), F.avg(six).cast(N.DECIMAL)).otherwise(F.round(F.avg(x), 10).cast(N.DECIMAL))


def selected(df: DataFrame, plan: TablePlan) -> DataFrame:
    """The rows that pass all filters; of equal ones one, if the plan says so."""
    rows = df.where(reduce(lambda a, b: a & b, [condition(df, f) for f in plan.filters])) if plan.filters else df
    return rows.dropDuplicates() if plan.deduplicate else rows


def _keys(rows: DataFrame, plan: TablePlan) -> list[Column]:
    keys = []
    for g in plan.groups:
        if g == plan.date_column:
            key = N.date_key(rows[g].cast("string"), plan.date_unit)
            key = F.when(key.isNull(), F.raise_error(F.concat(F.lit("no date to group by: "), F.coalesce(rows[g].cast("string"), F.lit(""))))).otherwise(key)
            keys.append(key.alias(g))
        else:
            keys.append(rows[g])
    return keys


def _unlimited(df: DataFrame, plan: TablePlan, order: str | None) -> DataFrame:
    plan.validate(df.columns)
    rows = selected(df, plan)
    if not plan.aggregations:
        return rows.select(*(list(plan.select) or df.columns), *([F.col(order).alias("_first")] if order else []))
    aggs = [_aggregate(rows, a).alias(a.name) for a in plan.aggregations]
    first = [F.min(order).alias("_first")] if order else []
    return rows.groupBy(*_keys(rows, plan)).agg(*aggs, *first) if plan.groups else rows.agg(*aggs, *first)


def sort_keys(df: DataFrame, name: str, descending: bool) -> list[Column]:
    """Numbers by value, then text by its code units; nulls last either way."""
    c = df[name]
    if _is_number(df, name):
        return [c.desc_nulls_last() if descending else c.asc_nulls_last()]
    value = N.number(c.cast("string"))
    keys = [value.isNull(), value, c]
    return [c.isNull(), *((k.desc() if descending else k.asc()) for k in keys)]


def analyze(df: DataFrame, plan: TablePlan | dict, order: str | None = None) -> DataFrame:
    """The plan's result. order: a column that tells the rows' places in the source; groups and ties then come in the order of
    their first row, else by their keys."""
    plan = plan if isinstance(plan, TablePlan) else TablePlan.of(plan)
    out = _unlimited(df, plan, order)
    names = [c for c in out.columns if c != "_first"]
    keys = sort_keys(out, plan.sort_by, plan.descending) if plan.sort_by else []
    ties = [F.col("_first")] if order else [F.col(c) for c in (plan.groups or ())]
    if keys or ties:
        out = out.orderBy(*keys, *ties)
    return (out if plan.limit is None else out.limit(plan.limit)).select(*names)


def audit(df: DataFrame, plan: TablePlan | dict) -> DataFrame:
    """One row: inputRows, filteredRows, removedDuplicates, resultRowsBeforeLimit, resultRows, and for each aggregation the
    cells it left out as empty, as no number, or as a number too long for the type."""
    plan = plan if isinstance(plan, TablePlan) else TablePlan.of(plan)
    plan.validate(df.columns)
    keep = reduce(lambda a, b: a & b, [condition(df, f) for f in plan.filters], F.lit(True))
    passed = df.where(keep)
    counts = df.agg(F.count(F.lit(1)).alias("inputRows"), F.count_if(keep).alias("_passed"))
    rows = selected(df, plan)
    cells = []
    for a in plan.aggregations:
        if a.column == "*":
            continue
        empty = cell_blank(rows, a.column)
        cells.append(F.count_if(empty).alias(f"empty_{a.name}"))
        if a.op != "count":
            cells.append(F.count_if(~empty & cell_value(rows, a.column).isNull()).alias(f"invalid_{a.name}"))
            if not _is_number(rows, a.column):
                cells.append(F.count_if(N.overflows(rows[a.column].cast("string"))).alias(f"overflow_{a.name}"))
    kept = rows.agg(F.count(F.lit(1)).alias("filteredRows"), *cells)
    result = _unlimited(df, plan, None).agg(F.count(F.lit(1)).alias("resultRowsBeforeLimit"))
    del passed
    return (
        counts.crossJoin(kept).crossJoin(result)  # one row each
        .withColumn("removedDuplicates", F.col("_passed") - F.col("filteredRows"))
        .withColumn("resultRows", F.least(F.col("resultRowsBeforeLimit"), F.lit(plan.limit).cast("long")))
        .drop("_passed")
    )


def profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """name, empty, numeric, nonNumeric, min and max of each column, in one pass over the rows."""
    names = columns or df.columns
    parts = [
        F.struct(
            F.lit(c).alias("name"), F.count_if(cell_blank(df, c)).alias("empty"), F.count(F.when(~cell_blank(df, c), cell_value(df, c))).alias("numeric"),
            F.count_if(~cell_blank(df, c) & cell_value(df, c).isNull()).alias("nonNumeric"), F.min(cell_value(df, c)).alias("min"), F.max(cell_value(df, c)).alias("max"),
        ) if _profilable(df, c) else F.struct(F.lit(c).alias("name"), F.count_if(df[c].isNull()).alias("empty"), F.lit(0).cast("long").alias("numeric"), F.count(df[c]).alias("nonNumeric"), F.lit(None).cast(N.DECIMAL).alias("min"), F.lit(None).cast(N.DECIMAL).alias("max"))
        for c in names
    ]
    return df.agg(F.array(*parts).alias("p")).select(F.explode("p").alias("p")).select("p.*")


def sample_rows(df: DataFrame, order: list[str], n: int = 5) -> DataFrame:
    """The first rows of a table in an order that leaves no ties, as a profile shows them beside its counts; tasks send n rows each."""
    return df.orderBy(*order).limit(n)


def _profilable(df: DataFrame, c: str) -> bool:
    return isinstance(df.schema[c].dataType, T.NumericType | T.StringType)


def chart_rows(result: DataFrame, label: str, value: str, most: int = 20) -> DataFrame:
    """rank, label and value of the first rows of a result, for a bar or line chart."""
    return result.limit(most).select(F.monotonically_increasing_id().alias("rank"), F.col(label).cast("string").alias("label"), F.col(value).cast("double").alias("value"))
