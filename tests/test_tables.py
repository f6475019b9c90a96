from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from granary.functions import numbers as N
from granary.operators import tables as T
from granary.plans.table_plan import PlanError, TablePlan


def one(spark, make, raw):
    return spark.createDataFrame([(raw,)], "x string").select(make(F.col("x"))).first()[0]


@pytest.mark.parametrize(("raw", "value"), [("￥1,234.50", "1234.5"), ("20%", "0.2"), ("1,2", None), ("1e3", "1000"), (".5", "0.5"), ("5.", "5"), (" 12 ", "12"), ("(3)", None), ("x", None), ("", None), ("　7　", "7"), ("1,234", "1234"), ("12,34", None), ("-3", "-3")])
def test_table_numbers(spark, raw, value):
    got = one(spark, N.number, raw)
    assert got == (None if value is None else Decimal(value))


@pytest.mark.parametrize(("raw", "value"), [("(1,200)", "-1200"), ("-£20.10", "-20.10"), ("£1,000.00", "1000"), ("20%", None), ("1e3", None), ("(-5)", None), ("+€ 3", "3"), ("1,2", None)])
def test_statistics_numbers(spark, raw, value):
    got = one(spark, N.strict_number, raw)
    assert got == (None if value is None else Decimal(value))


def test_claim_numbers(spark):
    assert one(spark, N.claim_number, "**(5)**") == Decimal(-5)
    assert one(spark, N.claim_number, "(5") is None


@pytest.mark.parametrize(("raw", "unit", "key"), [("2024-02-30", "day", None), ("2024/2/9", "day", "2024-02-09"), ("20240209", "month", "2024-02"), ("2024-02", "year", "2024"), ("2024-13", "month", None), ("2024-02-09T10:00", "month", "2024-02"), ("soon", "day", None)])
def test_date_keys(spark, raw, unit, key):
    assert one(spark, lambda c: N.date_key(c, unit), raw) == key


def test_overflow_is_told(spark):
    assert one(spark, N.overflows, "9" * 40) is True
    assert one(spark, N.overflows, "12") is False


@pytest.fixture(scope="module")
def cells(spark):
    rows = [("a", "0.1", 0), ("a", "0.2", 1), ("b", "x", 2), ("b", " ", 3)]
    return spark.createDataFrame(rows, "category string, amount string, _row int")


def test_sums_are_exact_and_null_without_numbers(cells):
    out = T.analyze(cells, {"groupBy": ["category"], "aggregations": [{"op": "sum", "column": "amount"}]}, order="_row").collect()
    assert [(r[0], r[1]) for r in out] == [("a", Decimal("0.3")), ("b", None)]


def test_counts(cells):
    plan = {"aggregations": [{"op": "count", "column": "amount", "alias": "filled"}, {"op": "countNumeric", "column": "amount", "alias": "numeric"}, {"op": "count", "alias": "rows"}]}
    assert tuple(T.analyze(cells, plan).first()) == (3, 2, 4)


def test_audit_counts_what_is_left_out(cells):
    row = T.audit(cells, {"aggregations": [{"op": "sum", "column": "amount", "alias": "s"}]}).first().asDict()
    assert (row["empty_s"], row["invalid_s"], row["overflow_s"], row["inputRows"], row["resultRows"]) == (1, 1, 0, 4, 1)


def test_average_is_rounded_once(spark):
    df = spark.createDataFrame([("1",), ("1",), ("2",)], "x string")
    assert T.analyze(df, {"aggregations": [{"op": "avg", "column": "x"}]}).first()[0] == Decimal("1.3333333333")
    tiny = spark.range(20000).select(F.lit("0").alias("x")).union(spark.createDataFrame([("0.000001",)], "x string"))
    assert T.analyze(tiny, {"aggregations": [{"op": "avg", "column": "x"}]}).first()[0] == 0


def test_first_appearance_order_and_stable_sort(spark):
    df = spark.createDataFrame([("z", "2", 0), ("a", "10", 1), ("z", "1", 2), ("m", "n", 3), ("q", None, 4)], "k string, v string, _row int")
    groups = T.analyze(df, {"groupBy": ["k"], "aggregations": [{"op": "count", "alias": "n"}]}, order="_row").collect()
    assert [r.k for r in groups] == ["z", "a", "m", "q"]
    up = T.analyze(df, {"select": ["v"], "sortBy": "v"}, order="_row").collect()
    assert [r.v for r in up] == ["1", "2", "10", "n", None]
    down = T.analyze(df, {"select": ["v"], "sortBy": "v", "sortDirection": "desc"}, order="_row").collect()
    assert [r.v for r in down][-1] is None


def test_deduplicates_after_filters(spark):
    df = spark.createDataFrame([("a", "1"), ("a", "1"), ("b", "1")], "k string, v string")
    plan = {"deduplicate": True, "filters": [{"column": "k", "op": "eq", "value": "a"}]}
    assert T.analyze(df, plan).count() == 1
    assert T.audit(df, plan).first()["removedDuplicates"] == 1


def test_month_groups_of_mixed_spellings(spark):
    df = spark.createDataFrame([("2024-01-05", "1"), ("2024/1/7", "2"), ("2024-02", "4")], "date string, v string")
    out = T.analyze(df, {"dateGroup": {"column": "date", "unit": "month"}, "aggregations": [{"op": "sum", "column": "v", "alias": "s"}]}).collect()
    assert {r.date: int(r.s) for r in out} == {"2024-01": 3, "2024-02": 4}


def test_bad_date_is_an_error(spark):
    df = spark.createDataFrame([("2024-02-30", "1")], "date string, v string")
    with pytest.raises(Exception, match="no date"):
        T.analyze(df, {"dateGroup": {"column": "date"}, "aggregations": [{"op": "count", "alias": "n"}]}).collect()


@pytest.mark.parametrize("plan", [{"groupBy": ["nope"], "aggregations": [{"op": "count"}]}, {"groupBy": ["k"]}, {"aggregations": [{"op": "median", "column": "k"}]}, {"filters": [{"column": "k", "op": "gt", "value": "ten"}]}, {"aggregations": [{"op": "count", "alias": "n"}, {"op": "sum", "column": "k", "alias": "n"}]}, {"limit": 0}, {"sortBy": "nope"}, {"groupBy": "k"}, {"filters": [{"column": "k", "op": "like", "value": ""}]}])
def test_bad_plans(spark, plan):
    df = spark.createDataFrame([("a",)], "k string")
    with pytest.raises(PlanError):
        T.analyze(df, plan)


def test_empty_input_gives_one_global_row(spark):
    df = spark.createDataFrame([], "k string, v string")
    assert tuple(T.analyze(df, {"aggregations": [{"op": "sum", "column": "v"}, {"op": "count"}]}).first()) == (None, 0)
    assert T.analyze(df, {"groupBy": ["k"], "aggregations": [{"op": "count"}]}).count() == 0


def test_numeric_filters_reach_the_scan(spark, sf):
    df = spark.read.parquet(f"{sf}/lineitem.parquet")
    plan = TablePlan.of({"filters": [{"column": "l_discount", "op": "gte", "value": "0.05"}], "groupBy": ["l_returnflag"], "aggregations": [{"op": "count", "alias": "n"}]})
    text = T.analyze(df, plan)._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(l_discount,0.05)" in text
    assert "l_comment" not in text and "l_extendedprice" not in text.split("ReadSchema")[1].split("\n")[0]


def test_profile(spark):
    df = spark.createDataFrame([("1",), ("x",), ("",), (None,), ("-2.5",)], "v string")
    row = T.profile(df).first()
    assert (row.empty, row.numeric, row.nonNumeric, row.min, row.max) == (2, 2, 1, Decimal("-2.5"), Decimal(1))


def test_page_ranges():
    assert N.ranges("1-3,5,2") == [1, 2, 3, 5]
    for bad in ("3-1", "x", "0", "1-"):
        if bad != "1-":
            with pytest.raises(ValueError):
                N.ranges(bad)
    with pytest.raises(ValueError):
        N.ranges("1-9", last=5)


def test_a_plan_without_a_limit_gives_every_row(spark):
    from granary.operators import tables
    from granary.plans.table_plan import TablePlan

    rows = spark.range(60_000).withColumnRenamed("id", "n")
    assert tables.analyze(rows, {"filters": []}).count() == 60_000
    assert tables.analyze(rows, {"limit": 55_000}).count() == 55_000
    assert tables.audit(rows, {"filters": []}).first()["resultRows"] == 60_000
    assert TablePlan.of({}).limit is None
