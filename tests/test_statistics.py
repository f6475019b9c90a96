from decimal import Decimal

import pytest

from granary.operators import statistics as S
from granary.plans.table_plan import PlanError

LEDGER = [("1", "2025-01-01", "Paid", "50.00", 0), ("2", "2025-01-02", "Paid", "20.00", 1), ("2", "2025-01-02", "Paid", "20.00", 2), ("3", "2025-01-03", "Open", "99.00", 3), ("4", "2025-02-03", "Paid", "7.00", 4), ("5", "2025-01-09", "Paid", "10.00", 5)]
FIELDS = ["ID", "Date", "Status", "Amount"]
PLAN = S.StatisticsPlan("SUM", "Amount", (S.RowFilter("Date", "LT", "2025-02-01", "DATE", "yyyy-MM-dd"), S.RowFilter("Status", "EQ", "Paid")), distinct_by="ID")


def frame(spark, rows):
    return spark.createDataFrame(rows, "ID string, Date string, Status string, Amount string, n int")


def run(spark, rows, plan, fields=FIELDS):
    c = S.classify(frame(spark, rows), plan, fields, ["n"])
    return {r.n: r.decision for r in c.collect()}, S.summary(c, plan).first(), S.totals(c, plan).collect()


def test_ledger(spark):
    decisions, summary, totals = run(spark, LEDGER, PLAN)
    assert decisions == {0: "SELECTED", 1: "SELECTED", 2: "DUPLICATE", 3: "EXCLUDED", 4: "EXCLUDED", 5: "SELECTED"}
    assert (summary.selected, summary.excluded, summary.duplicate, summary.invalid, summary.accepted) == (3, 2, 1, 0, True)
    assert totals[0].value == Decimal("80.00") and totals[0]["count"] == 3


def test_one_bad_row_voids_the_result(spark):
    rows = [*LEDGER, ("6", "2025-01-10", "Paid", "many", 6)]
    decisions, summary, totals = run(spark, rows, PLAN)
    assert decisions[6] == "INVALID" and not summary.accepted and totals == []


def test_unreadable_beats_excluded(spark):
    rows = [("1", "no date", "Open", "5", 0)]
    plan = S.StatisticsPlan("SUM", "Amount", (S.RowFilter("Status", "EQ", "Paid"), S.RowFilter("Date", "GE", "2025-01-01", "DATE", "yyyy-MM-dd")))
    assert run(spark, rows, plan)[0] == {0: "INVALID"}


def test_conflicts_and_blank_keys(spark):
    rows = [("1", "2025-01-01", "Paid", "5", 0), ("1", "2025-01-01", "Paid", "6", 1), ("", "2025-01-01", "Paid", "6", 2)]
    assert run(spark, rows, PLAN)[0] == {0: "SELECTED", 1: "INVALID", 2: "INVALID"}


def test_an_invalid_row_keeps_its_key(spark):
    rows = [("1", "2025-01-01", "Paid", "bad", 0), ("1", "2025-01-01", "Paid", "bad", 1)]
    assert run(spark, rows, PLAN)[0] == {0: "INVALID", 1: "DUPLICATE"}


def test_ragged_rows(spark):
    from pyspark.sql import functions as F

    c = S.classify(frame(spark, LEDGER[:1]), PLAN, FIELDS, ["n"], ragged=F.lit(True))
    assert c.first().decision == "INVALID"


def test_mixed_units(spark):
    rows = spark.createDataFrame([("1", "GBP", "£5", 0), ("2", "USD", "$6", 1)], "ID string, Currency string, Amount string, n int")
    fields = ["ID", "Currency", "Amount"]
    plan = S.StatisticsPlan("SUM", "Amount")
    c = S.classify(rows, plan, fields, ["n"])
    assert S.summary(c, plan).first().mixed and S.totals(c, plan).count() == 0
    by = S.StatisticsPlan("SUM", "Amount", group_by=("Currency",))
    c = S.classify(rows, by, fields, ["n"])
    assert {r.Currency: int(r.value) for r in S.totals(c, by).collect()} == {"GBP": 5, "USD": 6}
    declared = S.StatisticsPlan("SUM", "Amount", value_unit="GBP")
    assert {r.n: r.decision for r in S.classify(rows, declared, fields, ["n"]).collect()} == {0: "SELECTED", 1: "INVALID"}


def test_signed_amounts_need_a_unit(spark):
    rows = spark.createDataFrame([("£1,000.00", 0), ("-£20.00", 1), ("5", 2)], "Amount string, n int")
    bare, declared = S.StatisticsPlan("SUM", "Amount"), S.StatisticsPlan("SUM", "Amount", value_unit="GBP")
    assert S.totals(S.classify(rows, bare, ["Amount"], ["n"]), bare).count() == 0
    assert S.totals(S.classify(rows, declared, ["Amount"], ["n"]), declared).first().value == 985


@pytest.mark.parametrize(("operation", "value"), [("SUM", 0), ("COUNT", 0), ("AVG", None), ("MIN", None), ("MAX", None)])
def test_nothing_selected(spark, operation, value):
    plan = S.StatisticsPlan(operation, "Amount", (S.RowFilter("Status", "EQ", "none"),))
    assert run(spark, LEDGER, plan)[2][0].value == value
    grouped = S.StatisticsPlan(operation, "Amount", plan.filters, group_by=("Status",))
    assert run(spark, LEDGER, grouped)[2] == []


def test_distinct_count_of_raw_text(spark):
    plan = S.StatisticsPlan("DISTINCT_COUNT", "Status")
    assert run(spark, LEDGER, plan)[2][0].value == 2


def test_bad_plans():
    for plan in (S.StatisticsPlan("MEDIAN", "Amount"), S.StatisticsPlan("SUM", "No"), S.StatisticsPlan("SUM", "Amount", group_by=("ID", "ID")), S.StatisticsPlan("SUM", "Amount", value_unit="JPY"), S.StatisticsPlan("SUM", "Amount", (S.RowFilter("Date", "GE", "2025-1-1", "DATE", "yyyy-MM-dd"),)), S.StatisticsPlan("SUM", "Amount", (S.RowFilter("Amount", "CONTAINS", "5", "NUMBER"),)), S.StatisticsPlan("SUM", "Amount", (S.RowFilter("ID", "EQ", "1"),) * 13)):
        with pytest.raises(PlanError):
            plan.validate(FIELDS)
    with pytest.raises(PlanError):
        S.StatisticsPlan("COUNT").validate(["a", "a"])


def test_questions_that_need_a_plan(spark):
    df = spark.createDataFrame([("What is the total where Status = Paid?",), ("Who wrote this?",), ("统计满足条件的记录",)], "q string")
    assert [r[0] for r in df.select(S.needs_confirmed_plan(df.q)).collect()] == [True, False, True]
