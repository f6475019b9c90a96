"""Table analytics and audited statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.catalog import Catalog, table
from granary.functions import numbers as N
from granary.operators import statistics as S
from granary.operators import tables as T

QUERIES = Catalog()
_D = "decimal(38,10)"


def _dec(df: DataFrame, *names: str) -> DataFrame:
    """Exact values as text of ten places, which SQL engines agree on."""
    return df.withColumns({n: F.col(n).cast(_D).cast("string") for n in names})


def _text_orders(spark: SparkSession, sf: str) -> DataFrame:
    """orders as cells of text in several spellings; every 40th amount is no number, every 41st blank."""
    o = table(spark, sf, "orders")
    cents = F.col("o_totalprice").cast("decimal(18,2)").cast("string")
    k = F.col("o_orderkey")
    amount = F.when(k % 40 == 0, "n/a").when(k % 41 == 0, " ").when(k % 7 == 0, F.concat(F.lit("$ "), cents)).when(k % 11 == 0, F.concat(cents, F.lit("%"))).otherwise(cents)
    return o.select(k.cast("string").alias("id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), amount.alias("amount"), k.alias("_row"))


_TEXT_ORDERS = """WITH t AS (SELECT o_orderkey AS k, CAST(o_orderkey AS VARCHAR) AS id, strftime(o_orderdate, '%Y-%m-%d') AS date, o_orderstatus AS status, o_orderpriority AS priority,
  CASE WHEN o_orderkey % 40 = 0 OR o_orderkey % 41 = 0 THEN NULL WHEN o_orderkey % 7 = 0 THEN CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DECIMAL(38,10))
       WHEN o_orderkey % 11 = 0 THEN CAST(CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DECIMAL(28,4)) * CAST(0.01 AS DECIMAL(3,2)) AS DECIMAL(38,10)) ELSE CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DECIMAL(38,10)) END AS v,
  CASE WHEN o_orderkey % 40 = 0 THEN FALSE ELSE o_orderkey % 41 = 0 END AS blank FROM orders) """


@QUERIES.add("""SELECT l_returnflag, CAST(CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DECIMAL(38,10)) AS VARCHAR) AS total, CAST(CAST(SUM(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) / COUNT(*) AS DECIMAL(18,6))::VARCHAR AS mean_quantity, COUNT(*) AS n
FROM lineitem WHERE l_discount >= 0.05 GROUP BY l_returnflag ORDER BY SUM(CAST(l_extendedprice AS DECIMAL(18,2))) DESC LIMIT 10""")
def table_group_sum_avg_count(spark: SparkSession, sf: str) -> DataFrame:
    plan = {"filters": [{"column": "l_discount", "op": "gte", "value": "0.05"}], "groupBy": ["l_returnflag"], "aggregations": [{"op": "sum", "column": "l_extendedprice", "alias": "total"}, {"op": "avg", "column": "l_quantity", "alias": "mean_quantity"}, {"op": "count", "alias": "n"}], "sortBy": "total", "sortDirection": "desc", "limit": 10}
    out = T.analyze(table(spark, sf, "lineitem"), plan)
    return out.select("l_returnflag", F.col("total").cast("string").alias("total"), F.col("mean_quantity").cast("decimal(18,6)").cast("string").alias("mean_quantity"), "n")


@QUERIES.add("""SELECT l_returnflag, l_linestatus, CAST(CAST(SUM(CAST(l_quantity AS DECIMAL(18,2))) AS DECIMAL(38,10)) AS VARCHAR) AS sum_qty, CAST(CAST(MIN(CAST(l_extendedprice AS DECIMAL(18,2))) AS DECIMAL(38,10)) AS VARCHAR) AS lo, CAST(CAST(MAX(CAST(l_extendedprice AS DECIMAL(18,2))) AS DECIMAL(38,10)) AS VARCHAR) AS hi, COUNT(*) AS n
FROM lineitem GROUP BY ALL""")
def table_group_two_keys(spark: SparkSession, sf: str) -> DataFrame:
    plan = {"groupBy": ["l_returnflag", "l_linestatus"], "aggregations": [{"op": "sum", "column": "l_quantity", "alias": "sum_qty"}, {"op": "min", "column": "l_extendedprice", "alias": "lo"}, {"op": "max", "column": "l_extendedprice", "alias": "hi"}, {"op": "count", "alias": "n"}]}
    return _dec(T.analyze(table(spark, sf, "lineitem"), plan), "sum_qty", "lo", "hi")


@QUERIES.add("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderstatus = 'O' AND contains(o_orderpriority, 'URGENT') AND o_totalprice > 100000 AND o_totalprice <= 250000")
def table_filter_ops(spark: SparkSession, sf: str) -> DataFrame:
    filters = [("o_orderstatus", "eq", "O"), ("o_orderpriority", "contains", "URGENT"), ("o_totalprice", "gt", "100,000"), ("o_totalprice", "lte", "250000")]
    plan = {"filters": [dict(zip(("column", "op", "value"), f, strict=True)) for f in filters], "select": ["o_orderkey", "o_orderpriority"]}
    return T.analyze(table(spark, sf, "orders"), plan)


@QUERIES.add(_TEXT_ORDERS + "SELECT status, CAST(SUM(v) AS VARCHAR) AS total, COUNT(*) FILTER (NOT blank) AS filled, COUNT(v) AS numeric, COUNT(*) AS rows FROM (SELECT * REPLACE (CAST(v AS DECIMAL(38,10)) AS v) FROM t) WHERE v > 1000 OR v IS NULL GROUP BY status")
def table_text_cells(spark: SparkSession, sf: str) -> DataFrame:
    t = _text_orders(spark, sf)
    kept = t.where((N.number(F.col("amount")) > 1000) | N.number(F.col("amount")).isNull())
    plan = {"groupBy": ["status"], "aggregations": [{"op": "sum", "column": "amount", "alias": "total"}, {"op": "count", "column": "amount", "alias": "filled"}, {"op": "countNumeric", "column": "amount", "alias": "numeric"}, {"op": "count", "alias": "rows"}]}
    return _dec(T.analyze(kept, plan), "total")


@QUERIES.add(_TEXT_ORDERS + "SELECT substr(date, 1, 7) AS date, priority, COUNT(*) AS n FROM t GROUP BY ALL")
def table_date_group_month(spark: SparkSession, sf: str) -> DataFrame:
    return T.analyze(_text_orders(spark, sf), {"groupBy": ["priority"], "dateGroup": {"column": "date", "unit": "month"}, "aggregations": [{"op": "count", "alias": "n"}]}).select("date", "priority", "n")


@QUERIES.add(_TEXT_ORDERS + "SELECT substr(date, 1, 4) AS date, COUNT(*) AS n FROM t WHERE date >= '1995' GROUP BY ALL")
def table_date_group_year(spark: SparkSession, sf: str) -> DataFrame:
    rows = _text_orders(spark, sf).where("date >= '1995'")
    return T.analyze(rows, {"dateGroup": {"column": "date", "unit": "year"}, "aggregations": [{"op": "count", "alias": "n"}]})


@QUERIES.add(_TEXT_ORDERS + """SELECT COUNT(*) AS "inputRows", COUNT(*) AS "filteredRows", COUNT(*) FILTER (blank) AS empty_total, COUNT(*) FILTER (NOT blank AND v IS NULL) AS invalid_total, CAST(0 AS BIGINT) AS overflow_total, CAST(1 AS BIGINT) AS "resultRowsBeforeLimit", CAST(0 AS BIGINT) AS "removedDuplicates", CAST(1 AS BIGINT) AS "resultRows" FROM t""")
def table_audit(spark: SparkSession, sf: str) -> DataFrame:
    out = T.audit(_text_orders(spark, sf), {"aggregations": [{"op": "sum", "column": "amount", "alias": "total"}]})
    return out.select(*[F.col(c).cast("long").alias(c) for c in out.columns])


@QUERIES.add("""SELECT name, empty, numeric, "nonNumeric", CAST(CAST(lo AS DECIMAL(38,10)) AS VARCHAR) AS min, CAST(CAST(hi AS DECIMAL(38,10)) AS VARCHAR) AS max FROM (
SELECT 'o_orderkey' AS name, COUNT(*) FILTER (o_orderkey IS NULL) AS empty, COUNT(o_orderkey) AS numeric, CAST(0 AS BIGINT) AS "nonNumeric", CAST(MIN(o_orderkey) AS DECIMAL(18,2)) AS lo, CAST(MAX(o_orderkey) AS DECIMAL(18,2)) AS hi FROM orders
UNION ALL SELECT 'o_orderstatus', CAST(0 AS BIGINT), CAST(0 AS BIGINT), COUNT(*), NULL, NULL FROM orders
UNION ALL SELECT 'o_totalprice', CAST(0 AS BIGINT), COUNT(*), CAST(0 AS BIGINT), MIN(CAST(o_totalprice AS DECIMAL(18,2))), MAX(CAST(o_totalprice AS DECIMAL(18,2))) FROM orders)""")
def table_profile(spark: SparkSession, sf: str) -> DataFrame:
    return _dec(T.profile(table(spark, sf, "orders"), ["o_orderkey", "o_orderstatus", "o_totalprice"]), "min", "max")


@QUERIES.add("SELECT COUNT(*) AS rows, COUNT(DISTINCT text) AS distinct_texts, COUNT(*) - COUNT(DISTINCT text) AS removed FROM documents")
def table_dedup_count(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("text")
    out = T.audit(d, {"deduplicate": True, "select": ["text"]})
    return out.select(F.col("inputRows").alias("rows"), F.col("filteredRows").alias("distinct_texts"), F.col("removedDuplicates").alias("removed"))


@QUERIES.add("SELECT c_custkey, c_mktsegment, CAST(CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS DECIMAL(38,10)) AS VARCHAR) AS c_acctbal FROM customer WHERE c_acctbal IS NOT NULL ORDER BY customer.c_acctbal DESC, c_custkey LIMIT 25")
def table_sort_limit(spark: SparkSession, sf: str) -> DataFrame:
    out = T.analyze(table(spark, sf, "customer"), {"select": ["c_custkey", "c_mktsegment", "c_acctbal"], "filters": [{"column": "c_acctbal", "op": "notEmpty"}], "sortBy": "c_acctbal", "sortDirection": "desc", "limit": 25}, order="c_custkey")
    return _dec(out, "c_acctbal")


@QUERIES.add("SELECT s_name, CAST(rank AS BIGINT) AS rank, value FROM (SELECT s_name, row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey) - 1 AS rank, round(s_acctbal, 2) AS value FROM supplier) WHERE rank < 20")
def table_chart_rows(spark: SparkSession, sf: str) -> DataFrame:
    ranked = table(spark, sf, "supplier").orderBy(F.desc("s_acctbal"), "s_suppkey").select("s_name", "s_acctbal")
    return T.chart_rows(ranked, "s_name", "s_acctbal").select(F.col("label").alias("s_name"), "rank", F.round("value", 2).alias("value"))


def _ledger(spark: SparkSession, sf: str, bad: bool) -> tuple[DataFrame, list[str]]:
    """orders as a ledger of text, every 13th row twice. With `bad`, every 97th amount can't be read, every 101st key is blank, and
    every 103rd has a second row with another amount."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderdate", "o_orderstatus", F.col("o_totalprice").cast("decimal(18,2)").alias("v"), F.lit(0).alias("again"))
    k = F.col("o_orderkey")
    o = o.union(o.where(k % 13 == 0).withColumn("again", F.lit(1)))
    if bad:
        o = o.union(o.where((k % 103 == 0) & (F.col("again") == 0)).withColumn("v", F.col("v") + 1).withColumn("again", F.lit(2)))
    amount, key = F.col("v").cast("string"), k.cast("string")
    if bad:
        amount, key = F.when(k % 97 == 0, "about 5").otherwise(amount), F.when(k % 101 == 0, "").otherwise(key)
    rows = o.select(key.alias("ID"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("Date"), F.col("o_orderstatus").alias("Status"), amount.alias("Amount"), "again")
    return rows, ["ID", "Date", "Status", "Amount"]


_PLAN = S.StatisticsPlan("SUM", "Amount", (S.RowFilter("Status", "NE", "P"), S.RowFilter("Date", "GE", "1994-01-01", "DATE", "yyyy-MM-dd"), S.RowFilter("Amount", "GT", "1000", "NUMBER")), ("Status",), "ID")
_LEDGER = """WITH o AS (SELECT o_orderkey AS k, o_orderstatus AS status, CAST(o_orderdate AS DATE) AS d, CAST(o_totalprice AS DECIMAL(18,2)) AS v FROM orders), b AS (SELECT *, 0 AS again FROM o UNION ALL SELECT *, 1 FROM o WHERE k % 13 = 0),
c AS (SELECT * FROM b UNION ALL SELECT k, status, d, v + 1, 2 FROM o WHERE k % 103 = 0), e AS (SELECT *, status <> 'P' AND d >= DATE '1994-01-01' AND v > 1000 AS pass, k % 97 = 0 AS unread FROM c),
f AS (SELECT *, CASE WHEN unread THEN 'INVALID' WHEN NOT pass THEN 'EXCLUDED' WHEN k % 101 = 0 THEN 'INVALID' WHEN again = 2 THEN 'INVALID' WHEN again = 1 THEN 'DUPLICATE' ELSE 'SELECTED' END AS decision FROM e) """


@QUERIES.add(_LEDGER + "SELECT decision, COUNT(*) AS n FROM f GROUP BY decision")
def stats_decisions(spark: SparkSession, sf: str) -> DataFrame:
    rows, fields = _ledger(spark, sf, bad=True)
    return S.classify(rows, _PLAN, fields, ["again"]).groupBy("decision").agg(F.count("*").alias("n"))


@QUERIES.add("SELECT o_orderstatus AS \"Status\", COUNT(*) AS count, CAST(CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(38,10)) AS VARCHAR) AS value FROM orders WHERE o_orderstatus <> 'P' AND CAST(o_orderdate AS DATE) >= DATE '1994-01-01' AND o_totalprice > 1000 GROUP BY o_orderstatus")
def stats_accepted_totals(spark: SparkSession, sf: str) -> DataFrame:
    rows, fields = _ledger(spark, sf, bad=False)
    return _dec(S.totals(S.classify(rows, _PLAN, fields, ["again"]), _PLAN), "value")


@QUERIES.add("SELECT * FROM (SELECT '' AS \"Status\", CAST(0 AS BIGINT) AS count, '' AS value) WHERE FALSE")
def stats_refused_totals(spark: SparkSession, sf: str) -> DataFrame:
    rows, fields = _ledger(spark, sf, bad=True)
    return _dec(S.totals(S.classify(rows, _PLAN, fields, ["again"]), _PLAN), "value")


@QUERIES.add(_LEDGER + "SELECT COUNT(*) AS total, COUNT(*) FILTER (decision = 'SELECTED') AS selected, COUNT(*) FILTER (decision = 'EXCLUDED') AS excluded, COUNT(*) FILTER (decision = 'DUPLICATE') AS duplicate, COUNT(*) FILTER (decision = 'INVALID') AS invalid, FALSE AS mixed, FALSE AS accepted FROM f")
def stats_summary(spark: SparkSession, sf: str) -> DataFrame:
    rows, fields = _ledger(spark, sf, bad=True)
    return S.summary(S.classify(rows, _PLAN, fields, ["again"]), _PLAN)


@QUERIES.add("SELECT o_orderpriority, COUNT(*) AS count, CAST(CAST(COUNT(DISTINCT o_custkey) AS DECIMAL(38,10)) AS VARCHAR) AS value FROM orders GROUP BY o_orderpriority")
def stats_grouped_distinct(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("customer"), "o_orderpriority", F.col("o_orderkey").alias("_row"))
    plan = S.StatisticsPlan("DISTINCT_COUNT", "customer", group_by=("o_orderpriority",))
    return _dec(S.totals(S.classify(rows, plan, ["customer", "o_orderpriority"], ["_row"]), plan), "value")


@QUERIES.add("SELECT COUNT(*) AS count, CAST(CAST(MAX(CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(38,10)) AS VARCHAR) AS value FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01'")
def stats_max_before_date(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").select(F.col("o_totalprice").cast("decimal(18,2)").cast("string").alias("Amount"), F.date_format("o_orderdate", "dd/MM/yyyy").alias("Date"), F.col("o_orderkey").alias("_row"))
    plan = S.StatisticsPlan("MAX", "Amount", (S.RowFilter("Date", "LT", "01/01/1996", "DATE", "dd/MM/yyyy"),))
    return _dec(S.totals(S.classify(rows, plan, ["Amount", "Date"], ["_row"]), plan), "value")
