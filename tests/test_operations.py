import datetime as dt
import math
import random
from collections import Counter
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from granary.operators import joins as J
from granary.operators import memory as M
from granary.operators import retrieval as R
from granary.operators import routing as RO
from granary.operators import usage as U
from granary.operators import verify as V
from granary.plans.table_plan import PlanError
from granary.streaming import events as E


def test_costs(spark):
    models = spark.createDataFrame([(1, "m", "m-1", True, False, 1, "0.010000", "0.030000"), (2, "x", "m", True, True, 9, "1.000000", "1.000000"), (3, "off", "off", False, True, 1, "5", "5")], "id int, name string, model_name string, enabled boolean, is_default boolean, sort_order int, input_price string, output_price string")
    usage = spark.createDataFrame([("m", 5, 5), ("m-1", 5, 5), ("off", 5, 5)], "model string, input_tokens int, output_tokens int")
    assert {r.model: r.cost for r in J.priced(usage, models).collect()} == {"m": Decimal("0.0100"), "m-1": Decimal("0.0003"), "off": Decimal(0)}


def test_quotas(spark):
    day = dt.date(2024, 1, 30)
    usage = spark.createDataFrame([(1, day, 90), (1, dt.date(2024, 1, 2), 500), (2, day, 10), (3, dt.date(2023, 12, 31), 9999)], "user_id int, day date, tokens int")
    quotas = spark.createDataFrame([(1, 100, 590, -1, -1), (2, 10, -1, -1, -1), (3, 10, 10, 1, 1), (4, -1, -1, -1, -1)], "user_id int, daily_tokens int, monthly_tokens int, daily_requests int, monthly_requests int")
    assert {r.user_id: r.allowed for r in U.quota_status(usage, quotas, "2024-01-30").collect()} == {1: False, 2: False, 3: True, 4: True}


def test_pages(spark):
    df = spark.range(25).toDF("id")
    assert [r.id for r in U.page(df, 3, 10, F.col("id")).collect()] == [20, 21, 22, 23, 24]
    assert tuple(U.page_info(df, 1, 10).first()) == (25, 3, 1)
    with pytest.raises(ValueError):
        U.page(df, 0, 10, F.col("id"))


def test_containing_and_as_of(spark):
    spans = spark.createDataFrame([("d", 0, 0, 10), ("d", 1, 8, 20)], "doc string, ordinal int, start int, end int")
    places = spark.createDataFrame([("d", 8, 10), ("d", 9, 15), ("d", 5, 19), ("e", 0, 1)], "doc string, start int, end int")
    assert {(r.doc, r.start): r.ordinal for r in J.containing(spans, places, "doc").collect()} == {("d", 8): 0, ("d", 9): 1, ("d", 5): -1, ("e", 0): -1}
    anchors = spark.createDataFrame([("k", 10, "a"), ("k", 20, "b")], "k string, at int, v string")
    where = spark.createDataFrame([("k", 5), ("k", 10), ("k", 19), ("k", 99), ("z", 1)], "k string, at int")
    assert {(r.k, r.at): r.v for r in J.as_of(anchors, where, "k", "at", "v").collect()} == {("k", 5): "a", ("k", 10): "a", ("k", 19): "a", ("k", 99): "b", ("z", 1): None}


def test_manifest(spark):
    a = spark.createDataFrame([("x", "1"), ("y", "2"), ("n", "3")], "source_key string, fingerprint string")
    b = spark.createDataFrame([("x", "1"), ("y", "0"), ("r", "9")], "source_key string, fingerprint string")
    assert {r.source_key: r.change for r in J.manifest_diff(a, b).collect()} == {"x": "unchanged", "y": "updated", "n": "added", "r": "removed"}


def test_budget_passes_over_what_does_not_fit(spark):
    items = spark.createDataFrame([("g", 1, 5), ("g", 2, 9), ("g", 3, 4), ("h", 1, 20)], "g string, n int, size long")
    assert [(r.g, r.n) for r in R.within_budget(items, "g", ["n"], "size", 10).orderBy("g", "n").collect()] == [("g", 1), ("g", 3)]


def test_fusion_and_interleaving(spark):
    a = spark.createDataFrame([("x", 0.9), ("y", 0.8)], "id string, score double")
    b = spark.createDataFrame([("y", 7.0), ("z", 3.0)], "id string, score double")
    out = R.fuse(a, b).collect()
    assert [r.id for r in out] == ["y", "x", "z"] and abs(out[0].score - (1 / 62 + 1 / 61)) < 1e-12
    lists = spark.createDataFrame([(0, 1, "a"), (0, 2, "b"), (1, 1, "b"), (1, 2, "c")], "branch int, rank int, id string")
    assert [r.id for r in R.interleave(lists, 3).collect()] == ["a", "b", "c"]


def test_table_anchors(spark):
    chunks = spark.createDataFrame([("1", 0, "Table 3.1 Results\n| a | b |\n| - | - |\n| Model X | 5 |"), ("2", 1, "Table 3.10 Other"), ("3", 2, "text")], "id string, ordinal int, content string")
    assert [r.id for r in R.anchored_tables(chunks, "what is in table 3.1?").collect()] == ["1"]
    assert R.anchored_tables(chunks, "no table").count() == 0
    ranked = chunks.withColumn("rank", F.lit(9) - F.col("ordinal"))
    assert R.exact_rows_first(ranked, "score of Model X", 3).first().id == "1"


def test_scopes(spark):
    df = spark.createDataFrame([("a", "1"), ("b", "2")], "collection_id string, document_id string")
    assert df.where(R.Scope().condition()).count() == 2 and df.where(R.Scope(("a",)).condition()).count() == 1 and df.where(R.Scope(disabled=True).condition()).count() == 0
    with pytest.raises(PlanError):
        R.check_k(21)


def test_document_evidence(spark):
    long = [("d", i, ("AB-1 " if i == 7 else "x ") * 1000) for i in range(10)]
    chunks = spark.createDataFrame([*long, ("s", 0, "short")], "document_id string, ordinal int, content string")
    ranked = spark.createDataFrame([("d", 2, 0.9), ("d", 3, 0.1)], "document_id string, ordinal int, score double")
    got = sorted((r.document_id, r.ordinal) for r in R.document_evidence(chunks, ranked, ["AB-1"]).collect())
    assert got == [("d", 2), ("d", 6), ("d", 7), ("d", 8), ("s", 0)]


def test_routing(spark):
    rows = [("1", "c1", ["redis", "cache"], ["redis"]), ("2", "c2", ["mysql", "cache"], []), ("3", "c3", ["java"], [])]
    profiles = spark.createDataFrame(rows, "document_id string, collection_id string, terms array<string>, metadata_terms array<string>")
    ranked = RO.rank_collections(profiles, ["redis", "cache"])
    assert {r.collection_id: r.matches for r in ranked.collect()} == {"c1": 2, "c2": 1}
    assert [r.collection_id for r in RO.choose_collections(ranked, several=True).collect()] == ["c1"]
    q = spark.createDataFrame([("",), ("hi",), ("天气怎么样",), ("Explain the latest results and compare A vs B? Really? " + "x" * 60,), ("What is a heap?",)], "q string")
    assert [r[0] for r in q.select(RO.search_budget(q.q)).collect()] == ["NONE", "NONE", "STANDARD", "DEEP", "LIGHT"]
    p = spark.createDataFrame([("3*(2+1)=",), ("今天几号",), ("translate this",), ("你好",), ("什么是缓存",), ("Write a plan",)], "q string")
    assert [r[0] for r in p.select(RO.simple_plan(p.q)).collect()] == ["ARITHMETIC", "DATE", "TRANSLATION", "GREETING", "DEFINITION", "FULL"]
    assert p.select(RO.calendar_offset(F.lit("明天星期几"))).first()[0] == 1


def test_facts(spark):
    said = ["预算：1,000元；负责人：张三", "我的密码：123", "如果预算是5", "预算是多少？", "以后不要用表格", "请记住：颜色 = 蓝", "预算是5；预算改为7", "记住这件事", "the budget is 7", "无关的话", "", None]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(said)], "i int, t string").select("i", M.message_facts(F.col("t")).alias("f")).collect()
    found = {r.i: [(f.key, f.value) for f in r.f or []] for r in got}
    assert found[0] == [("预算", "1,000元"), ("负责人", "张三")] and found[5] == [("颜色", "蓝")] and found[6] == [("预算", "7")] and found[8] == [("预算", "7")]
    assert not any(found[i] for i in (1, 2, 3, 9, 10, 11)) and found[7] == [("明确约定:记住这件事", "记住这件事")]
    assert [f.category for r in got if r.i == 4 for f in r.f] == ["CONSTRAINT"]


def test_versions(spark):
    rows = [(1, 1, "user", "预算：5"), (1, 2, "assistant", "预算：9"), (1, 3, "user", "预算：5"), (1, 4, "user", "更正：预算改为8"), (2, 1, "user", "owner is Ann")]
    messages = spark.createDataFrame(rows, "session_id int, seq int, role string, content string")
    v = M.versions(M.facts(messages))
    assert sorted((r.session_id, r.seq, r.value, r.status) for r in v.collect()) == [(1, 1, "5", "SUPERSEDED"), (1, 4, "8", "ACTIVE"), (2, 1, "Ann", "ACTIVE")]
    controls = spark.createDataFrame([(1, 5, "FORGET", "预算")], "session_id int, seq int, action string, key string")
    assert {r.session_id for r in M.forget(M.facts(messages), controls).collect()} == {2}
    assert M.capped(v, 0).count() == 0 and M.delta(messages, 1, 2).count() == 2
    assert M.recalled(v.where("status = 'ACTIVE'"), "budget 预算", 2800).where("session_id = 1").count() == 1


def test_claims(spark):
    answers = spark.createDataFrame([(1, "Fact one [1].\nNo cite.\nFact two [1][2].\nNumeric sources: [3]")], "answer_id int, answer string")
    claims = V.claims(answers)
    assert [(r.claim, r.refs) for r in claims.orderBy("claim").collect()] == [(1, [1]), (2, [1, 2])]
    evidence = spark.createDataFrame([(1, 1, "alpha beta"), (1, 2, "gamma")], "answer_id int, index int, text string")
    verdicts = spark.createDataFrame([(1, 1, "supported", [(1, "alpha")]), (1, 2, "supported", [(1, "beta")])], "answer_id int, claim int, status string, quotes array<struct<index:int,text:string>>")
    status = V.quote_status(claims, verdicts, evidence)
    assert {r.claim: r.status for r in status.collect()} == {1: "supported", 2: "not_checked"}
    assert {r["index"]: r.status for r in V.citation_status(status).collect()} == {1: "not_checked", 2: "not_checked"}
    assert {r.claim: r.reason for r in V.checkable(claims, evidence, most_claims=1).collect()} == {1: None, 2: "over the number or length of claims"}
    assert "does not establish" in V.rewritten("Fact one [1].", [("Fact one [1].", "insufficient", [1])])


TABLE = "| ID | Amount (USD) | Rate |\n| --- | --- | --- |\n| R1 | 1,200.00 | 5 |\n| R2 | (200) | 7 |\n\nR3 Amount: 50\nR4 Amount = 9, like X-7"
INVOICES = {
    1: "| ID | Amount | Tax |\n| --- | --- | --- |\n| INV-A1 | 100.00 | 10.00 |\n| INV-A2 | 10.00 | 100.00 |", 2: "| ID | Amount | Tax |\n| --- | --- | --- |\n| INV-A3 | -10.00 | 100.00 |",
    3: "INV-A4 continuation: Amount = 321.09 CNY. This is one invoice, not two.", 4: "| Description | Note | 2024/25 £000 | 2023/24 £000 |\n| --- | --- | --- | --- |\n| Income | 5 | (21,190) | (25,496) |",
    5: "| ID | Amount |\n| --- | --- |\n| INV-A1 | 100.00 |\n| ID | Tax |\n| --- | --- |\n| INV-A2 | 100.00 |", 6: "| ID | Amount Tax |\n| --- | --- |\n| INV-A2 | 100.00 |",
    7: TABLE, 8: "ID\tAmount\tAmount\nB1\t5\t5", 9: "ID\tAmount\nB1\t5\nB1\t6", 10: "ID\tAmount\nB1\t5\nB1\t5.0",
}


def test_bound_arithmetic(spark):
    """Cases: expression, bindings (key, source, record, field, value) and the value, or None where it must be refused."""
    cases = [
        ("(v1 + v2 + v3) / 3", [("v1", 7, "R1", "Amount", "1200"), ("v2", 7, "R2", "Amount", "-200"), ("v3", 7, "R3", "Amount", "50")], "350"),
        ("v1+v2", [("v1", 1, "INV-A1", "Tax", "10.00"), ("v2", 2, "INV-A3", "Amount", "-10.00")], "0"), ("v1", [("v1", 1, "INV-A1", "Amount", "10.00")], None), ("v1", [("v1", 2, "INV-A3", "Amount", "10.00")], None),
        ("v1", [("v1", 4, "Income", "2024/25", "-21190")], "-21190"), ("v1", [("v1", 4, "Income", "2024/25", "5")], None), ("v1", [("v1", 3, "INV-A4", "Amount", "321.09")], "321.09"),
        ("v1 / 100", [("v1", 1, "inv-a1", "AMOUNT", "100")], "1"), ("v1+100", [("v1", 1, "INV-A1", "Amount", "100.00")], None), ("100+10", [], None), ("v1 * 3", [("v1", 1, "INV-A1", "Amount", "100")], None),
        ("v1+v2", [("v1", 1, "INV-A1", "Amount", "100.00"), ("v2", 1, "INV-A1", "Amount", "100.00")], None), ("v1", [("v1", 5, "INV-A2", "Amount", "100.00")], None), ("v1", [("v1", 5, "INV-A2", "Tax", "100")], "100"),
        ("v1", [("v1", 6, "INV-A2", "Amount", "100.00")], None), ("v2", [("v1", 7, "R1", "Amount", "1200")], None), ("v1", [("v1", 7, "R9", "Amount", "1200")], None), ("v1", [("v1", 7, "R4", "Amount", "9")], None),
        ("v1", [("v1", 8, "B1", "Amount", "5")], None), ("v1", [("v1", 9, "B1", "Amount", "5")], None), ("v1", [("v1", 10, "B1", "Amount", "5.00")], "5"), ("v1", [("v1", 77, "B1", "Amount", "5")], None),
        ("v1/(v1-v2)", [("v1", 1, "INV-A1", "Amount", "100"), ("v2", 1, "INV-A2", "Tax", "100")], None), ("1 + v1 * 2 / v2", [("v1", 1, "INV-A1", "Amount", "100"), ("v2", 1, "INV-A2", "Amount", "10")], "21"), ("x", None, None), (None, [], None),
    ]
    evidence = [(k, t) for k, t in INVOICES.items()]
    schema = "task_id int, expression string, records array<struct<key:string,source_index:int,record_id:string,field:string,value:string>>, evidence array<struct<index:int,text:string>>"
    got = {r.task_id: r for r in V.check_calculations(spark.createDataFrame([(i, e, r, evidence) for i, (e, r, _) in enumerate(cases)], schema)).collect()}
    for i, (expression, records, value) in enumerate(cases):
        assert got[i].value == value and (got[i].reason is None) == (value is not None), (expression, records, got[i])


def test_bound_arithmetic_reads_its_tasks_once(spark):
    """Records and evidence are made from a list whose order changes with each reading, as that of a collected list does."""
    dealt = F.udf(lambda n: random.SystemRandom().sample(range(1, 21), 20), "array<int>").asNondeterministic()
    q = spark.range(20).select(F.col("id").alias("task_id"), dealt("id").alias("q"))
    row = lambda x, i: F.concat(F.lit("| L"), (i + 1).cast("string"), F.lit(" | "), x.cast("string"), F.lit(" |"))
    text = F.concat(F.lit("| Line | Quantity |\n| --- | --- |\n"), F.array_join(F.transform("q", row), "\n"))
    record = lambda x, i: F.struct(F.concat(F.lit("v"), (i + 1).cast("string")).alias("key"), F.lit(1).alias("source_index"), F.concat(F.lit("L"), (i + 1).cast("string")).alias("record_id"), F.lit("Quantity").alias("field"), x.cast("string").alias("value"))
    tasks = q.select("task_id", F.lit(" + ".join(f"v{i}" for i in range(1, 21))).alias("expression"), F.transform("q", record).alias("records"), F.array(F.struct(F.lit(1).alias("index"), text.alias("text"))).alias("evidence"))
    assert {(r.value, r.reason) for r in V.check_calculations(tasks).collect()} == {("210", None)}


def test_bound_arithmetic_broadcasts_nothing(spark):
    """Stored tasks are small files of many lines: by the size of files, bindings and lines would be sent to the driver whole. Of a task one source
    gives its field, one is missing, one gives it twice and one has no line of it. Two rows with one id, or none, are two tasks."""
    row = lambda n, v: f"| ID | Amount |\n| --- | --- |\n| R{n} | {v} |"
    evidence = [(1, row(1, 5)), (2, row(2, 6)), (4, row(3, 7) + "\n| R3 | 8 |"), (5, row(9, 9))]
    cases = [([1], "5"), ([1, 2], "11"), ([1, 3], None), ([1, 4], None), ([1, 5], None), ([6], None), ([2], "6")]
    value = {1: (1, "R1", "5"), 2: (2, "R2", "6.00"), 3: (3, "R1x", "5"), 4: (4, "R3", "7"), 5: (5, "R4", "9"), 6: (1, "R1", "6")}
    rows = [(None if i > 4 else min(i, 1), " + ".join(f"v{k}" for k in ks), [(f"v{k}", value[k][0], value[k][1], "Amount", value[k][2]) for k in ks], evidence) for i, (ks, _) in enumerate(cases)]
    schema = "task_id int, expression string, records array<struct<key:string,source_index:int,record_id:string,field:string,value:string>>, evidence array<struct<index:int,text:string>>"
    checked = V.check_calculations(spark.createDataFrame(rows, schema))
    assert sorted(map(str, checked.select("task_id", "value").collect())) == sorted(f"Row(task_id={r[0]}, value={v!r})" for r, (_, v) in zip(rows, cases))
    assert "Broadcast" not in checked._jdf.queryExecution().toString()


def test_document_profiles_shuffle_no_words(spark):
    rows = [(1, "beta alpha beta 数据 数据 数据 数据"), (2, None), (3, "the the"), (4, "zeta"), (4, "eta zeta"), (None, "iota")]
    df = spark.createDataFrame(rows, "document_id long, text string")
    assert {r.document_id: r.terms for r in RO.document_profile(df).collect()} == {1: ["beta", "数据", "alpha"], 4: ["zeta", "eta"], None: ["iota"]}
    assert [r.terms for r in RO.document_profile(df.where("document_id = 1"), most=2).collect()] == [["beta", "数据"]]
    assert "Exchange" not in RO.document_profile(df.where("document_id < 4"))._jdf.queryExecution().executedPlan().toString()


def test_identifiers(spark):
    df = spark.createDataFrame([("d", "| INV-001 | x |\ninv-001 | y |\nINV-002\tz\nsee INV-003 here")], "document_id string, content string")
    assert tuple(V.identifiers(df, "INV-").first())[1:] == (3, 2)


def _stream(spark, tmp_path, batches, schema):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/b{i}")
    return E.read_stream(spark, f"{tmp_path}/in/*", schema, files_per_batch=1)


def _run(stream, tmp_path, spark, name):
    q = stream.writeStream.format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/ck").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name).collect()


def test_streaming_mask(spark, tmp_path):
    schema = "run_id int, seq int, token string, last boolean"
    rows = [[(1, 0, "the se", False)], [(1, 1, "cret is se", False)], [(1, 2, "e", True)]]
    out = _run(E.masked(_stream(spark, tmp_path, rows, schema), ["secret"]), tmp_path, spark, "masked_out")
    assert sorted("".join(r.text for r in out)) == sorted("the *** is see")


def test_streaming_quota(spark, tmp_path):
    rows = [[(1, 7, "2024-01-01", 60), (2, 7, "2024-01-01", 60), (3, 7, "2024-01-01", 1), (4, 7, "2024-01-02", 1)]]
    out = _run(E.quota_decisions(_stream(spark, tmp_path, rows, "request_id long, user_id long, day string, tokens long"), 100, -1), tmp_path, spark, "quota_out")
    assert {r.request_id: r.allowed for r in out} == {1: True, 2: True, 3: False, 4: True}


def test_streaming_windows_and_ingest(spark, tmp_path, sf):
    events = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartition(3).write.parquet(f"{tmp_path}/ev")
    stream = E.read_stream(spark, f"{tmp_path}/ev", events.schema, 1)
    q = E.tumbling(E.with_time(stream, late="60 days"), "1 day", "event_type").writeStream.format("memory").queryName("win").outputMode("complete").option("checkpointLocation", f"{tmp_path}/c1").trigger(availableNow=True).start()
    q.awaitTermination()
    want = E.tumbling(events, "1 day", "event_type").agg(F.sum("n")).first()[0]
    assert spark.table("win").agg(F.sum("n")).first()[0] == want == 1000
    for _ in range(2):
        E.ingest(stream, lambda b: b.select("event_id"), f"{tmp_path}/out", f"{tmp_path}/c2").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 1000


def test_streaming_facts(spark, tmp_path):
    rows = [[(1, "k", 1, "a"), (1, "k", 2, "a")], [(1, "k", 5, "b"), (1, "k", 2, "a")], [(1, "k", 3, "z")]]
    flat = [[(r[0], r[1], r[2], r[3]) for r in b] for b in rows]
    out = _run(E.latest_facts(_stream(spark, tmp_path, flat, "session_id long, key string, seq long, value string")), tmp_path, spark, "facts_out")
    assert len([r for r in out if not r.late]) >= 1 and len({(r.seq, r.late) for r in out}) == len(out)


def test_streaming_facts_hold_a_state_for_each_session(spark, tmp_path):
    rows = [[(1, "a", 1, "x"), (1, "b", 2, "x"), (1, None, 3, "x"), (2, "a", 4, None)], [(1, "a", 5, "y"), (1, "b", 6, "x"), (1, None, 7, None), (2, "a", 8, "z"), (1, "b", 1, "w")]]
    stream = E.latest_facts(_stream(spark, tmp_path, rows, "session_id long, key string, seq long, value string"))
    q = stream.writeStream.format("memory").queryName("session_facts").option("checkpointLocation", f"{tmp_path}/ck").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["numInputRows"]} == {2}
    got = {(r.session_id, r.key, r.seq, r.value, r.superseded, r.late) for r in spark.table("session_facts").collect()}
    assert got == {(1, "a", 1, "x", None, False), (1, "b", 2, "x", None, False), (1, None, 3, "x", None, False), (1, "a", 5, "y", "x", False), (1, None, 7, None, "x", False), (2, "a", 8, "z", None, False), (1, "b", 1, "w", None, True)}


def test_record_identifiers_over_four_digits(spark, tmp_path):
    from granary.catalog import documents

    spark.range(1, 12_346).selectExpr("id as s_suppkey", "concat('S', id) as s_name").write.parquet(f"{tmp_path}/supplier.parquet")
    assert [tuple(r) for r in documents.record_identifiers(spark, str(tmp_path)).collect()] == [(12_345, 12_345)]


def brute_ranks(questions, profiles):
    df = Counter(t for _, _, terms, _ in profiles for t in set(terms) if any(t in q for _, q in questions))
    best = {}
    for q, asked in questions:
        for _, c, terms, named in profiles:
            shared = set(asked) & set(terms)
            if shared:
                score = sum((3 if t.isascii() else 1) * (1 + math.log(1 + len(profiles) / df[t])) * (1.5 if t in (named or []) else 1) for t in shared)
                best[q, c] = max(best.get((q, c), (0, 0)), (round(score, 9), len(shared)))
    return best


@pytest.mark.parametrize("most_bytes", [64 << 20, 400])
def test_rank_for_questions_against_every_pair(spark, most_bytes, monkeypatch):
    if most_bytes == 400:  # several groups, portions of documents, and best rows that are handed on early
        monkeypatch.setattr(RO, "_PAIRS", 64)
        monkeypatch.setattr(RO, "_BEST", 10)
        monkeypatch.setattr(RO, "_WANTED", 3)
    rnd = random.Random(5)
    words = [f"term{i}" for i in range(30)] + ["经费", "上限"]
    some = lambda k: rnd.sample(words, min(k, len(words)))
    questions = [(i, some(rnd.choice([0, 1, 1, 2, 3, 6]))) for i in range(40)] + [(90, ["nowhere"]), (91, words)]
    profiles = [(i, rnd.choice(["a", "b", "c", None]), some(rnd.choice([0, 1, 2, 4, 9])), some(2) if i % 3 else None) for i in range(120)] + [(500, "d", words, ["term3"])]
    q = spark.createDataFrame(questions, "question_id int, terms array<string>").repartition(3)
    p = spark.createDataFrame(profiles, "document_id int, collection_id string, terms array<string>, metadata_terms array<string>").repartition(5)
    got = {(r.question_id, r.collection_id): (round(r.score, 9), r.matches) for r in RO.rank_for_questions(q, p, most_bytes).collect()}
    assert got == brute_ranks(questions, profiles)
    assert RO.rank_for_questions(q.where("question_id > 89 and question_id < 91"), p, most_bytes).collect() == []
    assert RO.rank_for_questions(q, p.where("document_id < 0"), most_bytes).collect() == []


def test_questions_and_documents_of_a_common_term_are_no_rows(spark):
    """A term of 300 documents and 300 questions was 90,000 rows of a shuffle."""
    q = spark.range(300).select(F.col("id").alias("question_id"), F.array(F.lit("common"), F.concat(F.lit("q"), F.col("id"))).alias("terms"))
    p = spark.range(300).select(F.col("id").alias("document_id"), F.lit("c").alias("collection_id"), F.array(F.lit("common"), F.concat(F.lit("d"), F.col("id"))).alias("terms"), F.array().cast("array<string>").alias("metadata_terms"))
    none = lambda: spark._jvm.java.util.ArrayList()
    stages = lambda: {s.stageId(): s.shuffleWriteRecords() for s in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark.sparkContext._jsc.sc().statusStore().stageList(none(), False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), none()))}
    before = stages()
    rows = RO.rank_for_questions(q, p).collect()
    assert len(rows) == 300 and all(r.matches == 1 for r in rows)
    assert sum(n for s, n in stages().items() if s not in before) < 10_000
