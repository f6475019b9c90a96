"""Facts under projects: what is read, what is held back, what is recalled, and reading again."""

import random

import pytest
from pyspark.sql import functions as F

from granary.operators import memory as M
from granary.operators import said as S
from granary.streaming import events as E

TWO = ["云帆项目的预算是8600元，负责人是周岚。", "海棠项目的预算是20000元，负责人是李澄。", "更正：云帆项目的预算调整为9100元。"]


def read(text):
    return [(f.label, f.value) for f in S.facts_of(text)]


def test_clauses_carry_their_project():
    assert read(TWO[0]) == [("云帆项目预算", "8600元"), ("云帆项目负责人", "周岚")] and read(TWO[2]) == [("云帆项目预算", "9100元")]
    assert read("云帆项目预算：100元；负责人：周岚；海棠项目预算：200元；负责人：李澄。预算：300元。") == [("云帆项目预算", "100元"), ("云帆项目负责人", "周岚"), ("海棠项目预算", "200元"), ("海棠项目负责人", "李澄"), ("预算", "300元")]
    assert read("本项目预算：5；项目代号是X-1，工单编号：T9") == [("预算", "5"), ("项目代号", "X-1"), ("工单编号", "T9")]
    assert [(f.label, f.category) for f in S.facts_of("云帆项目下一步：评测PDF；海棠项目已完成CSV解析。")] == [("云帆项目下一步", "TASK"), ("海棠项目已完成", "TASK")]
    assert read("we use Redis; project code is AB, the budget is 1,500 USD") == [("技术选型", "Redis"), ("项目代号", "AB"), ("预算", "1,500 USD")]


def test_what_says_nothing():
    for text in (None, "", "  ", "预算是多少？", "如果预算是5", "token: abc", "发布分支是release-private。", "预算的变化", "超预算了", "budgetary rules", "负责人是", "记住", "x" * 9000, "是" * 500, "项目" * 300, "：" * 300):
        got = read(text)
        assert got == [] or got == [("明确约定", "记住")], text
    assert read("以后不要用表格") == [("约束", "以后不要用表格")] and read("请记住：颜色 = 蓝") == [("颜色", "蓝")] and len(S.facts_of("记住 " + "；".join(f"k{i}=v" for i in range(20)))) == 8


def test_projects_of_a_question():
    assert S.asked_projects("比较云帆项目与海棠项目的预算") == ["云帆项目", "海棠项目"] and S.asked_projects("本项目和项目代号") == [] and S.asked_projects(None) == []


def session(spark, texts):
    return spark.createDataFrame([(1, i, "user", t) for i, t in enumerate(texts, 1)], "session_id long, seq long, role string, content string")


def active(spark, texts):
    return M.remembered(session(spark, texts)).where("status = 'ACTIVE'")


def lines(spark, texts, query, **how):
    return "".join(r.line for r in M.recalled(active(spark, texts), query, **how).orderBy("rank").collect())


def test_corrections(spark):
    texts = [*TWO, "更正：预算改为9500元。"]
    held = M.held_back(M.facts(session(spark, texts))).where("held").collect()
    assert [(r.seq, r.value) for r in held] == [(4, "9500元")]
    now = {(r.label, r.value) for r in active(spark, texts).collect()}
    assert now == {("云帆项目预算", "9100元"), ("云帆项目负责人", "周岚"), ("海棠项目预算", "20000元"), ("海棠项目负责人", "李澄")}
    assert [(r.label, r.value, r.status) for r in M.remembered(session(spark, ["云帆项目的预算：100元。", "云帆项目预算改为200元。"])).orderBy("seq").collect()] == [("云帆项目预算", "100元", "SUPERSEDED"), ("云帆项目预算", "200元", "ACTIVE")]
    one = ["云帆项目预算：1元。", "预算改为2元。"]  # one project only: taken, as a fact of its own
    assert {(r.label, r.value) for r in active(spark, one).collect()} == {("云帆项目预算", "1元"), ("预算", "2元")}
    assert {(r.label) for r in active(spark, ["预算：1元。负责人：周岚", "忘记预算。", "预算：3元"]).collect()} == {"负责人"}


def test_recall(spark):
    assert (got := lines(spark, TWO, "云帆项目经费上限是多少？")).startswith("- 云帆项目预算: 9100元") and "海棠" not in got and "8600" not in got
    assert "海棠项目负责人: 李澄" in lines(spark, TWO, "海棠项目由谁牵头？")
    plain = ["预算：9100元；负责人：周岚；技术选型：Java 17。"]
    assert lines(spark, plain, "经费上限是多少？") == "- 预算: 9100元\n" and lines(spark, plain, "由谁牵头？") == "- 负责人: 周岚\n" and lines(spark, plain, "用哪个JDK？") == "- 技术选型: Java 17\n" and lines(spark, plain, "早餐吃什么？") == ""
    tasks = [*TWO, "云帆项目下一步：评测PDF；海棠项目下一步：评测CSV。", "发布分支是release-private。"]
    assert lines(spark, tasks, "星河项目预算和发布分支是什么？") == ""
    assert "CSV" in (got := lines(spark, tasks, "海棠项目后续安排是什么？")) and "PDF" not in got
    assert "云帆项目预算: 9100元" in (got := lines(spark, TWO, "比较云帆项目与海棠项目的预算")) and "海棠项目预算: 20000元" in got
    assert lines(spark, [*tasks, "回答偏好：简短"], "1+1", independent=True) == "- 回答偏好: 简短\n"
    assert [r.scopes for r in M.unclear_projects(active(spark, TWO), "预算是多少？").collect()] == [["云帆项目", "海棠项目"]] and M.unclear_projects(active(spark, TWO), "云帆项目预算").isEmpty()


def test_earlier_messages(spark):
    texts = ["发布分支 release-private 在周五切", "云帆项目 发布分支 v2", "我的密码 发布分支", "别的话", "发布分支 release-private", "预算：5元, 发布分支"]
    none = spark.createDataFrame([(1, 5)], "session_id long, seq long")
    ask = lambda q, **how: [r.seq for r in M.recalled_messages(session(spark, texts), q, none, **how).orderBy("rank").collect()]
    assert ask("发布分支 release-private") == [1, 2] and ask("云帆项目发布分支") == [2] and ask("发布分支", recent=5) == [1] and ask("发布分支 release-private", budget=20) == [2]


def test_stream_and_batch_agree(spark, tmp_path):
    rnd = random.Random(4)
    texts = {s: [rnd.choice(["", "更正："]) + rnd.choice(["", "甲项目", "乙项目", "丙项目"]) + rnd.choice(["预算", "负责人"]) + rnd.choice(["：", "改为"]) + str(rnd.randint(1, 3)) for _ in range(40)] for s in range(4)}
    rows = [(s, i, "user", t) for s, ts in texts.items() for i, t in enumerate(ts)]
    schema = "session_id long, seq long, role string, content string"
    found = M.facts(spark.createDataFrame(rows, schema)).select("session_id", "seq", "position", "key", "value", "scope", "field", "correction").cache()
    for k in range(3):  # three batches, in the order of messages
        found.where((F.col("seq") >= 14 * k) & (F.col("seq") < 14 * k + 14)).coalesce(1).write.parquet(f"{tmp_path}/in/b{k}")
    stream = E.remembered(E.read_stream(spark, f"{tmp_path}/in/*", found.schema, files_per_batch=1))
    q = stream.writeStream.format("memory").queryName("remembered").option("checkpointLocation", f"{tmp_path}/ck").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.table("remembered")
    taken = {(r.session_id, r.seq, r.key, r.value) for r in got.where("outcome = 'TAKEN'").collect()}
    held = {(r.session_id, r.seq) for r in got.where("outcome = 'HELD'").collect()}
    batch = M.held_back(found)
    assert held == {(r.session_id, r.seq) for r in batch.where("held").collect()} and held
    assert taken == {(r.session_id, r.seq, r.key, r.value) for r in M.versions(batch.where("not held")).collect()}


OLD = "session_id long, id string, key string, field string, value string, seq long, origin string, status string"


def test_reading_again_by_newer_rules(spark):
    old = spark.createDataFrame([
        (1, "a", "预算", "预算", "9100元", 1, "USER_MESSAGE", "SUPERSEDED"), (1, "b", "预算", "预算", "20000元", 2, "USER_MESSAGE", "ACTIVE"), (1, "c", "负责人", "负责人", "周岚", 3, "USER_MESSAGE", "ACTIVE"),
        (2, "m", "海棠项目负责人", "负责人", "周岚", None, "MANUAL", "ACTIVE"), (2, "n", "海棠项目负责人", "负责人", "李澄", 2, "USER_MESSAGE", "SUPERSEDED"), (2, "o", "目标", "目标", "x", None, "MANUAL", "SUPERSEDED"),
    ], OLD)
    fresh = spark.createDataFrame([
        (1, "云帆项目预算", "预算", "9100元", 1, "ACTIVE"), (1, "海棠项目预算", "预算", "20000元", 2, "ACTIVE"), (1, "负责人", "负责人", "周岚", 3, "ACTIVE"),
        (2, "云帆项目预算", "预算", "9100元", 1, "ACTIVE"), (2, "海棠项目负责人", "负责人", "李澄", 2, "ACTIVE"), (2, "目标", "目标", "y", 4, "ACTIVE"),
    ], "session_id long, key string, field string, value string, seq long, status string")
    tombs = spark.createDataFrame([(2, "预算")], "session_id long, key string")
    once = M.reextracted(old, fresh, tombs).cache()
    got = {(r.session_id, r.key, r.value, r.origin): (r.id, r.status) for r in once.collect()}
    assert got[1, "负责人", "周岚", "USER_MESSAGE"] == ("c", "ACTIVE") and got[1, "云帆项目预算", "9100元", "USER_MESSAGE"][1] == "ACTIVE" and got[1, "预算", "9100元", "USER_MESSAGE"] == ("a", "SUPERSEDED") and got[1, "预算", "20000元", "USER_MESSAGE"] == ("b", "SUPERSEDED")
    assert got[2, "海棠项目负责人", "周岚", "MANUAL"] == ("m", "ACTIVE") and got[2, "海棠项目负责人", "李澄", "USER_MESSAGE"] == ("n", "SUPERSEDED") and got[2, "目标", "x", "MANUAL"] == ("o", "SUPERSEDED") and got[2, "目标", "y", "USER_MESSAGE"][1] == "ACTIVE"
    assert not any(k[0] == 2 and "预算" in k[1] for k in got) and len(got) == 9
    heirs = {r.id: r.superseded_by for r in once.collect()}
    assert heirs["a"] == got[1, "云帆项目预算", "9100元", "USER_MESSAGE"][0] and heirs["n"] is None
    again = M.reextracted(once.drop("superseded_by"), fresh, tombs)
    assert sorted(map(str, again.collect())) == sorted(map(str, once.collect()))


@pytest.mark.parametrize("texts", [[], ["无关"]])
def test_empty(spark, texts):
    assert M.remembered(session(spark, texts)).collect() == []
