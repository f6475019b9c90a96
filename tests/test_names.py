"""Named documents and the scope of a question."""

import random

import pytest

from granary.operators import names as N

DOCS = "document_id string, collection_id string, filename string, status string"
QS = "question_id int, question string, previous string, prior_documents array<string>, prior_collections array<string>, prior_strict boolean"
CATALOGUE = [("d1", "c1", "Manual.pdf", "READY"), ("d2", "c2", "manual.PDF", "READY"), ("d3", "c1", "notes.md", "READY"), ("d4", "c2", "draft.docx", "PROCESSING"), ("d5", "c3", "plan.txt", "READY"), ("d6", "c1", "plan.txt", "READY"), ("d7", "c3", "", "READY"), ("d8", "c3", "gone.md", "FAILED")]
COLLECTIONS = [("c1", "Physics"), ("c2", "History"), ("c3", "x"), ("c4", "Empty one")]


@pytest.mark.parametrize("most_bytes", [1 << 20, 0])
def test_names_in_questions(spark, most_bytes):
    rnd = random.Random(2)
    words = ["ab", "a", "abc", "Bca", "é", "日本", "日", "x.pdf", "AB", "ca b", "0123456789abcdef-long", "[a-z]", " ", ""]
    names = words + ["".join(rnd.choice("abc") for _ in range(rnd.randint(1, 20))) for _ in range(60)]
    asked = [(i, "".join(rnd.choice(["ab", "c", "BCA", "é", "日本", "x.pdf", " ", "[a-z]", "0123456789abcdef-LONG"]) for _ in range(rnd.randint(0, 12)))) for i in range(60)]
    asked += [(100, None), (101, "")]
    got = {(r.question_id, r.name) for r in N.names_in(spark.createDataFrame(asked, "question_id int, question string"), spark.createDataFrame([(n,) for n in [*names, None]], "name string"), most_bytes=most_bytes).collect()}
    assert got == {(i, n.lower()) for i, t in asked for n in names if n.strip() and n.lower() in (t or "").lower()}
    none = N.names_in(spark.createDataFrame(asked, "question_id int, question string"), spark.createDataFrame([], "name string"), most_bytes=most_bytes)
    assert none.collect() == []


def decide(spark, asked, docs=CATALOGUE, ranked=None, probe=None):
    rows = [(i, q, p, d, c, s) for i, (q, p, d, c, s) in enumerate(asked)]
    got = N.named_scope(spark.createDataFrame(rows, QS), spark.createDataFrame(docs, DOCS), spark.createDataFrame(COLLECTIONS, "collection_id string, name string"), ranked, probe).collect()
    return [(r.reason, r.strict, r.documents, r.collections) for r in sorted(got, key=lambda r: r.question_id)]


def test_named_documents(spark):
    ask = lambda q, docs=None, cols=None: (q, None, docs, cols, None)
    got = decide(spark, [
        ask("what does NOTES.MD say"), ask("notes.md and manual.pdf"), ask("compare notes.md with draft.docx"), ask("notes.md and other.pdf"), ask("see other.docx"), ask("open plan.txt"), ask("plan.txt in physics"),
        ask("plan.txt", ["d5"]), ask("plan.txt", ["d5", "d6"]), ask("gone.md?"), ask("tell me about History"), ask("Empty one"), ask("x marks"), ask("不用查资料, notes.md"), ask("你好!"), ask("3 + 4"), ask("今天几号"), ask(None),
    ])
    assert got == [
        ("document", True, ["d3"], ["c1"]), ("document", True, ["d1", "d2", "d3"], ["c1", "c2"]), ("not_ready", True, [], []), ("missing_document", True, [], []), ("missing_document", True, [], []), ("ambiguous", True, [], []), ("document", True, ["d6"], ["c1"]),
        ("document", True, ["d5"], ["c3"]), ("ambiguous", True, [], []), ("not_ready", True, [], []), ("collection_topic", False, [], ["c2"]), ("semantic", False, [], []), ("semantic", False, [], []), ("disabled", False, [], []), ("ordinary", False, [], []),
        ("ordinary", False, [], []), ("ordinary", False, [], []), ("semantic", False, [], []),
    ]


def test_this_document_and_follow_ups(spark):
    one = [CATALOGUE[2]]
    assert decide(spark, [("只根据文档回答", None, ["d3"], None, None), ("这份资料讲什么", None, None, None, None)], one) == [("document", True, ["d3"], ["c1"])] * 2
    got = decide(spark, [("只根据文档回答", None, ["d3"], None, None), ("只根据文档回答", None, ["d3", "d6"], None, None), ("这份资料讲什么", None, None, None, None), ("这份pdf讲什么", None, ["d4"], None, None)])
    assert got == [("document", True, ["d3"], ["c1"]), ("ambiguous", True, [], []), ("ambiguous", True, [], []), ("ambiguous", True, [], [])]
    ranked = spark.createDataFrame([(2, "c2", 9.0, 3), (2, "c1", 4.0, 1), (3, "c1", 9.0, 3), (3, "c2", 7.0, 2), (4, "c1", 5.0, 1), (4, "c2", 4.5, 1), (5, "c2", 9.0, 3), (5, "c1", 7.0, 2), (5, "c3", 6.9, 2)], "question_id int, collection_id string, score double, matches int")
    probe = spark.createDataFrame([(6, "c1", 3.0), (6, "c2", 2.5), (6, "c3", 1.0), (7, "c1", 1.0)], "question_id int, collection_id string, score double")
    asked = [("那第二章呢", "what is in it", ["d3"], ["c1", "zz"], True), ("换个话题, 那第二章呢", "", None, ["c1"], False), ("那别的呢", "a", None, ["c1"], False), ("energy", "", None, None, None), ("energy", "", None, None, None), ("对比 energy", "", None, None, None), ("tides", "", None, None, None), ("tides", "", None, None, None), ("那第二章呢", "", None, ["zz"], False)]
    assert decide(spark, asked, ranked=ranked, probe=probe) == [
        ("followup", True, ["d3"], ["c1"]), ("semantic", False, [], []), ("topic", False, [], ["c2"]), ("topic", False, [], ["c1"]), ("semantic", False, [], []), ("topic", False, [], ["c2", "c1", "c3"]), ("lexical", False, [], ["c1", "c2"]), ("uncertain", False, [], []), ("semantic", False, [], []),
    ]
    assert decide(spark, [("anything", None, None, None, None)], [CATALOGUE[3]]) == [("empty", False, [], [])]


def test_a_name_of_very_many_documents(spark):
    docs = [(f"d{i}", f"c{i % 4 + 1}", "readme.md", "READY") for i in range(3000)]
    assert decide(spark, [("readme.md", None, None, None, None), ("readme.md", None, ["d77"], None, None)], docs) == [("ambiguous", True, [], []), ("document", True, ["d77"], ["c2"])]
