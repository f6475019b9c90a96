import random

import pytest
from pyspark.sql import functions as F

from granary.functions import text as X
from granary.functions.arithmetic import calculate
from granary.operators import chunking as C
from granary.operators import guard, web


def one(spark, make, *values):
    df = spark.createDataFrame([values], ", ".join(f"c{i} string" for i in range(len(values))))
    return df.select(make(*[F.col(f"c{i}") for i in range(len(values))])).first()[0]


def test_terms(spark):
    assert one(spark, X.routing_terms, "The Redis缓存穿透 a1 a1") == ["redis", "缓存", "存穿", "穿透", "a1"]
    assert set(one(spark, X.memory_terms, "Ticket AB-12 预算")) == {"ticket", "ab-12", "预算"}


def test_similarity(spark):
    assert one(spark, X.title_similarity, "World Cup 2026!", "world cup 2026") < 1
    assert one(spark, X.title_similarity, "a b, c", "abc") == 1.0
    assert one(spark, X.title_similarity, "x", "y") == 0.0


def test_urls(spark):
    assert one(spark, X.public_url, "HTTPS://Example.COM:8080/a?q=1#f") == "https://example.com:8080/a?q=1"
    for bad in ("http://localhost/x", "http://10.0.0.1/", "ftp://a.com", "http://u:p@a.com/", "http://box.internal/", "nonsense"):
        assert one(spark, X.public_url, bad) is None
    assert one(spark, X.safe_query, "my password is x") == ""
    assert one(spark, X.safe_query, "compare report.pdf\nwith news") == "compare with news"


def test_citations(spark):
    assert one(spark, X.citation_refs, "a [2] `[3]` ![4] [5](u) \\[6] [2]\n```\n[7]\n```\n[1]") == [2, 1]
    assert one(spark, X.citation_refs, '["[1]"]') == []


def test_cells_round_trip(spark):
    for cell in ("a\tb\\n\n\r", "\\", "\\t", "plain", ""):
        assert one(spark, lambda c: X.unescape_cell(X.escape_cell(c)), cell) == cell


def test_parallel_questions(spark):
    assert one(spark, X.parallel_questions, "系统甲的端口和系统乙的端口分别是多少") == ["系统甲的端口是多少", "系统乙的端口是多少"]
    assert one(spark, X.parallel_questions, "只有一个问题") == []


def test_misc(spark):
    assert one(spark, X.table_reference, "See Table 3.1 and table 3.1") == "3.1"
    assert one(spark, X.table_reference, "Table 1 vs Table 2") is None
    assert one(spark, X.normal_query, "根据我上传的文档，什么是缓存") == "什么是缓存"
    assert one(spark, X.unfenced_json, '```json\n{"a": 1}\n```') == '{"a": 1}'
    assert one(spark, X.unfenced_json, "```\nno json\n```") == "```\nno json\n```"
    assert one(spark, X.outline_snippet, "# Hi **you** &amp; [me](u)") == "Hi you & me"
    assert one(spark, X.english_answer, "Please explain the plan") is True
    assert one(spark, lambda t, q: X.best_excerpt(t, q, 50, 10), "x" * 100 + " needle " + "y" * 100, "the needle").strip().find("needle") >= 0


@pytest.mark.parametrize(("expression", "value"), [("1 + 2 * 3", "7"), ("(1+2)*-3", "-9"), ("1/3", "0.3333333333333333"), ("10/4", "2.5"), ("0.1+0.2", "0.3"), ("2/3", "0.6666666666666667")])
def test_arithmetic(expression, value):
    assert str(calculate(expression)) == value


@pytest.mark.parametrize("expression", ["1/0", "1+", "(1", "2 3", "__import__", "", "(" * 100 + "1" + ")" * 100])
def test_bad_arithmetic(expression):
    with pytest.raises(ValueError):
        calculate(expression)


def test_chunks_are_exact_substrings():
    rnd = random.Random(3)
    for _ in range(30):
        text = "".join(rnd.choice(["word ", "Dr. ", "end. ", "\n", "# H\n", "日本。", "x" * 50]) for _ in range(rnd.randint(0, 400)))
        text = C.normalized(text)
        chunks = C.located_chunks(text, size=rnd.choice([100, 500, 900]), overlap=rnd.choice([0, 30, 80]))
        covered = set()
        for s, e, *_ in chunks:
            assert 0 <= s < e <= len(text) and text[s:e].strip()
            covered.update(range(s, e))
        assert all(i in covered or text[i].isspace() for i in range(len(text)))


def test_sentence_ends_and_headings():
    assert C.sentence_places("See Fig. 3 now. Next, e.g. J. R. Smith! 日本。end.") == [15, 39, 43]
    blocks = C.heading_blocks("intro\n# A {#id}\nx\n```\n# no\n```\n## B\ny")
    assert [b.title for b in blocks] == ["body", "A", "B"]


def test_long_books_are_cut_wider():
    page = ("A plain sentence of prose stands here. Another one follows it directly, and goes on.\n" * 14)[:-1]
    blocks = [C.Block(0, len(page), "page 1", 1)]
    cuts = lambda pages, text=page: [e - s for s, e, *_ in C.located_chunks(text, blocks, pages=pages)]
    assert cuts(80)[0] <= 1000 < len(page) and cuts(79) == cuts(0) and cuts(80) != cuts(79) and cuts(79)[0] > 1000  # English prose
    assert C.long_form(page) and not C.long_form("\n".join(f"- {line}" for line in page.split("\n"))) and not C.long_form(page[:300]) and not C.long_form(page.replace(". ", ", ").replace(".\n", "\n"))


def test_tables_repeat_their_header():
    table = "Cap\n| a | b |\n|----|---|\n" + "\n".join(f"| {i} | {'x' * 40} |" for i in range(80))
    groups = C.table_groups(table)
    assert len(groups) > 1 and all(g.startswith("Cap\n| a | b |\n| --- | --- |\n") for g in groups)
    assert sum(g.count("\n") - 3 for g in groups) == 80


def test_prose_repair(spark):
    assert C.dehyphenated("efﬁcient compu-\nting and well-\nknown, well-known") == "efficient computing and well-known, well-known"
    assert one(spark, C.damaged, "ok" * 10 + chr(0xFFFD)) is True and one(spark, C.damaged, "fine text") is False
    assert C.paragraph_segments("a" * 10 + "\n\n" + "b" * 10, most=15) == ["a" * 10, "b" * 10]


def test_source_view():
    text = "a\nb\n# H\nhello world"
    blocks = C.heading_blocks(text)
    view = C.source_view(text, blocks, 8, 13, "hello")
    assert view["verified"] and view["text"][slice(*view["highlight"])] == "hello" and view["line"] == 3
    assert not C.source_view(text, blocks, 8, 13, "other")["verified"]


def test_literal_translations_and_sites(spark):
    said = ["把“你好”翻译成英文", '把"a b"翻译成日语，只给译文。', "把你好翻译成英文", "把“你好”翻译成诗", "请把“你好”翻译成英文", None, "把“a”翻译成法语! 再说"]
    got = spark.createDataFrame([(t,) for t in said], "t string").select(X.literal_translation(F.col("t")), X.preferred_domain(F.col("t"))).collect()
    assert [r[0] for r in got] == [True, True, False, False, False, False, False] and {r[1] for r in got} == {""}
    asked = {"Docker compose": "docs.docker.com", "docker and Spring Boot": "", "python": "", "python 版本": "docs.python.org", "DeepSeek": "api-docs.deepseek.com"}
    assert {q: one(spark, X.preferred_domain, q) for q in asked} == asked


def test_masker_is_split_invariant(spark):
    keys = ["ab", "abc", "cab", "x"]
    rnd = random.Random(5)
    texts = ["".join(rnd.choice("abcx ") for _ in range(rnd.randint(0, 40))) for _ in range(60)]
    whole = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(guard.mask_leftmost(F.col("t"), keys)).collect()]
    for text, want in zip(texts, whole, strict=True):
        masker, out, at = guard.Masker(keys), "", 0
        while at < len(text):
            n = rnd.randint(1, 5)
            out += masker.append(text[at : at + n])
            at += n
        assert out + masker.finish() == want


def test_guard_order(spark):
    df = spark.createDataFrame([("b then a",), ("ring 555-1234",), ("",), (None,)], "t string")
    rows = guard.check(df, "t", ["a", "b"], [r"\d{3}-\d{4}"]).collect()
    assert [(r.rule, r.action) for r in rows] == [("a", "BLOCK"), (r"\d{3}-\d{4}", "BLOCK"), (None, "ALLOW"), (None, "ALLOW")]
    assert one(spark, lambda c: guard.mask_in_order(c, ["ab", "b"]), "abb") == "******"


PAGE = '<html><head><title> T &amp; x </title></head><body><nav>menu</nav><article><h1>Head</h1><p>One <b>two</b> <a href="/a">link</a>.</p><ul><li>i</li></ul><pre class="language-py">x = 1\n  y</pre><script>no</script></article></body></html>'


def test_markdown():
    text = web.html_markdown(PAGE)
    assert text.startswith("# Head") and "**two**" in text and "[link](/a)" in text and "- i" in text and "```py\nx = 1\n  y\n```" in text and "no" not in text.split("y\n```")[1] and "menu" not in text
    assert web.html_markdown("<body><div class='cookie-banner'>eat</div><p>text here</p></body>") == "text here"
    assert web.html_markdown(None) == ""


def test_links_and_crawl(spark):
    html = '<a href="/b">b</a><a href="https://h.example.com/c.png">i</a><a href="http://other.example.com/">o</a><a href="#x">x</a><a href="d">d</a>'
    pages = spark.createDataFrame([(1, "https://h.example.com/x/a", html), (2, "https://h.example.com/b", '<a href="/x/d">d</a>'), (3, "https://h.example.com/x/d", "")], "page_id long, url string, html string")
    links = {r.link for r in web.page_links(pages).where("page_id = 1").collect()}
    assert links == {"https://h.example.com/b", "https://h.example.com/x/d"}
    assert {(r.url, r.depth) for r in web.crawl(pages, "https://h.example.com/b").collect()} == {("https://h.example.com/b", 0), ("https://h.example.com/x/d", 1)}


def test_search_results(spark):
    rows = [(1, i, n, s, u, p) for i, (n, s, u, p) in enumerate([("World Cup final result today", "text", "https://a.com/1", "2024-01-14"), ("World Cup final result today!", "text", "https://b.com/1", ""), ("点击领取", "广告", "https://c.com", ""), ("Old news", "text", "https://trusted.com/x", "2020-01-01T00:00"), ("", "", "https://d.com", "")])]
    df = spark.createDataFrame(rows, "query_id int, position int, name string, snippet string, url string, published string")
    got = web.filter_results(df, "2024-01-15", ["trusted.com"], 5).orderBy("rank").collect()
    assert [(r.name, r.score) for r in got] == [("World Cup final result today", 3), ("Old news", 3)]


def test_result_parsing(spark):
    text = "x" * 50
    raw = [(f'{{"results": [{{"url": "https://a.com/p", "title": "A", "text": "{text}"}}, {{"url": "https://a.com/p", "text": "{text}"}}, {{"url": "http://localhost/", "text": "{text}"}}]}}',), (f"Title: B\nURL: https://b.com/q\nText: {text}\nTitle: C\nURL: https://c.com\nText: short",)]
    got = web.parse_results(spark.createDataFrame(raw, "raw string")).collect()
    assert sorted((r.title, r.url) for r in got) == [("A", "https://a.com/p"), ("B", "https://b.com/q")]


def test_json_text(spark):
    assert one(spark, web.json_text, '{"a": {"Content": "long enough text"}, "title": "short"}') == "## content\n\nlong enough text\n\n"
    assert one(spark, web.json_text, "not json") == "not json"


def test_filtered_results_take_every_page_by_host(spark, tmp_path):
    from granary.catalog import documents

    titles = ["red apple", "green pear tart", "blue sky above", "old stone bridge"]
    pages = [(k, f"https://h{k % 7}.example.org/{k}", f"<html><title>{titles[k // 7 % 4]}</title><p>text</p></html>") for k in range(140)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    want = set()
    for host in range(7):
        seen = set()
        for k, _, html in pages:
            if k % 7 == host and html not in seen:  # equal titles only: the four are unlike each other
                seen.add(html)
                want.add((f"h{host}.example.org", k))
    got = {(r.query_id, r.position) for r in documents.filtered_results(spark, str(tmp_path)).collect()}
    assert got == want and len(got) == 28
