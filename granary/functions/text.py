"""Terms, similarity, citations and other text functions, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that routing passes over.
STOP = "这个 那个 什么 哪些 为什么 如何 怎么 一下 请问 根据 文档 资料 教程 回答 问题 说明 可以 分别 以及 是否 多少 给出 的是 一个 我们 进行 使用 需要 通过 the and this that from with return import self none true false".split()
#: Words that memory passes over.
MEMORY_STOP = "我们 这个 本聊 聊天 之前 什么 多少 回忆 只答 没有 项目 完成 the this what remember recall only from with".split()
_HAN = r"\p{IsHan}"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _bigrams(s: Column) -> Column:
    return F.when(F.length(s) >= 2, F.transform(F.sequence(F.lit(1), F.length(s) - 1), lambda i: F.substring(s, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))


def _words(c: Column, pattern: str, stop: list[str]) -> Column:
    """Lower-case words, with repeats: Han runs as bigrams, without stop words."""
    raw = F.regexp_extract_all(F.translate(F.coalesce(c, F.lit("")), _UPPER, _UPPER.lower()), F.lit(pattern), F.lit(0))
    split = F.flatten(F.transform(raw, lambda w: F.when(w.rlike(f"^{_HAN}"), _bigrams(w)).otherwise(F.array(w))))
    return F.filter(F.when(c.rlike(_HAN), split).otherwise(raw), lambda w: ~w.isin(stop))  # most texts have no Han run to split


def routing_words(c: Column) -> Column:
    return _words(c, f"[a-z][a-z0-9_]{{1,48}}|{_HAN}{{2,}}", STOP)


def routing_terms(c: Column) -> Column:
    """The distinct terms of a text: ASCII words of two to 49 characters, and bigrams of Han runs."""
    return F.array_distinct(routing_words(c))


def memory_terms(c: Column) -> Column:
    """Distinct terms with identifiers kept whole (letters, digits, `_ . -`) and Han bigrams."""
    return F.array_distinct(_words(F.lower(c), f"[a-z0-9][a-z0-9_.-]+|{_HAN}+", MEMORY_STOP))


def term_weight(t: Column) -> Column:
    """3 for ASCII terms, 1 for others."""
    return F.when(t.rlike(r"^[\x00-\x7f]"), 3).otherwise(1)


def memory_score(query_terms: Column, text: Column) -> Column:
    """Weighted number of common terms."""
    common = F.array_intersect(query_terms, memory_terms(text))
    return F.aggregate(common, F.lit(0), lambda s, t: s + F.when(t.rlike("[a-z0-9]"), 3).otherwise(1))


def title_bigrams(c: Column) -> Column:
    """The set of character bigrams without white space and ASCII punctuation."""
    return F.array_distinct(_bigrams(F.regexp_replace(c, r"[\s\p{Punct}]", "")))


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets; 0 if either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def title_similarity(a: Column, b: Column) -> Column:
    return F.when(a == b, 1.0).otherwise(jaccard(title_bigrams(a), title_bigrams(b)))


def chunk_tokens(c: Column) -> Column:
    """The estimate for chunks: a token for four characters, rounded up."""
    return F.ceil(F.length(c) / 4)


def prompt_tokens(c: Column) -> Column:
    """The estimate for prompts: a token for two characters, one at least."""
    return F.greatest(F.lit(1), F.floor(F.length(c) / 2))


def preview(c: Column, n: int) -> Column:
    return F.when(F.length(c) > n, F.concat(F.left(c, F.lit(n)), F.lit("..."))).otherwise(c)


def domain(url: Column) -> Column:
    s = F.regexp_replace(F.coalesce(url, F.lit("")), r"^https?://", "")
    return F.lower(F.when(F.instr(s, "/") > 1, F.substring_index(s, "/", 1)).otherwise(s))


def iso_date(c: Column) -> Column:
    s = F.regexp_replace(c, "T.*", "")
    return F.when(s.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(s, "yyyy-MM-dd"))


def recency(published: Column, today: Column) -> Column:
    """3 for up to a day before today, 2 for three days, 1 for a week, else 0; later dates count as recent."""
    days = F.datediff(today, published)
    return F.when(days <= 1, 3).when(days <= 3, 2).when(days <= 7, 1).otherwise(0)


def public_url(c: Column) -> Column:
    """The address in canonical form, or null if it isn't a public http(s) one: no user, no bare or local host, no IP."""
    host = F.lower(F.try_parse_url(c, F.lit("HOST")))
    scheme = F.lower(F.try_parse_url(c, F.lit("PROTOCOL")))
    bad = host.isNull() | ~scheme.isin("http", "https") | F.try_parse_url(c, F.lit("USERINFO")).isNotNull() | (host == "localhost") | ~host.contains(".") | host.rlike(r"\.(local|internal)$|^[0-9.]+$|:")
    port = F.regexp_extract(c, r"^[A-Za-z]+://[^/?#]*(:\d+)(?:[/?#]|$)", 1)
    path, query = F.coalesce(F.try_parse_url(c, F.lit("PATH")), F.lit("")), F.try_parse_url(c, F.lit("QUERY"))
    return F.when(~F.coalesce(bad, F.lit(True)), F.concat(scheme, F.lit("://"), host, port, path, F.when(query.isNotNull(), F.concat(F.lit("?"), query)).otherwise("")))


#: What a query to an outside search may not hold.
PRIVATE = r"(?is)(sk-[A-Za-z0-9_-]{8,}|bearer\s+\S+|密码|密钥|api.?key|\bpassword\b|我们公司的|我司|[\w.+-]+@[\w.-]+\.[A-Za-z]{2,}|1[3-9][0-9]{9})"


#: Names of files, which such a search is not told.
FILE_NAME = r"(?i)[\p{L}\p{N}_-]+\.(pdf|docx?|xlsx?|txt|md)"


def safe_query(c: Column, most: int = 400) -> Column:
    """A query that may go to an outside search: empty if private; without file names; one line of up to `most` characters."""
    s = F.regexp_replace(F.coalesce(c, F.lit("")), FILE_NAME, " ")
    return F.when(F.coalesce(c, F.lit("")).rlike(PRIVATE), "").otherwise(F.left(F.trim(F.regexp_replace(s, r"\s+", " ")), F.lit(most)))


def without_code(c: Column) -> Column:
    fenced = F.regexp_replace(c, r"(?ms)^[ \t]*(?:`{3,}|~{3,})[^\r\n]*\R.*?^[ \t]*(?:`{3,}|~{3,})[ \t]*(?:\R|$)", "")
    return F.regexp_replace(fenced, r"(?s)(`+).*?\1", "")


def citation_refs(c: Column) -> Column:
    """Distinct numbers cited as [n], in the order of first use: not in code, not escaped, not images or links; none if the
    whole answer is JSON."""
    json = F.trim(c).rlike(r"(?s)^[\[{].*[\]}]$") & F.try_parse_json(c).isNotNull()
    found = F.transform(F.regexp_extract_all(without_code(c), F.lit(r"(?<![\\!])\[(\d{1,9})\](?!\()"), F.lit(1)), lambda x: x.cast("int"))
    return F.when(json, F.array().cast("array<int>")).otherwise(F.array_distinct(found))


def squeezed(c: Column) -> Column:
    """Lower case without white space, for quote checks."""
    return F.lower(F.regexp_replace(c, r"\s+", ""))


def table_reference(c: Column) -> Column:
    """The number of the one table a query names, or null."""
    found = F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(r"(?i)(?:\btable\s*|表\s*)([A-Z]?[1-9][0-9]*(?:\.[0-9]+)?)(?![0-9A-Za-z]|\.[0-9])"), F.lit(1)), lambda x: F.upper(x)))
    return F.when(F.size(found) == 1, found[0])


#: How a question begins that only says where to look; what asks for a language; what numbers of tables look like.
ACCORDING = r"^(请)?(根据|结合)(我)?(上传的|提供的)?(文档|资料|知识库)[，,：:\s]*"
IN_ENGLISH, IN_CHINESE = r"(?i)用英文|in english", r"(?i)用中文|in chinese"


def normal_query(c: Column) -> Column:
    """A question without `according to my documents`."""
    s = F.trim(F.regexp_replace(c, ACCORDING, ""))
    return F.when(s == "", c).otherwise(s)


def english_answer(c: Column) -> Column:
    """Whether to answer in English: no Han and ten Latin letters at least, unless the text says otherwise."""
    says, other = c.rlike(IN_ENGLISH), c.rlike(IN_CHINESE)
    return F.when(other, False).when(says, True).otherwise((F.regexp_count(c, F.lit(_HAN)) == 0) & (F.regexp_count(c, F.lit("[A-Za-z]")) >= 10))


#: Languages that a quoted text may be asked in, what may be said about the answer, and the sites of products.
LANGUAGES = "中文 汉语 英文 英语 日文 日语 韩文 韩语 法文 法语 德文 德语 西班牙语".split()
ANSWER_ONLY = "只给译文 仅给译文 只输出译文 不要解释".split()
SITES = {"postgresql": "postgresql.org", "spring boot": "spring.io", "docker": "docs.docker.com", "deepseek": "api-docs.deepseek.com"}
PYTHON_SITE, ABOUT_PYTHON = "docs.python.org", "官方|documentation|默认|default|版本|version"


def literal_translation(c: Column) -> Column:
    """Whether a question is nothing but a request to translate a quoted text: what is quoted is no search."""
    quoted = "(?:“[^“”]+”|\"[^\"]+\")"
    ending = f"(?:[，,]\\s*(?:{'|'.join(ANSWER_ONLY)}))?[。.!！]?"
    return F.coalesce(F.trim(c).rlike(f"(?s)^把{quoted}翻译成(?:{'|'.join(LANGUAGES)}){ending}$"), F.lit(False))


def preferred_domain(c: Column) -> Column:
    """The site of the one product that a question names; empty for none and for several."""
    q = F.lower(F.coalesce(c, F.lit("")))
    named = [F.when(F.contains(q, F.lit(product)), site) for product, site in SITES.items()]
    named.append(F.when(F.contains(q, F.lit("python")) & q.rlike(ABOUT_PYTHON), PYTHON_SITE))
    found = F.array_compact(F.array(*named))
    return F.when(F.size(found) == 1, found[0]).otherwise("")


def outline_snippet(c: Column, n: int = 60) -> Column:
    """One line of a message without marks and tags."""
    s = F.regexp_replace(without_code(c), r"<[^>]+>", " ")
    s = F.regexp_replace(s, r"!?\[([^\]]*)\]\([^)]*\)", "$1")
    s = F.regexp_replace(s, r"[#*_>`~|]+", " ")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        s = F.replace(s, F.lit(entity), F.lit(char))
    return F.left(F.trim(F.regexp_replace(s, r"\s+", " ")), F.lit(n))


def unfenced_json(c: Column) -> Column:
    """What is inside a single code fence if that is JSON, else the text."""
    inner = F.regexp_extract(c, r"(?s)^\s*```(?:json)?\s*\n(.*?)\n?```\s*$", 1)
    return F.when((inner != "") & F.try_parse_json(inner).isNotNull(), F.trim(inner)).otherwise(c)


def best_excerpt(text: Column, query: Column, limit: int, stride: int = 1000) -> Column:
    """The window of `limit` characters, starting at a multiple of `stride`, with the most query words; the first among equals."""
    terms = F.filter(F.array_distinct(F.split(F.lower(query), r"[^\p{L}\p{N}_]+")), lambda t: F.length(t) > 2)
    score = lambda at: F.aggregate(terms, F.lit(0), lambda s, t: s + F.contains(F.lower(F.substring(text, at, F.lit(limit))), t).cast("int"))
    best = F.array_max(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(text)), F.lit(stride)), lambda at: F.struct(score(at).alias("score"), (-at).alias("at"))))["at"]
    return F.when(F.length(text) <= limit, text).otherwise(F.substring(text, -best, F.lit(limit)))


def cosine(a: Column, b: Column) -> Column:
    """0 where either norm is 0; in double precision."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when((norm(a) == 0) | (norm(b) == 0), 0.0).otherwise(dot / (norm(a) * norm(b)))


def valid_vector(v: Column, dimension: int | None = None) -> Column:
    good = v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return good & (F.size(v) == dimension) if dimension else good


def retrieval_text(content: Column, page: Column, title: Column) -> Column:
    return F.concat_ws("\n", F.when(page.isNotNull(), F.concat(F.lit("Page "), page.cast("string"))), F.when(F.trim(title) != "", title), content)


def escape_cell(c: Column) -> Column:
    for raw, shown in (("\\", "\\\\"), ("\t", "\\t"), ("\r", "\\r"), ("\n", "\\n")):
        c = F.replace(c, F.lit(raw), F.lit(shown))
    return c


def unescape_cell(c: Column) -> Column:
    """The inverse of escape_cell, read from left to right."""
    parts = F.regexp_extract_all(c, F.lit(r"(?s)\\.|[^\\]+|\\$"), F.lit(0))
    one = lambda p: F.when(p == "\\t", "\t").when(p == "\\r", "\r").when(p == "\\n", "\n").when(p.startswith("\\") & (F.length(p) == 2), F.substring(p, 2, 1)).otherwise(p)
    return F.array_join(F.transform(parts, one), "")


def parallel_questions(c: Column) -> Column:
    """The two questions of `A and B respectively ...`, or none."""
    at = F.instr(c, "分别")
    head = F.substring(c, F.lit(1), at - 1)
    tail = F.substring(c, at + 2, F.length(c))
    wide = F.length(head) - F.length(F.substring_index(head, "以及", -1)) - 2
    narrow = F.length(head) - F.length(F.substring_index(head, "和", -1)) - 1
    join, width = F.when(wide >= 0, wide).otherwise(narrow), F.when(wide >= 0, 2).otherwise(1)
    left, right = F.trim(F.concat(F.substring(c, F.lit(1), join), tail)), F.trim(F.concat(F.substring(head, join + width + 1, F.length(head)), tail))
    return F.when((at > 0) & (join >= 4) & (F.length(left) >= 4) & (F.length(right) >= 4), F.array(left, right)).otherwise(F.array().cast("array<string>"))
