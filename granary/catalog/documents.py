"""Documents, pages and conversations as text: chunks, web text, guards, evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.catalog import Catalog, table
from granary.functions import numbers as N
from granary.functions import text as X
from granary.functions.arithmetic import evaluated
from granary.operators import chunking, guard, memory, similar, verify, web
from granary.sources import delimited, files

QUERIES = Catalog()


@QUERIES.add("SELECT doc_id, CAST((length(text) + 3) // 4 AS BIGINT) AS chunk_tokens, CAST(greatest(1, length(text) // 2) AS BIGINT) AS prompt_tokens FROM documents")
def token_estimates(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf, "documents").select("doc_id", X.chunk_tokens(t).cast("long").alias("chunk_tokens"), X.prompt_tokens(t).cast("long").alias("prompt_tokens"))


@QUERIES.add("SELECT doc_id, sha256(text) AS fingerprint, CASE WHEN length(text) > 200 THEN concat(substr(text, 1, 200), '...') ELSE text END AS preview FROM documents")
def fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("fingerprint"), X.preview(F.col("text"), 200).alias("preview"))


@QUERIES.add(None)
def located_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.chunk_documents(table(spark, sf, "documents"))


@QUERIES.add("SELECT CAST(0 AS BIGINT) AS broken, (SELECT COUNT(*) FROM documents WHERE trim(text, ' ' || chr(9) || chr(10) || chr(13)) <> '') AS documents")
def located_chunks_exact(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    c = chunking.chunk_documents(d).join(d.select("doc_id", "text"), "doc_id")
    exact = F.col("content") == F.substring("text", F.col("start") + 1, F.col("end") - F.col("start"))
    return c.agg(F.count_if(~exact).alias("broken"), F.count_distinct("doc_id").alias("documents"))


@QUERIES.add("SELECT doc_id, CAST(p AS BIGINT) AS page, substr(text, CAST((p - 1) * 6000 + 1 AS BIGINT), 6000) AS content FROM documents, LATERAL (SELECT unnest(generate_series(1, greatest(1, (length(text) + 5999) // 6000))) AS p)")
def text_pages(spark: SparkSession, sf: str) -> DataFrame:
    return files.text_pages(table(spark, sf, "documents")).select("doc_id", F.col("page").cast("long").alias("page"), "content")


_TITLE = r"coalesce(nullif(trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\s+', ' ', 'g')), ''), nullif(trim(regexp_replace(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), '\s+', ' ', 'g')), ''), url)"


@QUERIES.add(f"SELECT page_id, {_TITLE} AS title FROM pages")
def page_titles(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", web.page_title(F.col("html"), F.col("url")).alias("title"))


@QUERIES.add("""SELECT page_id, length(html) >= 1000 AND list_sum(list_transform(regexp_extract_all(html, '(?is)<script[^>]*>.*?</script>'), lambda x: length(x))) > 0.3 * length(html) AND length(trim(regexp_replace(regexp_replace(html, '<[^>]+>', '', 'g'), '\\s+', ' ', 'g'))) < 500 AS shell FROM pages""")
def spa_shell(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", web.shell_page(F.col("html")).alias("shell"))


@QUERIES.add(None)
def page_links(spark: SparkSession, sf: str) -> DataFrame:
    return web.page_links(table(spark, sf, "pages"), most=20)


@QUERIES.add(None)
def page_markdown(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", web.to_markdown(F.col("html")).alias("markdown"))


@QUERIES.add(None)
def page_crawl(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages")
    return web.crawl(pages, pages.groupBy(X.domain(F.col("url"))).agg(F.min_by("url", "page_id").alias("url")).select("url"), most_rounds=None)


@QUERIES.add("""WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS i, unnest(string_split(text, chr(10))) AS p FROM documents), k AS (SELECT *, substr(trim(regexp_replace(p, '\\s+', ' ', 'g')), 1, 80) AS key FROM l),
f AS (SELECT *, row_number() OVER (PARTITION BY doc_id, key ORDER BY i) AS n FROM k) SELECT doc_id, string_agg(p, chr(10) || chr(10) ORDER BY i) AS text FROM f WHERE length(key) < 10 OR n = 1 GROUP BY doc_id""")
def paragraph_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", web.paragraph_dedup(F.replace("text", F.lit("\n"), F.lit("\n\n"))).alias("text"))


@QUERIES.add("""WITH b AS (SELECT item_id, regexp_replace(text, '[\\s[:punct:]]', '', 'g') AS s FROM benchmark), g AS (SELECT item_id, list_distinct(list_transform(generate_series(1, length(s) - 1), lambda i: substr(s, i, 2))) AS g FROM b)
SELECT a.item_id AS a, c.item_id AS b, round(len(list_intersect(a.g, c.g)) / len(list_distinct(list_concat(a.g, c.g))), 6) AS similarity FROM g a JOIN g c ON a.item_id < c.item_id WHERE len(list_intersect(a.g, c.g)) / len(list_distinct(list_concat(a.g, c.g))) > 0.5""")
def title_jaccard_pairs(spark: SparkSession, sf: str) -> DataFrame:
    items = table(spark, sf, "benchmark").select(F.lit(0).alias("list"), F.col("item_id").alias("place"), X.title_bigrams(F.col("text")).alias("tokens"))
    return similar.like_pairs(items, "list", 0.5).select("a", "b", F.round("similarity", 6).alias("similarity"))


_KEYS = ["idiot", "trash", "the ", "stupid"]


@QUERIES.add("""SELECT conv_id, turn, CASE WHEN contains(text, 'idiot') THEN 'idiot' WHEN contains(text, 'trash') THEN 'trash' WHEN contains(text, 'stupid') THEN 'stupid' WHEN regexp_matches(text, '[0-9]{3}-[0-9]{4}') THEN '[0-9]{3}-[0-9]{4}' END AS rule,
CASE WHEN contains(text, 'idiot') OR contains(text, 'trash') OR contains(text, 'stupid') THEN 'KEYWORD' WHEN regexp_matches(text, '[0-9]{3}-[0-9]{4}') THEN 'REGEX' END AS stage, CASE WHEN contains(text, 'idiot') OR contains(text, 'trash') OR contains(text, 'stupid') OR regexp_matches(text, '[0-9]{3}-[0-9]{4}') THEN 'BLOCK' ELSE 'ALLOW' END AS action FROM conversations""")
def guard_first_hit(spark: SparkSession, sf: str) -> DataFrame:
    return guard.check(table(spark, sf, "conversations"), "text", ["idiot", "trash", "stupid"], ["[0-9]{3}-[0-9]{4}"]).select("conv_id", "turn", "rule", "stage", "action")


@QUERIES.add("SELECT conv_id, turn, replace(replace(replace(replace(text, 'idiot', '***'), 'trash', '***'), 'the ', '***'), 'stupid', '***') AS text FROM conversations")
def guard_mask(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select("conv_id", "turn", guard.mask_in_order(F.col("text"), _KEYS).alias("text"))


@QUERIES.add("SELECT conv_id, turn, regexp_replace(text, 'stupid|idiot|trash|the ', '***', 'g') AS text FROM conversations")
def guard_mask_leftmost(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select("conv_id", "turn", guard.mask_leftmost(F.col("text"), _KEYS).alias("text"))


@QUERIES.add("SELECT 'OUTPUT' AS direction, rule, COUNT(*) AS n FROM (SELECT CASE WHEN contains(text, 'idiot') THEN 'idiot' WHEN contains(text, 'trash') THEN 'trash' END AS rule FROM conversations) WHERE rule IS NOT NULL GROUP BY rule")
def guard_hit_log(spark: SparkSession, sf: str) -> DataFrame:
    c = guard.check(table(spark, sf, "conversations"), "text", ["idiot", "trash"])
    return guard.hit_log(c, "OUTPUT", "conv_id").groupBy("direction", "rule").agg(F.count("*").alias("n"))


@QUERIES.add("""SELECT page_id, lower(regexp_extract(url, '^([a-z]+)://', 1)) || '://' || lower(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)) || regexp_extract(url, '^[a-z]+://[^/?#]+([^#]*)', 1) AS url, lower(regexp_extract(url, '^https?://([^/]+)', 1)) AS domain FROM pages""")
def public_urls(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", X.public_url(F.col("url")).alias("url"), X.domain(F.col("url")).alias("domain"))


@QUERIES.add("SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN [CAST(turn AS INTEGER) + 1] WHEN turn % 3 = 1 THEN [CAST(turn AS INTEGER) + 1, 2 * CAST(turn AS INTEGER) + 5] ELSE CAST([] AS INTEGER[]) END AS refs FROM conversations")
def citation_refs(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("turn")
    answer = F.when(t % 3 == 0, F.concat(F.lit("So it is ["), t + 1, F.lit("]; see `code[9]` and [a](b)."))).when(t % 3 == 1, F.concat(F.lit("Both ["), t + 1, F.lit("]["), 2 * t + 5, F.lit("] say it, not ![7] or \\[8]. Again ["), t + 1, F.lit("]."))).otherwise('{"cites": "[1]"}')
    return table(spark, sf, "conversations").select("conv_id", "turn", X.citation_refs(answer).alias("refs"))


@QUERIES.add("""SELECT status, COUNT(*) AS n FROM (SELECT CASE WHEN doc_id % 5 = 0 THEN 'missing' WHEN trim(coalesce(text, '')) <> '' AND contains(lower(regexp_replace(text, '\\s+', '', 'g')), CASE WHEN doc_id % 5 = 1 THEN '~nowhere~' ELSE lower(lang) END) THEN 'verified' ELSE 'unverified' END AS status FROM documents) GROUP BY status""")
def extraction_statuses(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    value = F.when(F.col("doc_id") % 5 == 0, "").when(F.col("doc_id") % 5 == 1, "~nowhere~").otherwise(F.col("lang"))
    fields = d.select(F.col("doc_id").alias("document_id"), F.lit(1).alias("page"), F.lit("lang").alias("field"), value.alias("value"), F.col("text").alias("quote"))
    pages = d.select(F.col("doc_id").alias("document_id"), F.lit(1).alias("page"), "text")
    return verify.status_counts(verify.extraction_status(fields, pages))


@QUERIES.add("""WITH c AS (SELECT conv_id, unnest([turn % 4 + 1, turn % 7 + 2]) AS index, CASE WHEN length(text) % 5 = 0 THEN 'contradicted' WHEN length(text) % 5 = 1 THEN 'insufficient' WHEN length(text) % 5 = 2 THEN 'not_checked' ELSE 'supported' END AS status FROM conversations)
SELECT conv_id, CAST(index AS INTEGER) AS index, CASE WHEN bool_or(status = 'contradicted') THEN 'contradicted' WHEN bool_or(status = 'insufficient') THEN 'insufficient' WHEN bool_and(status = 'supported') THEN 'supported' ELSE 'not_checked' END AS status FROM c GROUP BY conv_id, index""")
def citation_rollup(spark: SparkSession, sf: str) -> DataFrame:
    kind, turn = F.length("text") % 5, F.col("turn").cast("int")
    status = F.when(kind == 0, "contradicted").when(kind == 1, "insufficient").when(kind == 2, "not_checked").otherwise("supported")
    checked = table(spark, sf, "conversations").select("conv_id", F.col("turn").alias("claim"), F.array(turn % 4 + 1, turn % 7 + 2).alias("refs"), status.alias("status"))
    return verify.citation_status(checked, "conv_id").select("conv_id", "index", "status")


@QUERIES.add("SELECT source, lang, CAST(row_number() OVER (PARTITION BY source ORDER BY f, lang) AS BIGINT) AS index FROM (SELECT source, lang, min(doc_id) AS f FROM documents GROUP BY ALL)")
def citation_numbers(spark: SparkSession, sf: str) -> DataFrame:
    return verify.citation_numbers(table(spark, sf, "documents"), "lang", "doc_id", "source").select("source", "lang", F.col("index").cast("long").alias("index"))


@QUERIES.add("SELECT o_orderkey, CAST(CAST((o_orderkey % 97) * 2 + 10 - (o_orderkey % 7) AS DECIMAL(38,4)) AS VARCHAR) AS value FROM orders")
def exact_arithmetic(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    e = F.concat(F.lit("("), k % 97, F.lit(") * 2 + (30 / 3) - "), k % 7)
    return table(spark, sf, "orders").select("o_orderkey", evaluated(e).cast("decimal(38,4)").cast("string").alias("value"))


@QUERIES.add("SELECT o_orderkey, CAST(CAST(CASE WHEN o_orderkey % 2 = 0 THEN -1 ELSE 1 END * CAST(o_totalprice AS DECIMAL(18,2)) AS DECIMAL(38,10)) AS VARCHAR) AS value FROM orders")
def accounting_numbers(spark: SparkSession, sf: str) -> DataFrame:
    cents = F.format_number(F.col("o_totalprice").cast("decimal(18,2)"), 2)
    cell = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("(£"), cents, F.lit(")"))).otherwise(F.concat(F.lit("+€ "), cents))
    return table(spark, sf, "orders").select("o_orderkey", N.strict_number(cell).cast("string").alias("value"))


@QUERIES.add("SELECT CAST(COUNT(*) AS BIGINT) AS rows, COUNT(DISTINCT s_suppkey) AS suppliers, CAST(CAST(SUM(CAST(s_acctbal AS DECIMAL(18,2))) AS DECIMAL(38,10)) AS VARCHAR) AS total FROM supplier")
def document_tables(spark: SparkSession, sf: str) -> DataFrame:
    line = F.concat(F.lit("| "), "s_suppkey", F.lit(" | "), "s_name", F.lit(" | "), F.col("s_acctbal").cast("decimal(18,2)"), F.lit(" |"))
    docs = table(spark, sf, "supplier").groupBy(F.floor(F.col("s_suppkey") / 1000).alias("doc_id")).agg(F.concat(F.lit("Accounts\n\n| ID | Name | Balance |\n| --- | --- | --- |\n"), F.array_join(F.array_sort(F.collect_list(line)), "\n"), F.lit("\nEnd.")).alias("text"))
    rows = delimited.extract_tables(docs)
    return rows.agg(F.count("*").alias("rows"), F.count_distinct(F.col("cells")[0]).alias("suppliers"), F.sum(N.number(F.col("cells")[2])).cast(N.DECIMAL).cast("string").alias("total"))


@QUERIES.add("SELECT CAST(COUNT(*) AS BIGINT) AS rows, COUNT(DISTINCT s_suppkey) AS identifiers FROM supplier")
def record_identifiers(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("s_suppkey").cast("string")
    line = F.concat(F.lit("| SUP-"), F.when(F.length(key) < 4, F.lpad(key, 4, "0")).otherwise(key), F.lit(" | "), "s_name", F.lit(" |"))
    # A thousand keys a document: an identifier is in one document only, so the counts add up.
    docs = table(spark, sf, "supplier").groupBy(F.floor(F.col("s_suppkey") / 1000).alias("document_id")).agg(F.array_join(F.collect_list(line), "\n").alias("content"))
    return verify.identifiers(docs, "SUP-").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("rows", "identifiers")])


@QUERIES.add(None)
def conversation_facts(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("seq"), "role", F.col("text").alias("content"))
    return memory.remembered(c)


_BAD = f"regexp_matches(name, '{web.LOW_QUALITY}') OR regexp_matches(snippet, '{web.LOW_QUALITY}')"
_LIKE = "k.name = g.name OR (len(k.tokens) > 0 AND len(g.tokens) > 0 AND len(list_intersect(k.tokens, g.tokens)) / len(list_distinct(list_concat(k.tokens, g.tokens))) > 0.8)"


@QUERIES.add(rf"""WITH RECURSIVE p AS (SELECT page_id, url, {_TITLE} AS name, regexp_replace(html, '<[^>]+>', ' ', 'g') AS snippet, CAST(page_id % 20 AS INTEGER) AS day, lower(split_part(regexp_replace(url, '^https?://', ''), '/', 1)) AS host FROM pages),
b AS (SELECT *, regexp_replace(name, '[\s[:punct:]]', '', 'g') AS bare FROM p WHERE NOT (trim(name) = '' AND trim(snippet) = '') AND NOT ({_BAD})), g AS (SELECT *, list_distinct(list_transform(range(1, length(bare)), lambda i: substr(bare, i, 2))) AS tokens, row_number() OVER (PARTITION BY host ORDER BY page_id) AS n FROM b),
r AS (SELECT host, n, page_id, true AS stay, [{{'name': name, 'tokens': tokens}}] AS kept FROM g WHERE n = 1 UNION ALL SELECT host, n, page_id, NOT dup, CASE WHEN dup THEN kept ELSE list_append(kept, {{'name': name, 'tokens': tokens}}) END FROM (SELECT g.host, g.n, g.page_id, g.name, g.tokens, r.kept, len(list_filter(r.kept, lambda k: {_LIKE})) > 0 AS dup FROM r JOIN g ON g.host = r.host AND g.n = r.n + 1)),
s AS (SELECT g.*, CASE WHEN host = 'example.com' THEN 3 ELSE 0 END + CASE WHEN 14 - day <= 1 THEN 3 WHEN 14 - day <= 3 THEN 2 WHEN 14 - day <= 7 THEN 1 ELSE 0 END AS score FROM g JOIN r USING (host, n) WHERE stay), k AS (SELECT *, CAST(row_number() OVER (PARTITION BY host ORDER BY score DESC, page_id) AS INTEGER) AS rank FROM s)
SELECT host AS query_id, page_id AS position, name, snippet, url, CAST(DATE '2024-01-01' + day AS VARCHAR) AS published, CAST(score AS INTEGER) AS score, rank FROM k WHERE rank <= 20""")
def filtered_results(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "pages").select(X.domain(F.col("url")).alias("query_id"), F.col("page_id").alias("position"), web.page_title(F.col("html"), F.col("url")).alias("name"), F.regexp_replace("html", "<[^>]+>", " ").alias("snippet"), "url", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 20).cast("int")).cast("string").alias("published"))
    return web.filter_results(p, "2024-01-15", ["example.com"], 20)


@QUERIES.add("SELECT conv_id, turn, lower(regexp_replace(text, '\\s+', '', 'g')) AS squeezed, length(text) - length(replace(text, 'e', '')) >= 1 AND length(regexp_replace(text, '[^A-Za-z]', '', 'g')) >= 10 AS english FROM conversations")
def language_and_squeeze(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf, "conversations").select("conv_id", "turn", X.squeezed(t).alias("squeezed"), (X.english_answer(t) & F.contains(t, F.lit("e"))).alias("english"))


@QUERIES.add("SELECT doc_id, regexp_matches(text, '(?i)sk-[a-z0-9_-]{8,}|bearer\\s+\\S+|api.?key|\\bpassword\\b|[\\w.+-]+@[\\w.-]+\\.[A-Za-z]{2,}|1[3-9][0-9]{9}') AS private FROM documents")
def private_texts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", ((X.safe_query(F.col("text")) == "") & (F.trim("text") != "")).alias("private"))
