"""Smaller operators over whole tables, streams among them, each with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.catalog import Catalog, table
from granary.functions import text as X
from granary.operators import chunking, joins, memory, repair, splitting, web
from granary.operators import retrieval as R
from granary.operators import routing as RO
from granary.operators import statistics as ST
from granary.operators import tables as TB
from granary.operators.verify import citation_audit
from granary.sources import blocks, files
from granary.sources.commits import Commits
from granary.streaming import events as E

QUERIES = Catalog()


@QUERIES.add("SELECT CAST(conv_id AS VARCHAR) AS conv, CAST(turn AS VARCHAR) AS turn, text || ', \"' || role || '\";' || chr(10) AS note FROM conversations")
def csv_in_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """All conversations as one CSV file, with separators, quotes and line breaks inside cells, read back block by block."""
    path = files.shared_folder(spark, "csv")
    c = table(spark, sf, "conversations").select("conv_id", "turn", F.concat("text", F.lit(', "'), "role", F.lit('";\n')).alias("note"))
    cells = F.concat_ws(",", "conv_id", "turn", F.concat(F.lit('"'), F.replace("note", F.lit('"'), F.lit('""')), F.lit('"')))
    head = spark.createDataFrame([("conv,turn,note",)], "value string")
    head.union(c.select(cells.alias("value"))).coalesce(1).write.text(path)  # one file: what a user uploads
    name = next(r["path"] for r in spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path").collect())
    return blocks.read_csv_blocks(spark, name).drop("_row")


@QUERIES.add("SELECT doc_id, length(text) > 0 AND doc_id % 3 = 0 AND length(text) <= 100 * ((doc_id % 7) + 1) AS damaged FROM (SELECT doc_id, text || CASE WHEN doc_id % 3 = 0 THEN repeat(chr(65533), CAST(doc_id % 7 + 1 AS INTEGER)) ELSE '' END AS text FROM documents)")
def damaged_texts(spark: SparkSession, sf: str) -> DataFrame:
    t = F.concat("text", F.when(F.col("doc_id") % 3 == 0, F.repeat(F.lit("�"), (F.col("doc_id") % 7 + 1).cast("int"))).otherwise(F.lit("")))
    return table(spark, sf, "documents").select("doc_id", chunking.damaged(t).alias("damaged"))


@QUERIES.add("SELECT page_id, CASE WHEN length(html) > 10 THEN '## body' || chr(10) || chr(10) || html || chr(10) || chr(10) ELSE '' END || CASE WHEN length(url) > 10 THEN '## title' || chr(10) || chr(10) || url || chr(10) || chr(10) ELSE '' END AS text FROM pages")
def json_texts(spark: SparkSession, sf: str) -> DataFrame:
    answer = F.to_json(F.struct(F.struct(F.col("html").alias("Body"), F.lit("x").alias("content")).alias("data"), F.array(F.struct(F.col("url").alias("title"))).alias("results"), F.col("page_id").alias("answer")))
    return table(spark, sf, "pages").select("page_id", web.json_text(answer).alias("text"))


@QUERIES.add("SELECT page_id, page_id % 5 IN (0, 2, 3) AS supported FROM pages")
def supported_files(spark: SparkSession, sf: str) -> DataFrame:
    ending = F.element_at(F.array(*[F.lit(x) for x in (".PDF", ".html", ".csv", ".Docx", "")]), (F.col("page_id") % 5 + 1).cast("int"))
    return table(spark, sf, "pages").select("page_id", F.coalesce(files.supported(F.concat("url", F.lit("/x"), ending)), F.lit(False)).alias("supported"))


@QUERIES.add("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def deleted_rows(spark: SparkSession, sf: str) -> DataFrame:
    gone = table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return files.without(table(spark, sf, "orders"), gone, "o_orderkey").select("o_orderkey", "o_custkey")


@QUERIES.add("SELECT source, CAST(SUM(length(text)) AS BIGINT) AS chars, COUNT(*) AS documents FROM documents GROUP BY source")
def evidence_sizes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").groupBy("source").agg(F.sum(F.length("text")).alias("chars"), F.count("*").alias("documents"))


_FENCE = "'```json' || chr(10) || '{\"n\": ' || length(text) || '}' || chr(10) || '```'"


@QUERIES.add(f"""SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN '{{"n": ' || length(text) || '}}' ELSE {_FENCE} || 'x' END AS unfenced, CASE turn % 4 WHEN 0 THEN '3' WHEN 1 THEN NULL WHEN 2 THEN 'A2.1' END AS table_number, CASE turn % 3 WHEN 0 THEN 1 WHEN 1 THEN -1 END AS days,
CASE WHEN role = 'user' THEN 8 WHEN turn % 2 = 0 THEN 6 ELSE 4 END AS k, turn % 5 = 0 AS confirmed, '1' AS used, CASE WHEN turn % 2 = 0 THEN '7' ELSE '' END AS unknown FROM conversations""")
def question_details(spark: SparkSession, sf: str) -> DataFrame:
    """Fences around JSON, tables and days that questions name, how much to search for, whether a plan must be confirmed, and citations."""
    t, turn = F.col("text"), F.col("turn")
    fenced = F.concat(F.lit("```json\n{\"n\": "), F.length(t).cast("string"), F.lit("}\n```"), F.when(turn % 2 == 1, "x").otherwise(""))
    named = F.concat(F.when(turn % 4 == 0, "see Table 3 and table 3").when(turn % 4 == 1, "Table 3, table 4").when(turn % 4 == 2, "表 A2.1").otherwise("tables"), F.lit("."))
    day = F.when(turn % 3 == 0, "what date is tomorrow").when(turn % 3 == 1, "昨天几号").otherwise("hello")
    plan = F.when(turn % 5 == 0, "total of paid orders").otherwise("total of orders")
    report = F.concat(F.lit("a [1] b"), F.when(turn % 2 == 0, " [7]").otherwise(""), F.lit(" `[9]`"))
    audit = citation_audit(report, F.array(F.lit(1), F.lit(2)))
    return table(spark, sf, "conversations").select(
        "conv_id", "turn", X.unfenced_json(fenced).alias("unfenced"), X.table_reference(named).alias("table_number"), RO.calendar_offset(day).alias("days"), RO.search_k(F.col("role") == "user", turn % 2 == 0).alias("k"), ST.needs_confirmed_plan(plan).alias("confirmed"),
        F.array_join(F.transform(audit["used"], lambda x: x.cast("string")), ",").alias("used"), F.array_join(F.transform(audit["unknown"], lambda x: x.cast("string")), ",").alias("unknown"),
    )


@QUERIES.add("SELECT c_custkey, 'sales of ' || c_name || '；compare ' || c_name AS own, 'topic ' || c_custkey AS topic FROM customer")
def own_clauses(spark: SparkSession, sf: str) -> DataFrame:
    q = F.concat(F.lit("sales of "), "c_name", F.lit("; rates of other things，compare "), "c_name", F.lit("。compare "), "c_name", F.lit(" and Common report"))
    named = F.concat("c_name", F.lit(".pdf"))
    topic = repair.topic(F.concat(F.lit("intro\n研究问题： topic "), F.col("c_custkey").cast("string"), F.lit("\nend")))
    return table(spark, sf, "customer").select("c_custkey", repair.own_clauses(q, named, F.array(named, F.lit("common_report.docx"))).alias("own"), topic.alias("topic"))


@QUERIES.add("SELECT event_id, CAST(CASE WHEN event_id % 1000 <= 600 THEN event_id // 1000 ELSE -1 END AS INTEGER) AS ordinal FROM events")
def containing_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """The block of 700 places, one in every thousand, that holds each stretch of 100 whole."""
    e = table(spark, sf, "events")
    places = e.select(F.floor(F.col("event_id") / 10_000).alias("doc"), "event_id", F.col("event_id").alias("start"), (F.col("event_id") + 100).alias("end"))
    spans = e.where("event_id % 1000 = 0").select(F.floor(F.col("event_id") / 10_000).alias("doc"), (F.col("event_id") / 1000).cast("int").alias("ordinal"), F.col("event_id").alias("start"), (F.col("event_id") + 700).alias("end"))
    return joins.containing(spans, places, "doc").select("event_id", "ordinal")


@QUERIES.add("WITH s AS (SELECT source, MAX(n_chars % 97) AS score FROM documents GROUP BY source), b AS (SELECT *, MAX(score) OVER () AS best, row_number() OVER (ORDER BY score DESC, source) AS place FROM s WHERE score >= 2) SELECT source AS collection_id, score, CAST(place AS BIGINT) AS place FROM b WHERE score >= 0.72 * best AND place <= 3")
def probed_collections(spark: SparkSession, sf: str) -> DataFrame:
    hits = table(spark, sf, "documents").select(F.col("source").alias("collection_id"), (F.col("n_chars") % 97).alias("score"))
    return RO.lexical_probe(hits, several=True).select("collection_id", "score", F.col("place").cast("long").alias("place"))


@QUERIES.add("""WITH f AS (SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN '下一步' WHEN 1 THEN '已完成' ELSE '待解决' END AS label, '第' || length(text) || '步' AS value FROM conversations), d AS (SELECT *, CASE WHEN label = '已完成' THEN value ELSE '' END AS k FROM f), c AS (SELECT *, lag(value) OVER (PARTITION BY conv_id, label, k ORDER BY turn) AS before FROM d),
a AS (SELECT *, lead(turn) OVER (PARTITION BY conv_id, label, k ORDER BY turn) AS later FROM c WHERE before IS NULL OR before <> value), n AS (SELECT *, row_number() OVER (PARTITION BY conv_id, label ORDER BY turn) AS n FROM a WHERE later IS NULL) SELECT conv_id AS session_id, label, string_agg(value, ',' ORDER BY turn) AS done FROM n WHERE n <= 6 GROUP BY ALL""")
def task_states(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.element_at(F.array(F.lit("下一步"), F.lit("已完成"), F.lit("待解决")), (F.col("turn") % 3 + 1).cast("int"))
    said = table(spark, sf, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("seq"), F.lit("user").alias("role"), F.concat(kind, F.lit("：第"), F.length("text").cast("string"), F.lit("步")).alias("content"))
    return memory.task_status(memory.remembered(said).where("status = 'ACTIVE'")).select("session_id", "label", F.array_join("values", ",").alias("done"))


@QUERIES.add("""WITH RECURSIVE b AS (SELECT conv_id, turn, CASE WHEN turn % 3 < 2 THEN 'must ' ELSE '' END || text AS content, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations), o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY back) AS n FROM b WHERE back > 2 AND regexp_matches(content, '(?i)目标|要求|约束|决定|必须|预算|负责人|deadline|must|goal|decid|requirement')),
r AS (SELECT conv_id, turn, content, n, length(content) <= 3000 AS taken, CASE WHEN length(content) <= 3000 THEN length(content) ELSE 0 END AS used, CASE WHEN length(content) <= 3000 THEN 1 ELSE 0 END AS k FROM o WHERE n = 1
 UNION ALL SELECT o.conv_id, o.turn, o.content, o.n, used + length(o.content) <= 3000 AND k < 8, used + CASE WHEN used + length(o.content) <= 3000 AND k < 8 THEN length(o.content) ELSE 0 END, k + CASE WHEN used + length(o.content) <= 3000 AND k < 8 THEN 1 ELSE 0 END FROM r JOIN o ON o.conv_id = r.conv_id AND o.n = r.n + 1)
SELECT conv_id AS session_id, turn AS seq, content FROM r WHERE taken""")
def early_history(spark: SparkSession, sf: str) -> DataFrame:
    content = F.concat(F.when(F.col("turn") % 3 < 2, "must ").otherwise(""), "text")
    return memory.early_history(table(spark, sf, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("seq"), content.alias("content")), recent=2)


@QUERIES.add("""WITH RECURSIVE c AS (SELECT conv_id, turn, text, CAST(SUM(length(text)) OVER (PARTITION BY conv_id) AS BIGINT) AS chars, row_number() OVER (PARTITION BY conv_id ORDER BY (CASE WHEN length(text) % 10 >= 3 THEN length(text) % 10 END) DESC NULLS LAST, turn) AS best FROM conversations), x AS (SELECT conv_id, turn FROM c WHERE contains(lower(text), 'tion')),
w AS (SELECT DISTINCT c.* FROM c WHERE chars <= 1500 OR (best <= 3 AND length(text) % 10 >= 3) OR EXISTS (SELECT 1 FROM x WHERE x.conv_id = c.conv_id AND abs(x.turn - c.turn) <= 1)), o AS (SELECT conv_id, turn, text, CASE WHEN chars <= 1500 THEN 0 ELSE length(text) END AS size, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM w),
r AS (SELECT conv_id, turn, text, n, size <= 2500 AS taken, CASE WHEN size <= 2500 THEN size ELSE 0 END AS used FROM o WHERE n = 1 UNION ALL SELECT o.conv_id, o.turn, o.text, o.n, used + o.size <= 2500, used + CASE WHEN used + o.size <= 2500 THEN o.size ELSE 0 END FROM r JOIN o ON o.conv_id = r.conv_id AND o.n = r.n + 1)
SELECT conv_id AS document_id, turn AS ordinal, text AS content FROM r WHERE taken""")
def evidence_of_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations as documents: short ones whole, of others the best chunks, and those with an identifier beside their neighbours, in a budget."""
    chunks = table(spark, sf, "conversations").select(F.col("conv_id").alias("document_id"), F.col("turn").alias("ordinal"), F.col("text").alias("content"))
    ranked = chunks.select("document_id", "ordinal", (F.length("content") % 10 / 10).alias("score"))
    return R.document_evidence(chunks, ranked, ["TION"], budget=2500, whole=1500, k=3)


@QUERIES.add("SELECT doc_id AS document_id, doc_id % 4 <> 0 AND doc_id % 5 <> 0 AS ok FROM documents WHERE regexp_matches(text, '\\S')")
def resumable_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks with their vectors: of every fourth document one vector has no chunk, of every fifth the first chunk's text is another."""
    d = table(spark, sf, "documents")
    made = splitting.recursive_chunks(d, 400, 40).withColumnRenamed("doc_id", "document_id")
    chunks = made.withColumn("content", F.when((F.col("document_id") % 5 == 0) & (F.col("ordinal") == 1), F.lit("other")).otherwise(F.col("content")))
    vectors = made.select("document_id", F.when((F.col("document_id") % 4 == 0) & (F.col("ordinal") == 1), 1 << 20).otherwise(F.col("ordinal")).alias("ordinal"))
    return chunking.resumable(chunks, d.select(F.col("doc_id").alias("document_id"), "text"), vectors)


@QUERIES.add("SELECT conv_id, turn, turn % 3 = 0 AND text <> '' AND NOT contains(text, '”') AS literal, CASE turn % 5 WHEN 0 THEN 'postgresql.org' WHEN 1 THEN '' WHEN 2 THEN 'docs.python.org' ELSE '' END AS site FROM conversations")
def translations_and_sites(spark: SparkSession, sf: str) -> DataFrame:
    t, turn = F.col("text"), F.col("turn")
    asked = F.concat(F.lit("把“"), t, F.lit("”翻译成"), F.when(turn % 3 == 0, "英文，只给译文。").when(turn % 3 == 1, "诗").otherwise("英文，再解释"))
    site = F.when(turn % 5 == 0, "PostgreSQL upsert").when(turn % 5 == 1, "postgresql in docker").when(turn % 5 == 2, "the default of Python's sort").when(turn % 5 == 3, "python lists").otherwise("none")
    return table(spark, sf, "conversations").select("conv_id", "turn", X.literal_translation(asked).alias("literal"), X.preferred_domain(site).alias("site"))


@QUERIES.add("SELECT conv_id, turn FROM conversations WHERE role = 'user' AND length(text) <= 1000 AND (contains(lower(text), 'tion') OR contains(lower(text), 'erthe') OR contains(lower(text), 'keit'))")
def recall_candidates(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations").withColumnRenamed("text", "content")
    return memory.recall_candidates(c, "Tion erthe KEIT, what").select("conv_id", "turn")


@QUERIES.add("SELECT o_orderkey, o_orderpriority FROM orders ORDER BY o_orderpriority, o_orderkey LIMIT 5")
def table_sample(spark: SparkSession, sf: str) -> DataFrame:
    return TB.sample_rows(table(spark, sf, "orders"), ["o_orderpriority", "o_orderkey"]).select("o_orderkey", "o_orderpriority")


def _streamed(spark: SparkSession, stream: DataFrame) -> DataFrame:
    """What a stream gives when its present files are done, by way of the shared folder."""
    path, checkpoint = files.shared_folder(spark, "stream"), files.shared_folder(spark, "stream-checkpoint")
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def _events(spark: SparkSession, sf: str) -> DataFrame:
    path = f"{sf}/events.parquet"
    return E.read_stream(spark, path[:-1] + "[t]", spark.read.parquet(path).schema)


@QUERIES.add("""WITH RECURSIVE e AS (SELECT event_id, user_id, CAST(ts AS DATE) AS day, event_id % 500 AS tokens, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
r AS (SELECT event_id, user_id, day, n, true AS allowed, tokens AS used_day, tokens AS used_month FROM e WHERE n = 1 UNION ALL SELECT e.event_id, e.user_id, greatest(e.day, r.day), e.n, CASE WHEN e.day > r.day THEN 0 ELSE used_day END < 600 AND CASE WHEN date_trunc('month', e.day) > date_trunc('month', r.day) THEN 0 ELSE used_month END < 9000,
 CASE WHEN e.day > r.day THEN 0 ELSE used_day END + CASE WHEN CASE WHEN e.day > r.day THEN 0 ELSE used_day END < 600 AND CASE WHEN date_trunc('month', e.day) > date_trunc('month', r.day) THEN 0 ELSE used_month END < 9000 THEN tokens ELSE 0 END,
 CASE WHEN date_trunc('month', e.day) > date_trunc('month', r.day) THEN 0 ELSE used_month END + CASE WHEN CASE WHEN e.day > r.day THEN 0 ELSE used_day END < 600 AND CASE WHEN date_trunc('month', e.day) > date_trunc('month', r.day) THEN 0 ELSE used_month END < 9000 THEN tokens ELSE 0 END FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1)
SELECT event_id AS request_id, user_id, allowed FROM r""")
def quota_stream(spark: SparkSession, sf: str) -> DataFrame:
    requests = _events(spark, sf).select(F.col("event_id").alias("request_id"), "user_id", F.to_date("ts").alias("day"), (F.col("event_id") % 500).alias("tokens"))
    return _streamed(spark, E.quota_decisions(requests, 600, 9000))


@QUERIES.add("""WITH f AS (SELECT user_id AS session_id, event_type AS key, event_id AS seq, CAST(CAST(floor(value / 40) AS BIGINT) AS VARCHAR) AS value FROM events), c AS (SELECT *, lag(value) OVER (PARTITION BY session_id, key ORDER BY seq) AS superseded FROM f)
SELECT session_id, key, seq, value, superseded, false AS late FROM c WHERE superseded IS NULL OR superseded <> value""")
def fact_stream(spark: SparkSession, sf: str) -> DataFrame:
    found = _events(spark, sf).select(F.col("user_id").alias("session_id"), F.col("event_type").alias("key"), F.col("event_id").alias("seq"), F.floor(F.col("value") / 40).cast("string").alias("value"))
    return _streamed(spark, E.latest_facts(found))


@QUERIES.add("SELECT user_id AS run_id, replace(string_agg(CASE event_id % 3 WHEN 0 THEN 'se' WHEN 1 THEN 'cret' ELSE '-' END, '' ORDER BY event_id), 'secret', '***') AS text FROM events GROUP BY user_id")
def masked_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Each user's tokens in order; the word to mask is in two of them."""
    e = table(spark, sf, "events")
    ends = F.broadcast(e.groupBy("user_id").agg(F.max("event_id").alias("end")).withColumnRenamed("user_id", "u"))
    s = _events(spark, sf)
    token = F.element_at(F.array(F.lit("se"), F.lit("cret"), F.lit("-")), (F.col("event_id") % 3 + 1).cast("int"))
    tokens = s.join(ends, s["user_id"] == F.col("u")).select(F.col("user_id").alias("run_id"), F.col("event_id").alias("seq"), token.alias("token"), (F.col("event_id") == F.col("end")).alias("last"))
    return _streamed(spark, E.masked(tokens, ["secret"])).groupBy("run_id").agg(F.array_join(F.collect_list("text"), "").alias("text"))


@QUERIES.add("SELECT event_type AS kind, COUNT(*) AS rows, 'READY' AS status FROM events GROUP BY 1")
def committed_stream(spark: SparkSession, sf: str) -> DataFrame:
    """A stream's rows and their documents' status, committed together a batch at a time."""
    into = Commits(spark, files.shared_folder(spark, "ingest"), "kind string, event_id long", ["kind"])
    stream = _events(spark, sf).select(F.col("event_type").alias("kind"), "event_id")
    E.ingest_documents(stream, lambda batch: batch, into, files.shared_folder(spark, "ingest-checkpoint")).awaitTermination()
    return into.rows().groupBy("kind").agg(F.count("*").alias("rows")).join(into.pointers().select("kind", "status"), "kind")
