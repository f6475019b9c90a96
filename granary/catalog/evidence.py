"""Evidence, memory and retrieval details, each over whole tables with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.catalog import Catalog, table
from granary.functions import numbers as N
from granary.functions import text as X
from granary.operators import embedding, memory, splitting, verify
from granary.operators import retrieval as R
from granary.operators import routing as RO
from granary.sources.files import shared_folder

QUERIES = Catalog()


@QUERIES.add("SELECT l_orderkey AS task_id, CASE WHEN l_orderkey % 5 <> 0 THEN CAST(CAST(SUM(l_quantity) AS BIGINT) AS VARCHAR) END AS value, l_orderkey % 5 = 0 AS refused FROM lineitem GROUP BY l_orderkey")
def bound_calculations(spark: SparkSession, sf: str) -> DataFrame:
    """The quantities of each order, bound to the lines of a table and added up; of every fifth order one is stated wrongly."""
    number = lambda i: (i + 1).cast("string")
    items = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.col("l_quantity").cast("int"))).alias("q"))
    rows = F.array_join(F.transform("q", lambda q, i: F.concat(F.lit("| L"), number(i), F.lit(" | "), q.cast("string"), F.lit(" | 7 |"))), "\n")
    wrong = (F.col("l_orderkey") % 5 == 0).cast("int")
    stated = lambda q, i: (q + F.when(i == 0, wrong).otherwise(0)).cast("string")
    records = F.transform("q", lambda q, i: F.struct(F.concat(F.lit("v"), number(i)).alias("key"), F.lit(1).alias("source_index"), F.concat(F.lit("L"), number(i)).alias("record_id"), F.lit("Quantity").alias("field"), stated(q, i).alias("value")))
    evidence = F.array(F.struct(F.lit(1).alias("index"), F.concat(F.lit("| Line | Quantity (units) | Page |\n| --- | --- | --- |\n"), rows).alias("text")))
    tasks = items.select(F.col("l_orderkey").alias("task_id"), F.array_join(F.transform("q", lambda q, i: F.concat(F.lit("v"), number(i))), " + ").alias("expression"), records.alias("records"), evidence.alias("evidence"))
    return verify.check_calculations(tasks).select("task_id", "value", F.col("reason").isNotNull().alias("refused"))


def _answers(spark: SparkSession, sf: str) -> DataFrame:
    """Messages whose lines cite source 1, the last also source 2."""
    c = table(spark, sf, "conversations")
    cited = F.concat(F.replace("text", F.lit("\n"), F.lit(" [1]\n")), F.lit(" [2][1]"))
    return c.select(F.struct("conv_id", "turn").alias("answer_id"), cited.alias("answer"), "text")


_LINES = "WITH l AS (SELECT conv_id, turn, text AS whole, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n, len(string_split(text, chr(10))) AS last FROM conversations)"


@QUERIES.add(_LINES + " SELECT conv_id, turn, CAST(n AS BIGINT) AS claim, trim(line || CASE WHEN n = last THEN ' [2][1]' ELSE ' [1]' END) AS text, CASE WHEN n = last THEN '2,1' ELSE '1' END AS refs FROM l")
def answer_claims(spark: SparkSession, sf: str) -> DataFrame:
    found = verify.claims(_answers(spark, sf))
    return found.select("answer_id.conv_id", "answer_id.turn", F.col("claim").cast("long").alias("claim"), "text", F.array_join(F.transform("refs", lambda r: r.cast("string")), ",").alias("refs"))


@QUERIES.add(_LINES + """ SELECT conv_id, turn, CAST(n AS BIGINT) AS claim, CASE WHEN turn % 3 = 0 THEN CASE WHEN (n < last OR turn % 2 = 0) AND trim(substr(whole, 1, 12)) <> '' AND (n < last OR trim(substr(upper(whole), 1, 12)) <> '') THEN 'supported' ELSE 'not_checked' END
WHEN turn % 3 = 1 THEN CASE WHEN trim(substr(whole, 1, 12)) <> '' AND (n < last OR turn % 2 = 1 OR trim(substr(upper(whole), 1, 12)) <> '') THEN 'contradicted' ELSE 'not_checked' END ELSE 'not_checked' END AS status FROM l""")
def quote_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Verdicts whose quotes are in their sources (or, for every third message, are not); the last line's second source is quoted in even turns."""
    answers = _answers(spark, sf)
    found = verify.claims(answers)
    evidence = answers.select("answer_id", F.explode(F.array(F.struct(F.lit(1).alias("index"), F.col("text").alias("text")), F.struct(F.lit(2).alias("index"), F.upper("text").alias("text")))).alias("e")).select("answer_id", "e.index", "e.text")
    turn = F.col("answer_id.turn")
    start = lambda c: F.substring(c, 1, 12)
    first = F.struct(F.lit(1).alias("index"), F.when(turn % 3 == 2, F.concat(start(F.col("answer")), F.lit("\x00"))).otherwise(start(F.col("whole"))).alias("text"))
    second = F.struct(F.lit(2).alias("index"), start(F.upper("whole")).alias("text"))
    said = found.join(answers.select("answer_id", "answer", F.col("text").alias("whole")), "answer_id")
    quotes = F.when((F.size("refs") == 2) & (turn % 2 == 0), F.array(first, second)).otherwise(F.array(first))
    verdicts = said.select("answer_id", "claim", F.when(turn % 3 == 1, "contradicted").otherwise("supported").alias("status"), quotes.alias("quotes"))
    judged = verify.quote_status(found, verdicts, evidence)
    return judged.select("answer_id.conv_id", "answer_id.turn", F.col("claim").cast("long").alias("claim"), "status")


@QUERIES.add("""WITH e AS (SELECT doc_id, text, doc_id % 3 = 0 AS odd, string_split(text, chr(10)) AS ls FROM documents), l AS (SELECT doc_id, odd, unnest(ls) AS line, generate_subscripts(ls, 1) AS n, len(ls) AS last FROM e)
SELECT doc_id AS document_id, CAST(n AS BIGINT) AS ordinal, length(c) AS chars, strlen(c) AS bytes FROM (SELECT doc_id, n, CASE WHEN odd AND n = last THEN line || ' changed' ELSE line END AS c FROM l)""")
def embedding_resumed(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of all documents embedded (by their sizes): interrupted after two of four rounds, then, with every third document's last line
    changed, taken up again. The table is the one that a single run gives."""
    lines = table(spark, sf, "documents").select(F.col("doc_id").alias("document_id"), F.posexplode(F.split("text", "\n")).alias("ordinal", "content"), F.size(F.split("text", "\n")).alias("last"))
    chunks = lines.select("document_id", (F.col("ordinal") + 1).cast("long").alias("ordinal"), "content", "last")
    last = (F.col("document_id") % 3 == 0) & (F.col("ordinal") == F.col("last"))
    now = chunks.withColumn("content", F.when(last, F.concat("content", F.lit(" changed"))).otherwise(F.col("content")))
    into, rounds = embedding.store(spark, shared_folder(spark, "vectors")), []

    class Interrupted(Exception):
        pass

    def vector(part: DataFrame) -> DataFrame:
        return part.withColumn("vector", F.array(F.length("content").cast("double"), F.octet_length("content").cast("double")))

    def stops(part: DataFrame) -> DataFrame:
        rounds.append(1)
        if len(rounds) > 2:
            raise Interrupted
        return vector(part)

    try:
        embedding.resume(chunks.drop("last"), into, stops, rounds=4)
    except Interrupted:
        embedding.resume(now.drop("last"), into, vector, rounds=4)
    return into.rows().select("document_id", "ordinal", F.col("vector")[0].cast("long").alias("chars"), F.col("vector")[1].cast("long").alias("bytes"))


_SAID = """WITH m AS (SELECT conv_id, turn, length(text) AS n, CASE WHEN turn % 4 IN (0, 1) THEN CASE WHEN turn % 4 = 1 AND conv_id % 2 = 0 THEN '乙项目' ELSE '甲项目' END WHEN turn % 4 = 3 THEN '甲项目' ELSE '' END AS scope, CASE WHEN turn % 4 = 3 THEN '负责人' ELSE '预算' END AS field FROM conversations)"""


@QUERIES.add(_SAID + """, f AS (SELECT conv_id, turn, scope || field AS key, scope, CASE WHEN field = '负责人' THEN 'P' || n ELSE n || '元' END AS value, turn % 4 = 2 AND (SELECT COUNT(DISTINCT o.scope) FROM m o WHERE o.conv_id = m.conv_id AND o.turn < m.turn AND o.field = m.field AND o.scope <> '') > 1 AS held FROM m),
v AS (SELECT *, lag(value) OVER (PARTITION BY conv_id, key ORDER BY turn) AS before FROM f WHERE NOT held), c AS (SELECT * FROM v WHERE before IS NULL OR before <> value)
SELECT conv_id AS session_id, turn AS seq, key AS label, value, scope, CASE WHEN lead(turn) OVER (PARTITION BY conv_id, key ORDER BY turn) IS NULL THEN 'ACTIVE' ELSE 'SUPERSEDED' END AS status FROM c""")
def memory_scopes(spark: SparkSession, sf: str) -> DataFrame:
    return _remembered(spark, sf).select("session_id", "seq", "label", "value", "scope", "status")


def _remembered(spark: SparkSession, sf: str) -> DataFrame:
    """Budgets and owners of one or two projects a conversation, and corrections that name no project: held back where two have a budget."""
    c, n = table(spark, sf, "conversations"), F.length("text").cast("string")
    kind = F.pmod("turn", F.lit(4))
    other = F.when((kind == 1) & (F.col("conv_id") % 2 == 0), "乙项目").otherwise("甲项目")
    content = F.when(kind < 2, F.concat(other, F.lit("的预算："), n, F.lit("元。"))).when(kind == 2, F.concat(F.lit("更正：预算改为"), n, F.lit("元。"))).otherwise(F.concat(F.lit("甲项目负责人是P"), n))
    return memory.remembered(c.select(F.col("conv_id").alias("session_id"), F.col("turn").alias("seq"), F.lit("user").alias("role"), content.alias("content")))


@QUERIES.add(_SAID + """, f AS (SELECT conv_id, scope || field AS label, arg_max(CASE WHEN field = '负责人' THEN 'P' || n ELSE n || '元' END, turn) AS value FROM m WHERE scope = '甲项目' GROUP BY ALL)
SELECT conv_id AS session_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY label DESC) AS BIGINT) AS rank, '- ' || label || ': ' || value || chr(10) AS line FROM f""")
def memory_recall(spark: SparkSession, sf: str) -> DataFrame:
    """What each conversation recalls when the first project's budget is asked for: its facts only, the budget first."""
    found = memory.recalled(_remembered(spark, sf).where("status = 'ACTIVE'"), "甲项目的经费上限是多少")
    return found.select("session_id", F.col("rank").cast("long").alias("rank"), "line")


@QUERIES.add("""WITH e AS (SELECT user_id AS session_id, event_id AS seq, event_type AS field, CAST(CAST(floor(value / 50) AS BIGINT) AS VARCHAR) AS value FROM events), o AS (SELECT session_id, 'e' || seq AS id, field AS key, field, value, seq, CASE WHEN seq % 200 = 0 THEN 'MANUAL' ELSE 'USER_MESSAGE' END AS origin FROM e),
g AS (SELECT DISTINCT session_id, 'click' AS key FROM e WHERE session_id % 5 = 0 UNION SELECT session_id, key FROM o WHERE origin = 'MANUAL'), f AS (SELECT session_id, CASE WHEN seq % 3 = 0 THEN field ELSE field || '@p' END AS key, field, value, seq FROM e WHERE seq % 200 <> 0 AND seq % 7 <> 0),
i AS (SELECT f.* FROM f ANTI JOIN g ON g.session_id = f.session_id AND (g.key = f.key OR g.key = f.field)), w AS (SELECT i.session_id, coalesce(o.id, sha256(concat_ws(chr(31), i.session_id, i.key, i.value, i.seq))) AS id, i.key, i.field, i.value, i.seq FROM i LEFT JOIN o ON o.origin <> 'MANUAL' AND o.session_id = i.session_id AND o.key = i.key AND o.value = i.value AND o.seq = i.seq)
SELECT session_id, id, key, value, seq, 'USER_MESSAGE' AS origin, 'ACTIVE' AS status, NULL AS superseded_by FROM w UNION ALL SELECT session_id, id, key, value, seq, origin, 'ACTIVE', NULL FROM o WHERE origin = 'MANUAL'
UNION ALL SELECT o.session_id, o.id, o.key, o.value, o.seq, o.origin, 'SUPERSEDED', w.id FROM o LEFT JOIN w ON w.session_id = o.session_id AND w.seq = o.seq AND w.field = o.field WHERE o.origin <> 'MANUAL' AND NOT EXISTS (SELECT 1 FROM i WHERE i.session_id = o.session_id AND i.key = o.key AND i.value = o.value AND i.seq = o.seq)""")
def memory_reread(spark: SparkSession, sf: str) -> DataFrame:
    """Stored facts against a newer reading of their messages, with manual ones and deletions; the result is what a second run leaves too."""
    e = table(spark, sf, "events").select(F.col("user_id").alias("session_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("field"), F.floor(F.col("value") / 50).cast("string").alias("value"))
    old = e.select("session_id", F.concat(F.lit("e"), F.col("seq").cast("string")).alias("id"), F.col("field").alias("key"), "field", "value", "seq", F.when(F.col("seq") % 200 == 0, "MANUAL").otherwise("USER_MESSAGE").alias("origin"), F.lit("ACTIVE").alias("status"))
    fresh = e.where("seq % 200 <> 0 and seq % 7 <> 0").select("session_id", F.when(F.col("seq") % 3 == 0, F.col("field")).otherwise(F.concat("field", F.lit("@p"))).alias("key"), "field", "value", "seq", F.lit("ACTIVE").alias("status"))
    gone = e.where("session_id % 5 = 0").select("session_id", F.lit("click").alias("key")).distinct()
    again = memory.reextracted(memory.reextracted(old, fresh, gone).drop("superseded_by"), fresh, gone)
    return again.select("session_id", "id", "key", "value", "seq", "origin", "status", "superseded_by")


@QUERIES.add("""WITH f AS (SELECT user_id AS session_id, event_type AS key, event_id AS seq FROM events), c AS (SELECT user_id AS session_id, event_type AS key, event_id AS seq, CASE WHEN event_id % 50 = 0 THEN 'FORGET' ELSE 'ALLOW' END AS action FROM events WHERE event_id % 25 = 0)
SELECT * FROM f WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.session_id = f.session_id AND c.key = f.key AND c.action = 'FORGET' AND c.seq > f.seq) AND coalesce((SELECT arg_max(action, c.seq) FROM c WHERE c.session_id = f.session_id AND c.key = f.key AND c.seq <= f.seq), '') <> 'FORGET'""")
def memory_forgotten(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select(F.col("user_id").alias("session_id"), F.col("event_type").alias("key"), F.col("event_id").alias("seq"))
    return memory.forget(e, e.where("seq % 25 = 0").select("session_id", "seq", F.when(F.col("seq") % 50 == 0, "FORGET").otherwise("ALLOW").alias("action"), "key"))


_TERM = r"[a-z][a-z0-9_]{8,48}"


@QUERIES.add(f"""WITH d AS (SELECT DISTINCT doc_id, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_TERM}')) AS term FROM documents), q AS (SELECT DISTINCT conv_id, turn, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_TERM}')) AS term FROM conversations WHERE role = 'user'),
w AS (SELECT term, 3 * (1 + ln(1 + (SELECT COUNT(*) FROM documents) / COUNT(*))) AS w FROM d GROUP BY term), s AS (SELECT conv_id, turn, doc_id, source, SUM(w) AS score, COUNT(*) AS matches FROM q JOIN d USING (term) JOIN w USING (term) GROUP BY ALL),
c AS (SELECT conv_id, turn, source, MAX(score) AS score, arg_max(matches, {{'a': score, 'b': matches}}) AS matches FROM s GROUP BY ALL), n AS (SELECT *, row_number() OVER o AS place, lead(score) OVER o AS next, first_value(score) OVER o AS best FROM c WINDOW o AS (PARTITION BY conv_id, turn ORDER BY round(score, 9) DESC, source))
SELECT conv_id, turn, bool_or(place = 1 AND score >= 4 AND (matches >= 2 OR score >= 5) AND (next IS NULL OR round(score, 9) >= round(1.25 * next, 9))) AS strong, any_value(source) FILTER (place = 1) AS top FROM n GROUP BY ALL""")
def topics_of_questions(spark: SparkSession, sf: str) -> DataFrame:
    """The collections of every user turn by its long words."""
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(_TERM), F.lit(0)))
    profiles = table(spark, sf, "documents").select(F.col("doc_id").alias("document_id"), F.col("source").alias("collection_id"), words(F.col("text")).alias("terms"), F.array().cast("array<string>").alias("metadata_terms"))
    asked = table(spark, sf, "conversations").where("role = 'user'").select(F.struct("conv_id", "turn").alias("question_id"), words(F.col("text")).alias("terms"))
    ranked = RO.rank_for_questions(asked, profiles).withColumn("score", F.round("score", 9))
    return RO.choose_strong(ranked).select("question_id.conv_id", "question_id.turn", "strong", F.col("topics")[0].alias("top"))


@QUERIES.add("SELECT p_partkey AS id, p_size FROM part WHERE p_size % 9 = 2 ORDER BY p_size, p_partkey LIMIT 8")
def caption_anchors(spark: SparkSession, sf: str) -> DataFrame:
    caption = F.concat(F.lit("Sizes of parts.\nTable "), (F.col("p_size") % 9 + 1).cast("string"), F.lit("\n| a | b |"))
    chunks = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("ordinal"), caption.alias("content"), "p_size")
    return R.anchored_tables(chunks, "what does table 3 say").select("id", "p_size")


@QUERIES.add("SELECT p_partkey AS id, CAST(row_number() OVER (ORDER BY p_name IN ('red widget', 'blue bolt') DESC, p_partkey) AS BIGINT) AS place FROM part QUALIFY place <= 40")
def named_rows_first(spark: SparkSession, sf: str) -> DataFrame:
    content = F.concat(F.lit("| name | price |\n| --- | --- |\n| "), "p_name", F.lit(" | "), F.col("p_retailprice").cast("string"), F.lit(" |"))
    parts = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_partkey").alias("rank"), content.alias("content"))
    first = R.exact_rows_first(parts, "the price of a Red Widget, and blue bolt?", 40)
    from pyspark.sql import Window

    named = F.regexp_extract("content", r"\| (red widget|blue bolt) \|", 1) != ""
    return first.select("id", F.row_number().over(Window.orderBy(F.desc(named), "rank")).cast("long").alias("place"))  # of forty rows


@QUERIES.add("SELECT doc_id AS id, (length(text) % 100) / 100.0 AS score FROM documents WHERE length(text) % 100 >= 15 ORDER BY score DESC, doc_id LIMIT 20")
def reranked(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("doc_id").alias("rank"), "text")
    return R.rerank(d, lambda t: F.length(t) % 100 / F.lit(100.0)).select("id", "score")


@QUERIES.add("SELECT conv_id, turn, '根据我上传的文档，' || text AS raw, CASE WHEN trim(text) = '' THEN '根据我上传的文档，' || text ELSE trim(text) END AS question, CASE WHEN turn % 2 = 0 THEN 'Page ' || turn || chr(10) ELSE '' END || 'Part' || chr(10) || text AS shown, replace(replace(replace(text, '\\', '\\\\'), chr(9), '\\t'), chr(10), '\\n') AS cell FROM conversations")
def question_forms(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("text")
    raw = F.concat(F.lit("根据我上传的文档，"), t)
    shown = X.retrieval_text(t, F.when(F.col("turn") % 2 == 0, F.col("turn")), F.lit("Part"))
    there_and_back = X.escape_cell(X.unescape_cell(X.escape_cell(t)))
    return table(spark, sf, "conversations").select("conv_id", "turn", raw.alias("raw"), X.normal_query(raw).alias("question"), shown.alias("shown"), there_and_back.alias("cell"))


@QUERIES.add("SELECT o_orderkey, CAST(CAST(CASE WHEN o_orderkey % 3 = 0 THEN -1 ELSE 1 END * CAST(o_totalprice AS DECIMAL(18,2)) AS DECIMAL(38,10)) AS VARCHAR) AS value FROM orders")
def claimed_numbers(spark: SparkSession, sf: str) -> DataFrame:
    cents = F.format_number(F.col("o_totalprice").cast("decimal(18,2)"), 2)
    said = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("**("), cents, F.lit(")**"))).otherwise(F.concat(F.lit("**"), cents, F.lit("** ")))
    return table(spark, sf, "orders").select("o_orderkey", N.claim_number(said).cast("string").alias("value"))


@QUERIES.add("SELECT CAST(0 AS BIGINT) AS broken, CAST(0 AS BIGINT) AS too_long, COUNT(*) AS documents FROM documents WHERE regexp_matches(text, '\\S')")
def recursive_chunks_exact(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    c = splitting.recursive_chunks(d, 400, 40).join(d.select("doc_id", "text"), "doc_id")
    exact = F.col("content") == F.substring("text", F.col("start") + 1, F.col("end") - F.col("start"))
    return c.agg(F.count_if(~exact).alias("broken"), F.count_if(F.length("content") > 440).alias("too_long"), F.count_distinct("doc_id").alias("documents"))


@QUERIES.add(None)
def recursive_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return splitting.recursive_chunks(table(spark, sf, "documents"), 400, 40)
