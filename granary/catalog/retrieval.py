"""Dense and lexical retrieval, fusion, routing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.catalog import Catalog, table
from granary.functions import text as X
from granary.operators import names as NM
from granary.operators import postings as P
from granary.operators import retrieval as R
from granary.operators import routing as RO
from granary.sources.files import shared_folder

QUERIES = Catalog()
#: A fixed query vector: 64 numbers by a rule.
_QUERY = [((7 * i) % 13 - 6) / 6 for i in range(64)]
_Q = "[" + ", ".join(f"{x!r}::DOUBLE" for x in _QUERY) + "]"
_COS = f"(list_dot_product(CAST(embedding AS DOUBLE[]), {_Q}) / (sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) * sqrt(list_dot_product({_Q}, {_Q}))))"
_TERMS = ["the", "thand", "ther", "erheen", "tion", "with", "for", "anth"]
_IN = "(" + ", ".join(f"'{t}'" for t in _TERMS) + ")"


@QUERIES.add(f"SELECT vec_id AS id, round({_COS}, 6) AS score FROM embeddings ORDER BY {_COS} DESC, vec_id LIMIT 10")
def vec_topk(spark: SparkSession, sf: str) -> DataFrame:
    return R.dense_topk(table(spark, sf, "embeddings"), _QUERY, 10, min_score=-1, id_col="vec_id").select("id", F.round("score", 6).alias("score"))


@QUERIES.add(f"SELECT id, round(s, 6) AS score FROM (SELECT vec_id AS id, {_COS} AS s FROM embeddings WHERE label IN (1, 3, 5) ORDER BY s DESC, vec_id LIMIT 30) WHERE s >= 0.1 ORDER BY s DESC, id LIMIT 10")
def vec_topk_min_score(spark: SparkSession, sf: str) -> DataFrame:
    out = R.dense_topk(table(spark, sf, "embeddings"), _QUERY, 10, min_score=0.1, id_col="vec_id", scope=R.Scope(collections=(1, 3, 5)).condition("label"), over=3)
    return out.select("id", F.round("score", 6).alias("score"))


@QUERIES.add(f"SELECT label, id, CAST(rank AS BIGINT) AS rank FROM (SELECT label, vec_id AS id, row_number() OVER (PARTITION BY label ORDER BY {_COS} DESC, vec_id) AS rank FROM embeddings) WHERE rank <= 3")
def vec_per_label_topk(spark: SparkSession, sf: str) -> DataFrame:
    scored = table(spark, sf, "embeddings").select("label", F.col("vec_id").alias("id"), X.cosine(F.col("embedding"), F.array(*map(F.lit, _QUERY))).alias("score"))
    return R.topk_by_group(scored, "label", 3).select("label", "id", F.col("rank").cast("long").alias("rank"))


@QUERIES.add("""WITH q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id % 100 = 0),
s AS (SELECT query_id, vec_id AS id, list_dot_product(CAST(embedding AS DOUBLE[]), v) / (sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) * sqrt(list_dot_product(v, v))) AS score FROM embeddings CROSS JOIN q)
SELECT query_id, id, CAST(rank AS BIGINT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s WHERE score >= 0.3) WHERE rank <= 5""")
def vec_queries_topk(spark: SparkSession, sf: str) -> DataFrame:
    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    queries = v.where("id % 100 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("q"))
    return R.blocked_topk(v, queries, 5).select("query_id", "id", F.col("rank").cast("long").alias("rank"))


@QUERIES.add("""WITH q AS (SELECT vec_id AS question_id, 0 AS branch, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id % 100 = 0 UNION ALL SELECT vec_id, 1, list_reverse(CAST(embedding AS DOUBLE[])) FROM embeddings WHERE vec_id % 100 = 0),
s AS (SELECT question_id, branch, vec_id AS id, list_dot_product(CAST(embedding AS DOUBLE[]), v) / (sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) * sqrt(list_dot_product(v, v))) AS score FROM embeddings CROSS JOIN q),
r AS (SELECT *, row_number() OVER (PARTITION BY question_id, branch ORDER BY score DESC, id) AS place FROM s WHERE score >= 0.2), o AS (SELECT question_id, id, min({'p': place, 'b': branch}) AS w FROM r WHERE place <= 6 GROUP BY ALL)
SELECT question_id, rank, id FROM (SELECT question_id, CAST(row_number() OVER (PARTITION BY question_id ORDER BY w.p, w.b, id) AS BIGINT) AS rank, id FROM o) WHERE rank <= 8""")
def vec_fan_out(spark: SparkSession, sf: str) -> DataFrame:
    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    asked = v.where("id % 100 = 0").select(F.col("id").alias("question_id"), F.posexplode(F.array("embedding", F.reverse("embedding"))).alias("branch", "q"))
    return R.fan_out(v, asked, 8, per_branch=6, min_score=0.2).select("question_id", F.col("rank").cast("long").alias("rank"), "id")


#: Bigrams that don't overlap themselves, so that SQL can count them by replacing them.
_PAIRS = ["th", "he", "in", "ng", "an", "nd", "er", "ou"]


@QUERIES.add(f"""WITH t AS (SELECT unnest({_PAIRS}) AS term), i AS (SELECT doc_id AS id, term, (length(text) - length(replace(lower(text), term, ''))) // 2 AS tf FROM documents, t), f AS (SELECT * FROM i WHERE tf > 0),
d AS (SELECT term, COUNT(*) AS df FROM f GROUP BY term) SELECT id, round(SUM(3 * (1 + ln(1 + (SELECT COUNT(*) FROM documents) / df)) * tf), 6) AS score FROM f JOIN d USING (term) GROUP BY id ORDER BY score DESC, id LIMIT 20""")
def bigram_topk(spark: SparkSession, sf: str) -> DataFrame:
    """Three batches of documents are indexed one after another, due merges made, and the blocks of eight bigrams searched."""
    index = P.Postings(spark, shared_folder(spark, "bigrams"))
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    for part in range(3):
        index.add(docs.where(F.pmod("id", F.lit(3)) == part), P.bigrams)
        index.merge()
    return index.topk(_PAIRS, 20).select("id", F.round("score", 6).alias("score"))


_NAMED_DOCS = "SELECT doc_id AS document_id, source AS collection_id, lower(regexp_extract(text, '[A-Za-z]{5,}')) AS filename, CASE WHEN doc_id % 7 = 0 THEN 'FAILED' ELSE 'READY' END AS status FROM documents"


@QUERIES.add(f"""WITH d AS MATERIALIZED ({_NAMED_DOCS}), q AS (SELECT conv_id, turn, lower(text) AS t FROM conversations WHERE role = 'user'), f AS MATERIALIZED (SELECT DISTINCT filename FROM d WHERE filename <> ''),
c AS MATERIALIZED (SELECT collection_id, min(filename) AS name FROM d WHERE filename <> '' GROUP BY 1), h AS MATERIALIZED (SELECT conv_id, turn, filename FROM q, f WHERE contains(t, filename)), k AS (SELECT DISTINCT conv_id, turn, collection_id FROM q, c WHERE contains(t, name)),
x AS MATERIALIZED (SELECT conv_id, turn, d.* FROM h JOIN d USING (filename)), m AS (SELECT conv_id, turn, COUNT(*) AS n, COUNT(DISTINCT filename) AS names, COUNT(*) FILTER (status = 'READY') AS ready, list(document_id ORDER BY document_id) AS docs, any_value(status) AS status FROM x GROUP BY ALL),
u AS (SELECT conv_id, turn, COUNT(*) AS n, any_value(document_id) AS doc, any_value(status) AS status FROM x SEMI JOIN k USING (conv_id, turn, collection_id) GROUP BY ALL), p AS (SELECT conv_id, turn, COUNT(*) AS n, any_value(document_id) AS doc, any_value(status) AS status FROM x WHERE document_id BETWEEN conv_id AND conv_id + 20 GROUP BY ALL),
n AS (SELECT DISTINCT conv_id, turn FROM k SEMI JOIN (SELECT collection_id FROM d WHERE status = 'READY') USING (collection_id)),
r AS (SELECT q.conv_id, q.turn, CASE WHEN m.n = m.names AND m.n > 1 THEN CASE WHEN m.ready = m.n THEN 'document' ELSE 'not_ready' END WHEN coalesce(CASE WHEN m.n = 1 THEN m.status END, CASE WHEN u.n = 1 THEN u.status END, CASE WHEN p.n = 1 THEN p.status END) = 'READY' THEN 'document'
 WHEN m.n = 1 OR u.n = 1 OR p.n = 1 THEN 'not_ready' WHEN m.n > 1 THEN 'ambiguous' WHEN n.conv_id IS NOT NULL THEN 'collection_topic' ELSE 'semantic' END AS reason, m.n > 1 AND m.n = m.names AS several, m.docs AS all_docs, CASE WHEN m.n = 1 THEN m.docs[1] WHEN u.n = 1 THEN u.doc ELSE p.doc END AS one
 FROM q LEFT JOIN m USING (conv_id, turn) LEFT JOIN u USING (conv_id, turn) LEFT JOIN p USING (conv_id, turn) LEFT JOIN n USING (conv_id, turn))
SELECT conv_id, turn, reason, reason IN ('document', 'not_ready', 'ambiguous') AS strict, CASE WHEN reason <> 'document' THEN '' WHEN several THEN array_to_string(all_docs, ',') ELSE CAST(one AS VARCHAR) END AS documents FROM r""")
def named_routing(spark: SparkSession, sf: str) -> DataFrame:
    """Every user turn against a catalogue of all documents, named by their first long words, and of their sources."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("document_id"), F.col("source").alias("collection_id"), F.lower(F.regexp_extract("text", "[A-Za-z]{5,}", 0)).alias("filename"), F.when(F.col("doc_id") % 7 == 0, "FAILED").otherwise("READY").alias("status"))
    collections = docs.where("filename <> ''").groupBy("collection_id").agg(F.min("filename").alias("name"))
    asked = table(spark, sf, "conversations").where("role = 'user'").select(F.struct("conv_id", "turn").alias("question_id"), F.col("text").alias("question"), F.lit("").alias("previous"), F.sequence("conv_id", F.col("conv_id") + 20).alias("prior_documents"), F.array().cast("array<string>").alias("prior_collections"), F.lit(False).alias("prior_strict"))
    found = NM.named_scope(asked, docs, collections)
    return found.select("question_id.conv_id", "question_id.turn", "reason", "strict", F.array_join(F.transform("documents", lambda d: d.cast("string")), ",").alias("documents"))


@QUERIES.add("SELECT label, COUNT(*) AS vectors, COUNT(*) FILTER (len(embedding) = 64) AS valid FROM embeddings GROUP BY label")
def vec_validation(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").groupBy("label").agg(F.count("*").alias("vectors"), F.count_if(X.valid_vector(F.col("embedding"), 64)).alias("valid"))


_LEXICAL = f"""WITH w AS (SELECT doc_id AS id, unnest(regexp_extract_all(text, '[a-zA-Z][a-zA-Z0-9_]{{1,48}}')) AS w FROM documents), i AS (SELECT id, lower(w) AS term, COUNT(*) AS tf FROM w WHERE lower(w) IN {_IN} AND lower(w) NOT IN ('the', 'with') GROUP BY ALL),
d AS (SELECT term, COUNT(*) AS df FROM i GROUP BY term), s AS (SELECT id, SUM(3 * (1 + ln(1 + (SELECT COUNT(*) FROM documents) / df)) * tf) AS score FROM i JOIN d USING (term) GROUP BY id) """


@QUERIES.add(_LEXICAL + "SELECT id, round(score, 6) AS score FROM s ORDER BY s.score DESC, id LIMIT 20")
def lexical_topk(spark: SparkSession, sf: str) -> DataFrame:
    return R.lexical_topk(table(spark, sf, "documents"), _TERMS, 20, id_col="doc_id").select("id", F.round("score", 6).alias("score"))


@QUERIES.add(_LEXICAL + f"""SELECT id, round(SUM(part), 9) AS score FROM (SELECT id, 1 / (60 + row_number() OVER (ORDER BY score DESC, id)) AS part FROM (SELECT * FROM s ORDER BY score DESC, id LIMIT 30)
UNION ALL SELECT id, 1 / (60 + row_number() OVER (ORDER BY score DESC, id)) FROM (SELECT vec_id AS id, {_COS} AS score FROM embeddings ORDER BY score DESC, vec_id LIMIT 30)) GROUP BY id""")
def rrf_fusion(spark: SparkSession, sf: str) -> DataFrame:
    lexical = R.lexical_topk(table(spark, sf, "documents"), _TERMS, 30, id_col="doc_id")
    dense = R.dense_topk(table(spark, sf, "embeddings"), _QUERY, 30, min_score=-1, id_col="vec_id")
    return R.fuse(lexical, dense).select("id", F.round("score", 9).alias("score"))


@QUERIES.add("""WITH b AS (SELECT 0 AS branch, doc_id AS id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank FROM documents UNION ALL SELECT 1, doc_id, row_number() OVER (ORDER BY doc_id) FROM documents),
m AS (SELECT id, min(struct_pack(r := rank, b := branch)) AS p FROM b WHERE rank <= 20 GROUP BY id) SELECT id, CAST(p.r AS BIGINT) AS rank, p.b AS branch FROM m ORDER BY p.r, p.b, id LIMIT 15""")
def interleave_branches(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    lists = [d.orderBy(F.desc("n_chars"), "doc_id").limit(20), d.orderBy("doc_id").limit(20)]
    from pyspark.sql import Window

    orders = [Window.orderBy(F.desc("n_chars"), "doc_id"), Window.orderBy("doc_id")]  # of twenty rows
    b = [x.select(F.lit(i).alias("branch"), F.col("doc_id").alias("id"), F.row_number().over(o).cast("long").alias("rank")) for i, (x, o) in enumerate(zip(lists, orders, strict=True))]
    return R.interleave(b[0].union(b[1]), 15)


@QUERIES.add("""WITH h AS (SELECT doc_id AS id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank FROM documents ORDER BY rank LIMIT 40) SELECT d.doc_id AS id, h.rank FROM h JOIN documents d ON d.doc_id = h.id WHERE d.source IN ('src1', 'src2', 'src3', 'src4', 'src5') AND EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) ORDER BY rank LIMIT 10""")
def scoped_load(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    d = table(spark, sf, "documents")
    hits = d.orderBy(F.desc("n_chars"), "doc_id").limit(40).select(F.col("doc_id").alias("id"), F.row_number().over(Window.orderBy(F.desc("n_chars"), "doc_id")).cast("long").alias("rank"))
    chunks = d.select(F.col("doc_id").alias("id"), F.col("source").alias("collection_id"), F.col("doc_id").alias("document_id"))
    ready = table(spark, sf, "labels").select(F.col("doc_id").alias("document_id"))
    return R.load(hits, chunks, ready, 40, R.Scope(collections=("src1", "src2", "src3", "src4", "src5"))).limit(10).select("id", "rank")


@QUERIES.add("""WITH RECURSIVE o AS (SELECT conv_id, turn, CAST(length(text) AS BIGINT) AS size, row_number() OVER (PARTITION BY conv_id ORDER BY turn, length(text)) AS n FROM conversations),
r AS (SELECT conv_id, turn, size, n, size <= 1500 AS taken, CASE WHEN size <= 1500 THEN size ELSE 0 END AS used FROM o WHERE n = 1 UNION ALL SELECT o.conv_id, o.turn, o.size, o.n, used + o.size <= 1500, used + CASE WHEN used + o.size <= 1500 THEN o.size ELSE 0 END FROM r JOIN o ON o.conv_id = r.conv_id AND o.n = r.n + 1)
SELECT conv_id, turn, size FROM r WHERE taken""")
def evidence_budget(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations").select("conv_id", "turn", F.length("text").cast("long").alias("size"))
    return R.within_budget(c, "conv_id", ["turn"], "size", 1500)


_PROFILE = """WITH w AS (SELECT doc_id, source, unnest(regexp_extract_all(text, '[a-zA-Z][a-zA-Z0-9_]{1,48}')) AS w FROM documents), i AS (SELECT DISTINCT doc_id, source, lower(w) AS term FROM w WHERE lower(w) IN ('idiot', 'ther', 'tion', 'thand', 'onthe')),
d AS (SELECT term, COUNT(*) AS df FROM i GROUP BY term), s AS (SELECT doc_id, source, SUM(3 * (1 + ln(1 + (SELECT COUNT(*) FROM documents) / df))) AS score, COUNT(*) AS matches FROM i JOIN d USING (term) GROUP BY ALL) """


@QUERIES.add(_PROFILE + "SELECT source AS collection_id, round(MAX(score), 6) AS score FROM s GROUP BY source")
def collection_ranking(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("document_id"), F.col("source").alias("collection_id"), X.routing_terms(F.col("text")).alias("terms"), F.array().cast("array<string>").alias("metadata_terms"))
    return RO.rank_collections(d, ["idiot", "ther", "tion", "thand", "onthe"]).select("collection_id", F.round("score", 6).alias("score"))


_STOP = "(" + ", ".join(f"'{w}'" for w in X.STOP) + ")"


@QUERIES.add(f"SELECT term, COUNT(*) AS df FROM (SELECT DISTINCT doc_id, lower(unnest(regexp_extract_all(text, '[a-zA-Z][a-zA-Z0-9_]{{1,48}}'))) AS term FROM documents) WHERE term NOT IN {_STOP} GROUP BY term")
def document_frequency(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "documents").select(F.col("doc_id").alias("document_id"), X.routing_terms(F.col("text")).alias("terms"))
    return RO.document_frequency(p)


@QUERIES.add(f"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z][a-z0-9_]{{1,48}}')) AS term FROM documents), c AS (SELECT doc_id, term, COUNT(*) AS n FROM w WHERE term NOT IN {_STOP} GROUP BY ALL)
SELECT doc_id AS document_id, list(term ORDER BY n DESC, term)[1:1800] AS terms FROM c GROUP BY doc_id""")
def document_profiles(spark: SparkSession, sf: str) -> DataFrame:
    return RO.document_profile(table(spark, sf, "documents"), id_col="doc_id")


def _has(pattern: str) -> str:
    return f"regexp_matches(m, '{pattern}')"


_SCORE = f"2 * {_has(RO.TIME_WORDS)}::INT + 2 * {_has(RO.LIVE_WORDS)}::INT + {_has(RO.RESEARCH_WORDS)}::INT + {_has(RO.SEVERAL_WORDS)}::INT + (length(m) > 80)::INT + (len(regexp_extract_all(m, '[?？]')) >= 2)::INT"


@QUERIES.add(f"""WITH t AS (SELECT conv_id, turn, text, trim(text) AS m FROM conversations), s AS (SELECT *, {_SCORE} AS score FROM t)
SELECT conv_id, turn, CASE WHEN m = '' THEN 'NONE' WHEN {_has(RO.LIVE_WORDS)} THEN 'STANDARD' WHEN length(m) < 4 AND NOT {_has("[?？]")} THEN 'NONE' WHEN {_has(RO.TRIVIAL_WORDS)} AND length(m) < 50 THEN 'NONE' WHEN score <= 1 THEN 'LIGHT' WHEN score <= 3 THEN 'STANDARD' ELSE 'DEEP' END AS budget,
CASE {" ".join(f"WHEN regexp_matches(text, '{words}') THEN '{name}'" for name, words in RO.TYPE_WORDS.items())} ELSE 'GENERAL' END AS kind, CASE {" ".join(f"WHEN regexp_matches(m, '{words}') THEN '{name}'" for name, words in RO.PLAN_WORDS.items() if name != "ARITHMETIC")} WHEN regexp_matches(m, '^[0-9.() +*/=?-]+$') AND regexp_matches(m, '[+*/-]') AND regexp_matches(m, '[0-9]') THEN 'ARITHMETIC' ELSE 'FULL' END AS plan,
CASE WHEN regexp_matches(text, '{X.PRIVATE}') THEN 'PRIVATE' WHEN regexp_matches(text, '{RO.LOCAL_WORDS}') THEN 'LOCAL_ONLY' WHEN regexp_matches(text, '{RO.WEB_WORDS}') THEN 'WEB' ELSE 'LOCAL_FIRST' END AS policy FROM s""")
def search_budgets(spark: SparkSession, sf: str) -> DataFrame:
    q = F.col("text")
    return table(spark, sf, "conversations").select("conv_id", "turn", RO.search_budget(q).alias("budget"), RO.query_type(q).alias("kind"), RO.simple_plan(q).alias("plan"), RO.evidence_policy(q, F.lit(True), F.lit(True)).alias("policy"))
