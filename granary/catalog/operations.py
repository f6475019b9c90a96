"""Operational analytics, joins and windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.catalog import Catalog, table
from granary.functions import text as X
from granary.operators import joins as J
from granary.operators import usage as U
from granary.sources import files as FS
from granary.streaming import events as E

QUERIES = Catalog()
_LAST = "2024-01-30"


@QUERIES.add("""SELECT CAST(d AS DATE) AS day, COALESCE(n, 0) AS events, COALESCE(u, 0) AS users FROM generate_series(DATE '2024-01-24', DATE '2024-01-30', INTERVAL 1 DAY) s(d)
LEFT JOIN (SELECT CAST(ts AS DATE) AS day, COUNT(*) AS n, COUNT(DISTINCT user_id) AS u FROM events GROUP BY 1) e ON CAST(d AS DATE) = e.day""")
def ops_trend_zero_filled(spark: SparkSession, sf: str) -> DataFrame:
    return U.daily_trend(table(spark, sf, "events"), F.to_date("ts"), _LAST, 7, events=F.count("*"), users=F.count_distinct("user_id"))


@QUERIES.add("SELECT event_type, COUNT(*) AS n FROM events GROUP BY 1")
def ops_type_distribution(spark: SparkSession, sf: str) -> DataFrame:
    return U.distribution(table(spark, sf, "events"), "event_type")


@QUERIES.add("SELECT COUNT(*) AS events, COUNT(*) FILTER (ts >= TIMESTAMP '2024-01-30') AS today, COUNT(*) FILTER (event_type = 'purchase') AS purchases, COUNT(DISTINCT user_id) AS users FROM events")
def ops_dashboard(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    counts = U.conditional_counts(e, events=F.lit(True), today=F.col("ts") >= F.lit(_LAST).cast("timestamp_ntz"), purchases=F.col("event_type") == "purchase")
    return counts.crossJoin(e.agg(F.count_distinct("user_id").alias("users")))  # one row each


@QUERIES.add("SELECT CASE event_type WHEN 'click' THEN 'browse' WHEN 'view' THEN 'browse' WHEN 'purchase' THEN 'sale' ELSE 'other' END AS category, COUNT(*) AS calls, COUNT(*) FILTER (value > 50) AS successes FROM events GROUP BY 1")
def ops_categories(spark: SparkSession, sf: str) -> DataFrame:
    return U.by_category(table(spark, sf, "events"), "event_type", F.col("value") > 50, {"click": "browse", "view": "browse", "purchase": "sale"}, "other")


_MODELS = [(1, "click", "click-v1", True, False, 2, "0.010000", "0.030000"), (2, "click-x", "click", True, True, 1, "0.020000", "0.050000"), (3, "view", "view", True, False, 1, "0.001500", "0.002500"), (4, "purchase", "purchase", False, True, 1, "9.000000", "9.000000")]


def _priced_usage(spark: SparkSession, sf: str) -> DataFrame:
    models = spark.createDataFrame(_MODELS, "id int, name string, model_name string, enabled boolean, is_default boolean, sort_order int, input_price string, output_price string")
    usage = table(spark, sf, "events").select("event_id", "user_id", F.to_date("ts").alias("day"), F.col("event_type").alias("model"), (F.col("event_id") % 3000).alias("input_tokens"), (F.col("event_id") % 700).alias("output_tokens"))
    return J.priced(usage, models)


@QUERIES.add("""SELECT model, COUNT(*) AS requests, CAST(SUM(i) AS BIGINT) AS input_tokens, CAST(CAST(SUM(CASE model WHEN 'click' THEN a + b WHEN 'view' THEN c + d ELSE 0 END) AS DECIMAL(18,4)) AS VARCHAR) AS cost FROM (
SELECT event_type AS model, event_id % 3000 AS i,
 CAST(((event_id % 3000) * 20000 + 50000) // 100000 AS DECIMAL(18,4)) / 10000 AS a,
 CAST(((event_id % 700) * 50000 + 50000) // 100000 AS DECIMAL(18,4)) / 10000 AS b, CAST(((event_id % 3000) * 1500 + 50000) // 100000 AS DECIMAL(18,4)) / 10000 AS c, CAST(((event_id % 700) * 2500 + 50000) // 100000 AS DECIMAL(18,4)) / 10000 AS d FROM events) GROUP BY model""")
def ops_cost_rollup(spark: SparkSession, sf: str) -> DataFrame:
    out = U.usage_rollup(_priced_usage(spark, sf), ["model"], input_tokens="input_tokens", cost="cost")
    return out.select("model", "requests", "input_tokens", F.col("cost").cast("decimal(18,4)").cast("string").alias("cost"))


@QUERIES.add("SELECT user_id, CAST(ts AS DATE) AS day, event_type AS model, CAST(SUM(event_id % 1000) AS BIGINT) AS tokens, COUNT(*) AS requests FROM events GROUP BY ALL")
def ops_daily_usage_merge(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("user_id", F.to_date("ts").alias("day"), F.col("event_type").alias("model"), (F.col("event_id") % 1000).alias("tokens"), "event_id")
    keys = ["user_id", "day", "model"]
    old, new = (U.usage_rollup(e.where(c), keys, tokens="tokens") for c in (F.col("event_id") % 2 == 0, F.col("event_id") % 2 == 1))
    return U.merge_usage(old, new, keys)


@QUERIES.add("""WITH q AS (SELECT DISTINCT user_id, CASE WHEN user_id % 4 = 0 THEN -1 ELSE 3000 END AS dt, CASE WHEN user_id % 5 = 0 THEN -1 ELSE 60000 END AS mt FROM events),
u AS (SELECT user_id, SUM(CASE WHEN CAST(ts AS DATE) = DATE '2024-01-30' THEN event_id % 1000 ELSE 0 END) AS d, COUNT(*) FILTER (CAST(ts AS DATE) = DATE '2024-01-30') AS dr, SUM(event_id % 1000) AS m, COUNT(*) AS mr FROM events WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-01' AND DATE '2024-01-30' GROUP BY 1)
SELECT q.user_id, CAST(COALESCE(d, 0) AS BIGINT) AS day_tokens, COALESCE(dr, 0) AS day_requests, CAST(COALESCE(m, 0) AS BIGINT) AS month_tokens, COALESCE(mr, 0) AS month_requests, (dt = -1 OR COALESCE(d, 0) < dt) AND (mt = -1 OR COALESCE(m, 0) < mt) AND COALESCE(dr, 0) < 20 AS allowed FROM q LEFT JOIN u USING (user_id)""")
def ops_quota_breach(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    quotas = e.select("user_id").distinct().select("user_id", F.when(F.col("user_id") % 4 == 0, -1).otherwise(3000).alias("daily_tokens"), F.when(F.col("user_id") % 5 == 0, -1).otherwise(60000).alias("monthly_tokens"), F.lit(20).alias("daily_requests"), F.lit(-1).alias("monthly_requests"))
    return U.quota_status(e.select("user_id", F.to_date("ts").alias("day"), (F.col("event_id") % 1000).alias("tokens")), quotas, _LAST)


@QUERIES.add("SELECT event_id, event_type FROM events WHERE event_type = 'click' AND ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-21' ORDER BY ts DESC, event_id LIMIT 20 OFFSET 40")
def ops_paged_log(spark: SparkSession, sf: str) -> DataFrame:
    rows = U.log_filter(table(spark, sf, "events"), "2024-01-05", "2024-01-20", event_type="click", user_id=None)
    return U.page(rows, 3, 20, F.desc("ts"), F.col("event_id")).select("event_id", "event_type")


@QUERIES.add("SELECT COUNT(*) AS total, CAST((COUNT(*) + 49) // 50 AS BIGINT) AS pages, CAST(3 AS INTEGER) AS page FROM events")
def ops_page_info(spark: SparkSession, sf: str) -> DataFrame:
    return U.page_info(table(spark, sf, "events"), 3, 50)


@QUERIES.add("SELECT p_partkey FROM part WHERE contains(p_name, '1') OR contains(p_brand, '1') OR contains(p_type, '1')")
def ops_keyword_search(spark: SparkSession, sf: str) -> DataFrame:
    return U.keyword_search(table(spark, sf, "part"), "1", ["p_name", "p_brand", "p_type"]).select("p_partkey")


@QUERIES.add("SELECT conv_id, turn, rank FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rank FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS b FROM conversations) WHERE b <= 3)")
def ops_latest_messages(spark: SparkSession, sf: str) -> DataFrame:
    return U.latest_in_order(table(spark, sf, "conversations"), "conv_id", "turn", 3).select("conv_id", "turn", F.col("rank").cast("long").alias("rank"))


@QUERIES.add("SELECT conv_id, turn, CASE WHEN length(text) > 50 THEN concat(substr(text, 1, 50), '...') ELSE text END AS preview FROM conversations ORDER BY conv_id DESC, turn DESC LIMIT 10")
def ops_recent_previews(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").orderBy(F.desc("conv_id"), F.desc("turn")).limit(10).select("conv_id", "turn", X.preview(F.col("text"), 50).alias("preview"))


@QUERIES.add("""WITH t AS (SELECT *, CAST(SUM(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS turn_no FROM conversations)
SELECT conv_id, turn_no, COUNT(*) AS messages, MIN(text) FILTER (role = 'user') AS question, max_by(text, turn) FILTER (role = 'assistant') AS summary FROM t GROUP BY ALL""")
def turn_islands(spark: SparkSession, sf: str) -> DataFrame:
    return U.turns(table(spark, sf, "conversations"), "conv_id", "turn", "role", "text")


@QUERIES.add("SELECT d.doc_id, d.source FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.quality = 1)")
def scope_semi(spark: SparkSession, sf: str) -> DataFrame:
    return J.visible(table(spark, sf, "documents"), table(spark, sf, "labels"), "doc_id", F.col("quality") == 1).select("doc_id", "source")


@QUERIES.add("SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def missing_anti(spark: SparkSession, sf: str) -> DataFrame:
    return J.missing(table(spark, sf, "documents"), table(spark, sf, "labels"), "doc_id").select("doc_id")


@QUERIES.add("SELECT doc_id, lang, source FROM (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY n_chars DESC, doc_id) AS r FROM documents) WHERE r = 1")
def first_of_each_key(spark: SparkSession, sf: str) -> DataFrame:
    return J.first_of_each(table(spark, sf, "documents"), ["lang", "source"], F.desc("n_chars"), F.col("doc_id")).select("doc_id", "lang", "source")


@QUERIES.add("""WITH a AS (SELECT doc_id AS k, md5(text) AS f FROM documents WHERE doc_id % 10 <> 3), b AS (SELECT doc_id AS k, CASE WHEN doc_id % 7 = 0 THEN 'old' ELSE md5(text) END AS f FROM documents WHERE doc_id % 10 <> 4)
SELECT change, COUNT(*) AS n FROM (SELECT CASE WHEN b.k IS NULL THEN 'added' WHEN a.k IS NULL THEN 'removed' WHEN a.f = b.f THEN 'unchanged' ELSE 'updated' END AS change FROM a FULL JOIN b ON a.k = b.k) GROUP BY change""")
def manifest_diff(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("source_key"), F.md5("text").alias("fingerprint"))
    found = d.where(F.col("source_key") % 10 != 3)
    stored = d.where(F.col("source_key") % 10 != 4).withColumn("fingerprint", F.when(F.col("source_key") % 7 == 0, "old").otherwise(F.col("fingerprint")))
    return J.manifest_diff(found, stored).groupBy("change").agg(F.count("*").alias("n"))


@QUERIES.add("""SELECT c.conv_id, c.turn FROM conversations c WHERE EXISTS (SELECT 1 FROM conversations h WHERE h.conv_id = c.conv_id AND contains(lower(h.text), 'the ') AND h.role = 'user' AND abs(h.turn - c.turn) <= 1)""")
def neighbour_expand(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations")
    hits = c.where(F.contains(F.lower("text"), F.lit("the ")) & (F.col("role") == "user"))
    return J.neighbours(hits, c, "conv_id", "turn").select("conv_id", "turn")


@QUERIES.add("""SELECT e.event_id, COALESCE((SELECT max_by(a.event_id, a.ts) FROM events a WHERE a.user_id = e.user_id AND a.event_type = 'purchase' AND a.ts <= e.ts), (SELECT min_by(a.event_id, a.ts) FROM events a WHERE a.user_id = e.user_id AND a.event_type = 'purchase')) AS anchor FROM events e WHERE e.event_type = 'click'""")
def as_of_lookup(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    anchors = e.where("event_type = 'purchase'").select("user_id", F.struct("ts", F.lit(None).cast("long").alias("id")).alias("at"), F.col("event_id").alias("anchor"))
    places = e.where("event_type = 'click'").select("user_id", F.struct("ts", F.col("event_id").alias("id")).alias("at"))
    return J.as_of(anchors, places, "user_id", "at", "anchor").select(F.col("at.id").alias("event_id"), "anchor")


@QUERIES.add("SELECT n_name, r_name, COUNT(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL")
def dimension_join(spark: SparkSession, sf: str) -> DataFrame:
    c, n, r = (table(spark, sf, t) for t in ("customer", "nation", "region"))
    return c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).groupBy("n_name", "r_name").agg(F.count("*").alias("customers"))


@QUERIES.add("SELECT user_id, time_bucket(INTERVAL 1 HOUR, ts) AS start, COUNT(*) AS n, round(SUM(value), 4) AS total FROM events GROUP BY ALL")
def tumbling_windows(spark: SparkSession, sf: str) -> DataFrame:
    return E.tumbling(table(spark, sf, "events"), "1 hour", "user_id").select("user_id", "start", "n", F.round("total", 4).alias("total"))


@QUERIES.add("""WITH w AS (SELECT event_type, value, time_bucket(INTERVAL 30 MINUTE, ts) AS b FROM events) SELECT event_type, start, COUNT(*) AS n FROM (SELECT event_type, b AS start FROM w UNION ALL SELECT event_type, b - INTERVAL 30 MINUTE FROM w) GROUP BY ALL""")
def sliding_windows(spark: SparkSession, sf: str) -> DataFrame:
    return E.tumbling(table(spark, sf, "events"), "1 hour", "event_type", slide="30 minutes").select("event_type", "start", "n")


@QUERIES.add("""WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, SUM(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, MIN(ts) AS start, MAX(ts) + INTERVAL 30 MINUTE AS "end", COUNT(*) AS n FROM s GROUP BY user_id, k""")
def session_windows(spark: SparkSession, sf: str) -> DataFrame:
    return E.sessions(table(spark, sf, "events"))


@QUERIES.add("""WITH v AS (SELECT user_id AS session_id, event_type AS key, event_id AS seq, CAST(floor(value / 50) AS BIGINT) AS value FROM events), c AS (SELECT *, lag(value) OVER (PARTITION BY session_id, key ORDER BY seq) AS b FROM v), d AS (SELECT * FROM c WHERE b IS NULL OR b <> value),
e AS (SELECT session_id, key, seq, CAST(value AS VARCHAR) AS value, lead(seq) OVER (PARTITION BY session_id, key ORDER BY seq) AS superseded_by FROM d) SELECT *, CASE WHEN superseded_by IS NULL THEN 'ACTIVE' ELSE 'SUPERSEDED' END AS status FROM e""")
def memory_versions(spark: SparkSession, sf: str) -> DataFrame:
    from granary.operators.memory import versions

    e = table(spark, sf, "events").select(F.col("user_id").alias("session_id"), F.col("event_type").alias("key"), F.col("event_id").alias("seq"), F.lit(0).alias("position"), F.floor(F.col("value") / 50).cast("string").alias("value"))
    return versions(e).select("session_id", "key", "seq", "value", "superseded_by", "status")


@QUERIES.add("SELECT conv_id AS session_id, turn AS seq, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations WHERE turn > 2) WHERE n <= 2")
def memory_delta(spark: SparkSession, sf: str) -> DataFrame:
    from granary.operators.memory import delta

    c = table(spark, sf, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("seq"), "role")
    return delta(c, 2, 2)


@QUERIES.add("SELECT doc_id, max(v) AS version FROM (SELECT doc_id, 1 AS v FROM documents UNION ALL SELECT doc_id, 2 FROM documents WHERE doc_id % 3 = 0) GROUP BY doc_id")
def upsert_last_wins(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", F.lit(1).alias("version"))
    return FS.upsert(d, d.where("doc_id % 3 = 0").withColumn("version", F.lit(2)), "doc_id", "version")


@QUERIES.add("SELECT conv_id, string_agg('## ' || role || chr(10) || chr(10) || coalesce(text, ''), chr(10) || chr(10) ORDER BY turn) AS markdown FROM conversations GROUP BY conv_id")
def conversation_markdown(spark: SparkSession, sf: str) -> DataFrame:
    return FS.write_ordered_text(table(spark, sf, "conversations"), "conv_id", "turn", "role", "text")


@QUERIES.add("""SELECT document_id, chunks, vectors, round(CASE WHEN chunks > 0 THEN vectors / chunks END, 4) AS progress, CASE WHEN chunks = 0 THEN 'FAILED' WHEN vectors < chunks THEN 'VECTORIZING' ELSE 'READY' END AS status FROM (SELECT conv_id AS document_id, COUNT(*) FILTER (role <> 'system') AS chunks, COUNT(*) FILTER (role = 'user') AS vectors FROM conversations GROUP BY 1)""")
def document_states(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations").select(F.col("conv_id").alias("document_id"), "role", "turn")
    documents = c.select("document_id").distinct().withColumn("created_at", F.lit("2024-01-01").cast("timestamp"))
    return E.document_state(documents, c.where("role <> 'system'"), c.where("role = 'user'"), "2024-01-02")


@QUERIES.add("SELECT n.n_nationkey, COUNT(c_custkey) AS n FROM nation n LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 9000) c ON c.c_nationkey = n.n_nationkey GROUP BY 1")
def counts_by_parent(spark: SparkSession, sf: str) -> DataFrame:
    from granary.operators.repair import counts_by_parent as count

    children = table(spark, sf, "customer").where("c_acctbal > 9000").withColumnRenamed("c_nationkey", "n_nationkey")
    return count(table(spark, sf, "nation"), children, "n_nationkey")


@QUERIES.add("SELECT c_custkey AS user_id, CASE WHEN n > 0 THEN 'buyer' ELSE 'user' END AS role FROM (SELECT c_custkey, (SELECT COUNT(*) FROM orders WHERE o_custkey = c_custkey) AS n FROM customer)")
def default_roles(spark: SparkSession, sf: str) -> DataFrame:
    from granary.operators.repair import with_default_role

    buyers = table(spark, sf, "orders").select(F.col("o_custkey").alias("user_id")).distinct().withColumn("role", F.lit("buyer"))
    return with_default_role(table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id")), buyers, "user")
