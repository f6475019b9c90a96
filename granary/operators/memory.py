"""Conversation facts: extraction, versions, forgetting, recall."""

from __future__ import annotations

import re
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions import text as X
from granary.operators import said as S

_FACT = "struct<key:string,label:string,value:string,category:string,quote:string,scope:string,field:string>"


def message_facts(text: Column, most: int = 8) -> Column:
    """The facts of one message, up to `most`; see said.facts_of()."""

    @F.arrow_udf(f"array<{_FACT}>")
    def read(texts: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([(name, pa.string()) for name in S.Fact._fields]))
        return pa.array([[f._asdict() for f in S.facts_of(t, most)] for t in texts.to_pylist()], kind)

    return read(text)


def facts(messages: DataFrame, session: str = "session_id", seq: str = "seq", role: str = "role", content: str = "content") -> DataFrame:
    """session, seq, position, key, label, value, category, quote, scope, field and correction of the facts in user messages. Each message is read
    on its own, in the task that scans it."""
    corrects = reduce(lambda a, b: a | b, [F.contains(F.col(content), F.lit(w)) for w in S.CORRECTS])
    said = messages.where(F.col(role) == "user").select(session, seq, corrects.alias("correction"), F.posexplode(message_facts(F.col(content))).alias("position", "x"))
    return said.select(session, seq, "position", "x.*", "correction")


def held_back(found: DataFrame, session: str = "session_id", seq: str = "seq") -> DataFrame:
    """The facts with `held`: a correction that names no project, of a field for which two projects or more had a fact before. It can't be told
    whose it is, so it is neither taken nor shown; projects are counted as they come, not collected."""
    order = (seq, "position")
    opens = (F.row_number().over(Window.partitionBy(session, "field", "scope").orderBy(*order)) == 1) & (F.col("scope") != "")
    before = Window.partitionBy(session, "field").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    counted = found.withColumn("_opens", opens.cast("int")).withColumn("_projects", F.coalesce(F.sum("_opens").over(before), F.lit(0)))
    return counted.withColumn("held", (F.col("scope") == "") & F.col("correction") & (F.col("_projects") > 1)).drop("_opens", "_projects")


def forget_commands(messages: DataFrame, session: str = "session_id", seq: str = "seq", role: str = "role", content: str = "content") -> DataFrame:
    """session, seq, action FORGET and key of the user messages that ask to forget one thing, as controls for forget()."""
    asked = F.trim(F.regexp_extract(F.trim(content), FORGET, 1))
    named = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in S.FIELDS.items() for x in pair]), F.lower(asked)), F.lower(asked))
    return messages.where((F.col(role) == "user") & (asked != "")).select(session, seq, F.lit("FORGET").alias("action"), named.alias("key"))


def remembered(messages: DataFrame, session: str = "session_id", seq: str = "seq", role: str = "role", content: str = "content", most: int = 128) -> DataFrame:
    """The versions of all facts of all sessions: those held back left out, forgotten ones gone, the cap on a session's keys kept."""
    found = facts(messages, session, seq, role, content)
    open_to = forget(found, forget_commands(messages, session, seq, role, content), session, seq)
    return capped(versions(held_back(open_to, session, seq).where("not held").drop("held"), session, seq), most, session, seq)


def reextracted(old: DataFrame, fresh: DataFrame, tombstones: DataFrame, session: str = "session_id") -> DataFrame:
    """session, id, key, field, value, seq, origin, status and superseded_by of a session's facts after its messages have been read again by newer rules.

    old: what was stored (session, id, key, field, value, seq, origin USER_MESSAGE or MANUAL, status). fresh: the new reading (session, key, field, value,
    seq, status). tombstones: session and key of what the user deleted. By precedence: a tombstone of a fresh fact's key or field
    keeps it out; so does a manual fact that is active; manual facts stay as they are; a fresh fact that was there with its key, value
    and message keeps its id; others get one made from these. What only the old reading had is superseded, by the fresh fact of its
    message and field if there is one. Run again on its own result, it changes nothing.
    """
    keys = [session, "key", "value", "seq"]
    manual = old.where("origin = 'MANUAL'")
    guarded = tombstones.select(session, F.col("key").alias("_k")).union(manual.where("status = 'ACTIVE'").select(session, F.col("key").alias("_k"))).distinct()
    let_in = fresh.join(guarded.withColumnRenamed("_k", "key"), [session, "key"], "left_anti").join(guarded.withColumnRenamed("_k", "field"), [session, "field"], "left_anti").dropDuplicates(keys)
    told = old.where("origin <> 'MANUAL'").dropDuplicates(keys)
    new_id = F.sha2(F.concat_ws("\x1f", *[F.col(k).cast("string") for k in keys]), 256)
    named = let_in.join(told.select(*keys, F.col("id").alias("_old")), keys, "left").withColumn("id", F.coalesce("_old", new_id))
    now = named.select(session, "id", "key", "field", "value", "seq", F.lit("USER_MESSAGE").alias("origin"), "status")
    order = Window.partitionBy(session, "key").orderBy("seq", "value")
    now = now.withColumn("superseded_by", F.when(F.col("status") != "ACTIVE", F.lead("id").over(order)))
    heirs = now.groupBy(session, "seq", "field").agg(F.min("id").alias("_heir"))
    gone = told.join(let_in.select(*keys), keys, "left_anti").join(heirs, [session, "seq", "field"], "left")
    gone = gone.select(session, "id", "key", "field", "value", "seq", "origin", F.lit("SUPERSEDED").alias("status"), F.col("_heir").alias("superseded_by"))
    kept = manual.select(session, "id", "key", "field", "value", "seq", "origin", "status", F.lit(None).cast("string").alias("superseded_by"))
    return now.unionByName(gone).unionByName(kept)


def versions(found: DataFrame, session: str = "session_id", seq: str = "seq", position: str = "position", key: str = "key", value: str = "value") -> DataFrame:
    """Facts with status (ACTIVE or SUPERSEDED) and superseded_by (the next version's seq). A value that equals the version
    before it is no new version. The order is that of insertion, whatever messages are dated."""
    order = Window.partitionBy(session, key).orderBy(seq, position)
    changed = found.withColumn("_before", F.lag(value).over(order)).where(~F.col("_before").eqNullSafe(F.col(value)) | F.col("_before").isNull()).drop("_before")
    later = changed.withColumn("superseded_by", F.lead(seq).over(order))
    return later.withColumn("status", F.when(F.col("superseded_by").isNull(), "ACTIVE").otherwise("SUPERSEDED"))


def capped(versioned: DataFrame, most: int = 128, session: str = "session_id", seq: str = "seq") -> DataFrame:
    """Versions whose key was among the first `most` of its session: what comes when a session is full is not taken up."""
    first = versioned.withColumn("_opened", F.min(F.struct(seq, "position")).over(Window.partitionBy(session, "key")))
    return first.withColumn("_n", F.dense_rank().over(Window.partitionBy(session).orderBy("_opened", "key"))).where(F.col("_n") <= most).drop("_n", "_opened")


def forget(found: DataFrame, controls: DataFrame, session: str = "session_id", seq: str = "seq") -> DataFrame:
    """Facts without those under control events (session, seq, action, key): FORGET drops a key and keeps it out from then
    on until ALLOW, CLEAR drops all there was, PAUSE keeps out what comes until RESUME."""
    c = controls.select(F.col(session).alias("_s"), F.col(seq).alias("_at"), "action", F.col("key").alias("_k"))
    joined = found.join(c, (F.col(session) == F.col("_s")) & (F.col("_k").isNull() | (F.col("_k") == F.col("key"))), "left")
    after, before = F.col("_at") > F.col(seq), F.col("_at") <= F.col(seq)
    last = lambda *actions: F.max_by(F.when(before & F.col("action").isin(*actions), F.col("action")), F.when(before & F.col("action").isin(*actions), F.col("_at")))
    judged = joined.groupBy(*[found[x] for x in found.columns]).agg(
        F.coalesce(F.bool_or(after & F.col("action").isin("FORGET", "CLEAR")), F.lit(False)).alias("_gone"), last("FORGET", "ALLOW").alias("_key_state"), last("PAUSE", "RESUME").alias("_pause")
    )
    return judged.where(~F.col("_gone") & ~F.coalesce(F.col("_key_state") == "FORGET", F.lit(False)) & ~F.coalesce(F.col("_pause") == "PAUSE", F.lit(False))).drop("_gone", "_key_state", "_pause")


#: Words of a question that ask for a field; the terms that stand for another; and what asks for all there is.
ALIASES = {
    "预算": "预算 budget 经费上限 预算上限 花费上限 费用上限", "负责人": "负责人 owner 谁牵头 谁负责 由谁负责 牵头人", "技术选型": "技术选型 开发栈 技术栈 jdk",
    "下一步": "下一步 后续安排 接下来做什么", "已完成": "已完成 已经完成", "待解决": "待解决 尚未解决",
}
STANDS_FOR = {"jdk": "java"}
RECALL_ALL = "(?is).*(?:回忆|约定|记忆|之前|最初|项目|任务|remember|recall).*"
#: A message that asks to forget one thing.
FORGET = r"^(?:请)?(?:忘记|不要再记住)\s*([^。！!]{1,32})[。！!]?$"


def _asked(query: str) -> tuple[list[str], list[str]]:
    """The words that a question's facts are looked for by, and the fields it names by any of their names."""
    low = query.lower()
    fields = [field for field, words in ALIASES.items() if any(w in low for w in words.split())]
    return [query, *fields, *[also for word, also in STANDS_FOR.items() if word in low]], fields


def in_scope(active: DataFrame, query: str) -> DataFrame:
    """The facts that a question may use: of those under a project only the projects it names, if any; then facts and tasks under none are left
    out too, as they can't stand in for what a named project lacks."""
    asked = [p.lower() for p in S.asked_projects(query)]
    if not asked:
        return active
    return active.where(F.when(F.col("scope") != "", F.lower("scope").isin(asked)).otherwise(~F.col("category").isin("FACT", "TASK") | (F.col("label") == "明确约定")))


def recall_order(active: DataFrame, query: str, session: str = "session_id", seq: str = "seq") -> DataFrame:
    """Active facts with their recall score (4 for pinned, 4 x label, 2 x value matches) and rank; later ones first among equals. A field is
    found by its other names too."""
    terms = X.memory_terms(F.lit(" ".join(_asked(query)[0])))
    score = F.when(_pinned(), 4).otherwise(0) + 4 * X.memory_score(terms, F.col("label")) + 2 * X.memory_score(terms, F.col("value"))
    return active.withColumn("score", score).withColumn("rank", F.row_number().over(Window.partitionBy(session).orderBy(F.desc("score"), F.desc(seq), "position")))


def _pinned() -> Column:
    return (F.col("category") != "FACT") | (F.col("label") == "明确约定")


def recalled(active: DataFrame, query: str, budget: int = 2800, most: int = 16, session: str = "session_id", seq: str = "seq", independent: bool = False) -> DataFrame:
    """The facts that go into a prompt: by recall order, each if its line still fits. Facts under projects the question doesn't mean stay out; so do,
    unless it asks for all, facts that aren't pinned and share no term with it. An independent question gets preferences, constraints and
    agreements only. active may lack `scope`: then no fact is under a project."""
    from granary.operators.retrieval import within_budget

    found = active if "scope" in active.columns else active.withColumn("scope", F.lit(""))
    found = in_scope(found, query)
    terms = X.memory_terms(F.lit(" ".join(_asked(query)[0])))
    if independent:
        found = found.where(F.col("category").isin("PREFERENCE", "CONSTRAINT") | (F.col("label") == "明确约定"))
    elif not re.match(RECALL_ALL, query):
        found = found.where(_pinned() | (X.memory_score(terms, F.concat_ws(" ", "label", "value")) >= 1))
    lines = recall_order(found, query, session, seq).withColumn("line", F.concat(F.lit("- "), "label", F.lit(": "), "value", F.lit("\n"))).withColumn("size", F.length("line"))
    return within_budget(lines.select(session, "rank", "key", "line", "size"), session, ["rank"], "size", budget, most)


def unclear_projects(active: DataFrame, query: str, session: str = "session_id") -> DataFrame:
    """session and scopes where a question names no project, but facts of the field it asks for are under several: what to ask back about."""
    fields = _asked(query)[1]
    if S.asked_projects(query) or not fields:
        return active.where(F.lit(False)).groupBy(session).agg(F.collect_set("scope").alias("scopes"))
    named = active.where((F.col("scope") != "") & F.col("field").isin(fields)).select(session, "scope").distinct()
    return named.groupBy(session).agg(F.array_sort(F.collect_list("scope")).alias("scopes")).where(F.size("scopes") > 1)


def recall_candidates(messages: DataFrame, query: str, most_chars: int = 1000, content: str = "content") -> DataFrame:
    """The user messages of up to most_chars characters with any term of the question in them, in whatever case: all that recalled_messages()
    could find. Terms are compared as they are; a question of many terms needs no way of its own, as one pass tests them all."""
    terms = X.memory_terms(F.lit(query))
    low = F.lower(F.col(content))
    return messages.where((F.col("role") == "user") & (F.length(content) <= most_chars) & F.exists(terms, lambda t: F.contains(low, t)))


def recalled_messages(messages: DataFrame, query: str, withheld: DataFrame, recent: int = 0, budget: int = 3600, most: int = 4, session: str = "session_id", seq: str = "seq", content: str = "content") -> DataFrame:
    """session, rank, seq and content of up to `most` earlier user messages that hold no fact but share terms with the question (a score of 2 or
    more), best first, newer first among equals, each if it still fits. Messages in `withheld` (session, seq), unsafe ones, long ones, the
    `recent` last ones and, for a question about projects, those that don't name just these stay out."""
    from granary.operators.retrieval import within_budget

    back = F.row_number().over(Window.partitionBy(session).orderBy(F.desc(seq)))
    text, asked = F.col(content), S.asked_projects(query)
    own = F.arrow_udf(lambda texts: pa.array([[p.lower() for p in S.asked_projects(t)] for t in texts.to_pylist()], pa.list_(pa.string())), "array<string>")
    kept = messages.withColumn("_back", back).where((F.col("_back") > recent) & (F.col("role") == "user") & (F.length(text) <= 1000) & ~text.rlike(S.UNSAFE)).join(withheld.select(session, seq), [session, seq], "left_anti")
    kept = kept.where(F.size(message_facts(text)) == 0)
    if asked:
        kept = kept.withColumn("_own", own(text)).where((F.size("_own") > 0) & (F.size(F.array_except("_own", F.array(*[F.lit(p.lower()) for p in asked]))) == 0))
    scored = kept.withColumn("_score", X.memory_score(X.memory_terms(F.lit(query)), text)).where("_score >= 2")
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy(session).orderBy(F.desc("_score"), F.desc(seq))))
    return within_budget(ranked.select(session, "rank", seq, content, F.length(content).alias("size")), session, ["rank"], "size", budget, most).drop("size")


#: Words that mark early messages worth keeping.
IMPORTANT = r"(?i)目标|要求|约束|决定|必须|预算|负责人|deadline|must|goal|decid|requirement"


def early_history(messages: DataFrame, recent: int, budget: int = 3000, most: int = 8, session: str = "session_id", seq: str = "seq") -> DataFrame:
    """Of the messages before the `recent` last ones, those that matter, newest first, each if it still fits."""
    from granary.operators.retrieval import within_budget

    old = messages.withColumn("_back", F.row_number().over(Window.partitionBy(session).orderBy(F.desc(seq)))).where(F.col("_back") > recent)
    return within_budget(old.where(F.col("content").rlike(IMPORTANT)).select(session, "_back", seq, "content", F.length("content").alias("size")), session, ["_back"], "size", budget, most).drop("_back", "size")


def delta(messages: DataFrame, cursor: Column | int, most: int, session: str = "session_id", seq: str = "seq") -> DataFrame:
    """The next `most` messages of each session after a cursor."""
    ranked = messages.where(F.col(seq) > cursor).withColumn("_n", F.row_number().over(Window.partitionBy(session).orderBy(seq)))
    return ranked.where(F.col("_n") <= most).drop("_n")


def task_status(active: DataFrame, session: str = "session_id", seq: str = "seq", most: int = 6) -> DataFrame:
    """session, label and up to `most` values of the task fields, in order; a project's tasks are under its own label. active may lack `field`: then
    a fact's label is its field."""
    field = F.col("field") if "field" in active.columns else F.col("label")
    tasks = active.where(F.when(field.startswith("已完成"), "已完成").otherwise(field).isin("目标", "已完成", "下一步", "待解决"))
    ranked = tasks.withColumn("_n", F.row_number().over(Window.partitionBy(session, "label").orderBy(seq, "position"))).where(F.col("_n") <= most)
    return ranked.groupBy(session, "label").agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "value"))), lambda x: x["value"]).alias("values"))
