"""Names in questions: which files and collections a question names, and the scope that follows from it."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.operators.routing import calendar_offset, choose_strong

#: Names of files; what asks for documents, for nothing but them, for this one, for none; other subjects and follow-ups.
NAMED_FILE = r"(?i)[\p{L}\p{N}_-]+\.(pdf|docx?|txt|md|xlsx?)"
DOC_INTENT = r"(?i)知识库|文档|资料|本书|手册|教程|上传|根据|依据|pdf"
ONLY = r"(只|仅).{0,8}(根据|依据|基于|使用|查|看)|不要.{0,10}(外部知识|其他资料)"
THIS_DOC = r"(?i)(此|这份|这个|该|这本|本书).{0,3}(pdf|文档|资料|书)?"
NO_KNOWLEDGE = r"(不要|不用|无需).{0,8}(查资料|知识库|检索文档)"
SHIFT = r"换个话题|换一个话题|另外一个问题|接下来问|说回|现在聊|不聊.*了"
FOLLOW_UP = r"^(那|那么|它|他们|这些|这个|其中|第[一二三四五六七八九十0-9]+|继续|再解释|举个|举例|详细|展开|还有呢|为什么呢)"
SMALL_TALK = r"(?i)^(你好|您好|嗨|hi|hello|(?:谢谢|感谢)(?:你|您|你们|你的帮助|您的帮助)?|再见|bye|好的|好|ok|嗯|哈哈|早上好|晚安|你是谁|你叫什么|你能做什么)[！!。.,，？?\s]*$"
SIMPLE_TASK = r"(?i)^(?:翻译[：:]|translate[ :])|^(?:计算|帮我算)?[：:\s]*[0-9.]+\s*[-+*/%]\s*[0-9.() +*/%-]+[？?。！!\s]*$"
SEVERAL = r"(?s)对比|比较|各自|分别|两份|两本|跨知识库|不同|共同|联系|结合.*[和与、]"

#: Bytes of distinct names up to which one automaton of all is sent to the tasks.
MOST_BYTES = 16 << 20
_LONGEST_ANCHOR = 16


def names_in(questions: DataFrame, names: DataFrame, id_col: str = "question_id", text_col: str = "question", name_col: str = "name", most_bytes: int = MOST_BYTES) -> DataFrame:
    """id and name (lower case, each once) of the names that stand in each question, whatever their case; blank names stand in none.

    Up to most_bytes of distinct names, all of them are one automaton that passes over each question once, in the tasks that read it.
    Beyond, a name is looked for by its anchor, its longest beginning of 1, 2, 4, 8 or 16 characters: anchors are joined with the questions'
    stretches of those lengths, and what meets is compared in full.
    """
    asked = questions.select(F.col(id_col).alias("id"), F.lower(text_col).alias("text"))
    known = names.select(F.lower(name_col).alias("name")).where("trim(name) <> ''").distinct()
    size = known.agg(F.sum(F.octet_length("name") + 64)).first()[0] or 0
    found = _by_automaton(asked, known) if size <= most_bytes else _by_anchors(asked, known)
    return found.withColumnRenamed("id", id_col)


def _by_automaton(asked: DataFrame, known: DataFrame) -> DataFrame:
    sent = asked.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, [r["name"] for r in known.collect()]))  # at most MOST_BYTES

    @F.pandas_udf("array<string>")
    def scan(texts):
        machine = _automaton(sent)
        return texts.map(lambda t: [] if t is None or not len(machine) else sorted({name for _, name in machine.iter(t)}))

    return asked.select("id", F.explode(scan("text")).alias("name"))


_made: dict = {}


def _automaton(sent):
    """The automaton of a broadcast list, made once in each worker; the last one is kept."""
    import ahocorasick

    key, names = sent.value
    if key not in _made:
        machine = ahocorasick.Automaton()
        for name in names:
            machine.add_word(name, name)
        if len(machine):
            machine.make_automaton()
        _made.clear()
        _made[key] = machine
    return _made[key]


def _by_anchors(asked: DataFrame, known: DataFrame) -> DataFrame:
    long = F.least(F.lit(_LONGEST_ANCHOR), F.pow(F.lit(2), F.floor(F.log2(F.length("name")))).cast("int"))
    anchored = known.withColumn("anchor", F.left("name", long))
    widths = F.array(*[F.lit(1 << k) for k in range(_LONGEST_ANCHOR.bit_length())])
    stretches = F.flatten(F.transform(widths, lambda w: F.when(w <= F.length("text"), F.transform(F.sequence(F.lit(1), F.length("text") - w + 1), lambda i: F.substring("text", i, w))).otherwise(F.array().cast("array<string>"))))
    met = asked.select("id", F.explode(F.array_distinct(stretches)).alias("anchor")).join(anchored, "anchor").select("id", "name").distinct()
    return met.join(asked, "id").where(F.contains("text", F.col("name"))).select("id", "name").distinct()


def _one(rows: DataFrame, n: str, doc: str) -> DataFrame:
    """question_id with how many documents there are and, if it is one, which."""
    return rows.groupBy("question_id").agg(F.count("*").alias(n), F.min(F.struct("document_id", "collection_id", "status")).alias(doc))


def named_scope(questions: DataFrame, documents: DataFrame, collections: DataFrame, ranked: DataFrame | None = None, probe: DataFrame | None = None, most_bytes: int = MOST_BYTES) -> DataFrame:
    """question_id, reason, strict, documents, collections and query: what each question may be answered from, by the first rule that holds.

    questions: question_id, question, previous (the question before), prior_documents, prior_collections and prior_strict (of the scope before).
    documents: document_id, collection_id, filename, status. collections: collection_id, name. ranked (question_id, collection_id, score,
    matches) and probe (question_id, collection_id, score) are the rankings by topic and by words, for questions that name nothing.

    Files named, all of other names: those documents. One name of several documents: the one in a collection that is named too, else the
    one in the scope before, else `ambiguous`. A file name that nobody has: `missing_document`. A document that isn't READY: `not_ready`. Then
    `this document` and `only by`, small talk, an empty catalogue, named collections, follow-ups, topics and words. Names are met by
    equality, so a name of very many documents is counted, not listed. Null questions are empty ones.
    """
    q = questions.select("question_id", F.coalesce("question", F.lit("")).alias("question"), F.coalesce("previous", F.lit("")).alias("previous"), *[F.coalesce(c, F.array().cast(questions.schema[c].dataType)).alias(c) for c in ("prior_documents", "prior_collections")], F.coalesce("prior_strict", F.lit(False)).alias("prior_strict"))
    docs = documents.select("document_id", "collection_id", "filename", "status", F.lower("filename").alias("name"))
    ready = docs.where("status = 'READY'")
    hits = names_in(q, docs, name_col="filename", most_bytes=most_bytes)
    calls = names_in(q, collections, name_col="name", most_bytes=most_bytes).join(collections.select("collection_id", F.lower("name").alias("name"), F.length(F.trim("name")).alias("_long")), "name").where("_long >= 2").select("question_id", "collection_id").distinct()

    counts = docs.where("trim(filename) <> ''").groupBy("name", "filename").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "READY").alias("n_ready"), F.min(F.struct("document_id", "collection_id", "status")).alias("doc"))
    per = hits.join(counts, "name").groupBy("question_id").agg(
        F.sum("n").alias("matched"), F.sum("n_ready").alias("_ready"), F.count("*").alias("_names"), F.collect_list("filename").alias("_said"), F.array_sort(F.collect_list(F.when(F.col("n") == 1, F.col("doc")))).alias("_each"), F.min("doc").alias("_only")
    )  # of names, which a question's length bounds
    qualified = _one(hits.join(calls, "question_id").join(docs, ["name", "collection_id"]), "_qualified", "_qualified_doc")
    before = q.select("question_id", F.explode("prior_documents").alias("document_id")).distinct().join(docs, "document_id")
    prior = _one(before.join(hits, ["question_id", "name"], "left_semi"), "_in_prior", "_prior_doc")
    prior_ready = _one(before.where("status = 'READY'"), "_prior_ready", "_prior_ready_doc")
    named = calls.join(ready.select("collection_id").distinct(), "collection_id", "left_semi").groupBy("question_id").agg(F.array_sort(F.collect_set("collection_id")).alias("_called"))
    kept = q.select("question_id", F.explode("prior_collections").alias("collection_id")).join(collections, "collection_id", "left_semi").groupBy("question_id").agg(F.collect_set("collection_id").alias("_kept"))
    is_pdf = F.lower("filename").endswith(".pdf")
    only_doc = F.min(F.struct("document_id", "collection_id", "status"))
    catalogue = ready.agg(F.count("*").alias("_all"), only_doc.alias("_all_doc"), F.count_if(is_pdf).alias("_pdfs"), F.min(F.when(is_pdf, F.struct("document_id", "collection_id", "status"))).alias("_pdf_doc"))
    topics = choose_strong(ranked) if ranked is not None else None
    words = choose_probed(probe) if probe is not None else None

    table = q.crossJoin(F.broadcast(catalogue))  # one row
    for part in (per, qualified, prior, prior_ready, named, kept, topics, words):
        if part is not None:
            table = table.join(part, "question_id", "left")
    several = F.col("question").rlike(SEVERAL)
    strong = F.coalesce(F.col("strong"), F.lit(False)) if topics is not None else F.lit(False)
    top = F.col("topics")[0] if topics is not None else F.lit(None)
    topic_scope = F.slice("topics", F.lit(1), F.when(several, 3).otherwise(1)) if topics is not None else F.lit(None)
    word_scope = F.slice("probed", F.lit(1), F.when(several, 3).otherwise(2)) if words is not None else F.lit(None)
    probed = F.col("probed").isNotNull() if words is not None else F.lit(False)
    return _decided(table, strong, top, topic_scope, probed, word_scope)


def _decided(table: DataFrame, strong: Column, top: Column, topic_scope: Column, probed: Column, word_scope: Column) -> DataFrame:
    text, n = F.col("question"), lambda c: F.coalesce(F.col(c), F.lit(0))
    by_length = F.array_sort(F.coalesce("_said", F.array().cast("array<string>")), lambda a, b: F.length(b) - F.length(a))
    rest = F.aggregate(by_length, text, lambda s, name: F.regexp_replace(s, F.concat(F.lit(r"(?i)\Q"), F.replace(name, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit(r"\E")), F.lit("")))
    all_apart = (n("matched") > 1) & (n("_names") == n("matched"))
    one = F.when(n("matched") == 1, F.col("_only")).when(n("_qualified") == 1, F.col("_qualified_doc")).when(n("_in_prior") == 1, F.col("_prior_doc"))
    narrow = (text.rlike(ONLY) | text.rlike(THIS_DOC)) & text.rlike(DOC_INTENT)
    wants_pdf = F.contains(F.lower(text), F.lit("pdf"))
    left = F.when(n("_prior_ready") == 1, F.col("_prior_ready_doc")).when(n("_prior_ready") > 1, None).when(wants_pdf & (F.col("_pdfs") == 1), F.col("_pdf_doc")).when(~wants_pdf & (F.col("_all") == 1), F.col("_all_doc"))
    ordinary = (calendar_offset(text).isNotNull() | F.trim(text).rlike(SMALL_TALK) | F.trim(text).rlike(SIMPLE_TASK)) & ~text.rlike(DOC_INTENT)
    goes_on = ~text.rlike(SHIFT) & text.rlike(FOLLOW_UP) & F.col("_kept").isNotNull() & (~strong | (top == F.get("prior_collections", F.lit(0))))
    settled = lambda doc: F.when(doc["status"] == "READY", "document").otherwise("not_ready")
    reason = (
        F.when(text.rlike(NO_KNOWLEDGE), "disabled").when(rest.rlike(NAMED_FILE), "missing_document").when(all_apart, F.when(n("_ready") == n("matched"), "document").otherwise("not_ready"))
        .when(one.isNotNull(), settled(one)).when(n("matched") > 1, "ambiguous").when(narrow, F.when(left.isNotNull(), "document").otherwise("ambiguous")).when(ordinary, "ordinary").when(F.col("_all") == 0, "empty")
        .when(F.col("_called").isNotNull(), "collection_topic").when(goes_on, "followup").when(strong, "topic").when(probed, F.when(word_scope.isNotNull() & (F.size(word_scope) > 0), "lexical").otherwise("uncertain")).otherwise("semantic")
    )
    id_type, c_type = table.schema["_only"].dataType["document_id"].dataType.simpleString(), table.schema["_only"].dataType["collection_id"].dataType.simpleString()
    chosen = F.when(all_apart, F.col("_each")).when(one.isNotNull(), F.array(one)).otherwise(F.array(left))
    out = table.withColumns({"reason": reason, "_chosen": chosen, "_topic": topic_scope.cast(f"array<{c_type}>"), "_words": word_scope.cast(f"array<{c_type}>")})
    is_doc, follows = F.col("reason") == "document", F.col("reason") == "followup"
    no_docs, no_cols = F.array().cast(f"array<{id_type}>"), F.array().cast(f"array<{c_type}>")
    docs = F.when(is_doc, F.transform("_chosen", lambda d: d["document_id"])).when(follows & F.col("prior_strict"), F.col("prior_documents")).otherwise(no_docs)
    cols = (
        F.when(is_doc, F.array_sort(F.array_distinct(F.transform("_chosen", lambda d: d["collection_id"])))).when(F.col("reason") == "collection_topic", F.col("_called"))
        .when(follows, F.filter("prior_collections", lambda c: F.array_contains("_kept", c))).when(F.col("reason") == "topic", F.col("_topic")).when(F.col("reason") == "lexical", F.col("_words")).otherwise(no_cols)
    )
    strict = F.col("reason").isin("document", "not_ready", "missing_document", "ambiguous") | (follows & F.col("prior_strict"))
    query = F.when(follows, F.concat(F.left("previous", F.lit(160)), F.lit("\n追问："), "question")).otherwise(F.col("question"))
    return out.select("question_id", "reason", strict.alias("strict"), F.array_sort(docs).alias("documents"), cols.alias("collections"), query.alias("query"))


def choose_probed(probe: DataFrame, least: float = 2.0) -> DataFrame:
    """question_id and probed: the collections within 0.72 of each question's best by words, best first; none if that is below `least`."""
    best = probe.groupBy("question_id", "collection_id").agg(F.max("score").alias("score"))
    top = Window.partitionBy("question_id")
    near = best.withColumn("_best", F.max("score").over(top))
    keep = (F.col("_best") >= least) & (F.col("score") >= 0.72 * F.col("_best"))
    ordered = F.array_sort(F.collect_list(F.when(keep, F.struct((-F.col("score")).alias("s"), "collection_id"))))
    return near.groupBy("question_id").agg(F.transform(ordered, lambda x: x["collection_id"]).alias("probed"))
