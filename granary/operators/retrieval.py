"""Hybrid retrieval: dense and lexical recall, rank fusion, scopes, budgets."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions import text as X
from granary.operators.joins import neighbours
from granary.plans.table_plan import PlanError
from granary.sources.files import kept


@dataclass(frozen=True)
class Scope:
    """What a search may see; an empty tuple is everything of that kind."""

    collections: tuple = ()
    documents: tuple = ()
    disabled: bool = False

    def condition(self, collection: str = "collection_id", document: str = "document_id") -> Column:
        parts = [F.col(c).isin(sorted(set(v))) for c, v in ((collection, self.collections), (document, self.documents)) if v]
        return F.lit(False) if self.disabled else reduce(lambda a, b: a & b, parts, F.lit(True))


def check_k(k: int, most: int = 20) -> int:
    if not 1 <= k <= most:
        raise PlanError(f"k is between 1 and {most}")
    return k


def dense_topk(vectors: DataFrame, query: list[float], k: int, min_score: float = 0.3, id_col: str = "id", vector_col: str = "embedding", scope: Column | None = None, over: int = 1) -> DataFrame:
    """id and score of the k nearest by exact cosine: the scope first, then the k x over best, then the threshold, then k.
    Ties by id. The scan sends each task's best only."""
    q = F.array(*[F.lit(float(x)) for x in query])
    seen = vectors.where(scope) if scope is not None else vectors
    scored = seen.select(F.col(id_col).alias("id"), X.cosine(F.col(vector_col), q).alias("score"))
    best = scored.orderBy(F.desc("score"), "id").limit(k * over)
    return best.where(F.col("score") >= min_score).orderBy(F.desc("score"), "id").limit(k)


def topk_by_group(rows: DataFrame, group: str, k: int, score: str = "score", id_col: str = "id") -> DataFrame:
    """The k best of each group, with rank; Spark keeps each task's k best of a group before it shuffles."""
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(F.desc(score), id_col)))
    return ranked.where(F.col("rank") <= k)


def inverted_index(chunks: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """id, term and tf."""
    return chunks.select(F.col(id_col).alias("id"), F.explode(X.routing_words(F.col(text_col))).alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf"))


def lexical_scores(chunks: DataFrame, terms: list[str], id_col: str = "id", text_col: str = "text") -> DataFrame:
    """id and score: the sum over query terms of weight * (1 + ln(1 + N / df)) * tf. Only rows of the query's terms leave the
    scan; document frequencies are of at most as many terms as the query has."""
    wanted = F.filter(X.routing_words(F.col(text_col)), lambda w: w.isin(sorted(set(terms))))  # before they become rows
    index = kept(chunks.select(F.col(id_col).alias("id"), F.explode(wanted).alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf")))  # texts are read once
    df = index.groupBy("term").agg(F.count("*").alias("df"))
    n = chunks.agg(F.count("*").alias("n"))
    weights = df.crossJoin(n).select("term", (X.term_weight(F.col("term")) * (1 + F.log(1 + F.col("n") / F.col("df")))).alias("weight"))
    return index.join(F.broadcast(weights), "term").groupBy("id").agg(F.sum(F.col("weight") * F.col("tf")).alias("score"))


def lexical_topk(chunks: DataFrame, terms: list[str], k: int, id_col: str = "id", text_col: str = "text") -> DataFrame:
    return lexical_scores(chunks, terms, id_col, text_col).where("score > 0").orderBy(F.desc("score"), "id").limit(k)


def fuse(*lists: DataFrame, k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of lists of id and score (top-k lists: a rank needs all of a list in one place)."""
    order = Window.orderBy(F.desc("score"), "id")
    parts = [x.select("id", (1 / (k + F.row_number().over(order))).alias("part")) for x in lists]
    return reduce(DataFrame.unionByName, parts).groupBy("id").agg(F.sum("part").alias("score")).orderBy(F.desc("score"), "id")


def load(hits: DataFrame, chunks: DataFrame, ready: DataFrame, k: int, scope: Scope | None = None) -> DataFrame:
    """The chunks of the first k hits (id, rank) that are in scope and of ready documents, in rank order. Hits are a top-k list."""
    allowed = chunks.where((scope or Scope()).condition()).join(ready, "document_id", "left_semi")
    return allowed.join(F.broadcast(hits.where(F.col("rank") <= k)), "id").orderBy("rank").limit(k)


def interleave(branches: DataFrame, k: int) -> DataFrame:
    """branch, rank, id lists as one: rank by rank, branch by branch, each id once, k in all."""
    once = branches.groupBy("id").agg(F.min(F.struct("rank", "branch")).alias("at"))
    return once.select("id", F.col("at.rank").alias("rank"), F.col("at.branch").alias("branch")).orderBy("rank", "branch", "id").limit(k)


def anchored_tables(chunks: DataFrame, query: str, k: int = 8) -> DataFrame:
    """Chunks with a caption line of the one table that the query names."""
    number = F.regexp_replace(X.table_reference(F.lit(query)), r"\.", r"\\.")
    pattern = F.concat(F.lit(r"(?im)^(?:Table\s*|表\s*)"), number, F.lit(r"([^A-Za-z0-9.]|$)"))
    return chunks.where(F.coalesce(F.regexp_like("content", pattern), F.lit(False))).orderBy("ordinal", "id").limit(k)


def exact_rows_first(ranked: DataFrame, query: str, k: int) -> DataFrame:
    """Chunks (id, rank, content) with a table row whose label is in the query come first, by rank, then the others."""
    lines = F.filter(F.split("content", "\n"), lambda x: F.trim(x).startswith("|"))
    labels = F.transform(F.slice(lines, F.lit(3), F.greatest(F.size(lines), F.lit(1))), lambda x: F.trim(F.split(x, r"\|")[1]))
    edge = r"[A-Za-z0-9_.+\-]"
    named = F.exists(labels, lambda x: F.length(x).between(2, 80) & x.rlike(r"\p{L}") & F.regexp_like(F.lit(query), F.concat(F.lit(rf"(?i)(?<!{edge})\Q"), x, F.lit(rf"\E(?!{edge})"))))
    return ranked.withColumn("_named", F.coalesce(named, F.lit(False))).orderBy(F.desc("_named"), "rank").limit(k).drop("_named")


def rerank(candidates: DataFrame, scorer=None, top_n: int = 20, min_score: float = 0.15) -> DataFrame:
    """candidates (id, rank, text) by an outside scorer, a function of the text column; without one the order stays."""
    if scorer is None:
        return candidates.orderBy("rank").limit(top_n)
    return candidates.withColumn("score", scorer(F.col("text"))).where(F.col("score") >= min_score).orderBy(F.desc("score"), "rank").limit(top_n)


def within_budget(items: DataFrame, group: str, order: list[str], size: str, budget: int, most: int = 1 << 30) -> DataFrame:
    """Items of each group in order, each taken if it still fits; those that don't are passed over. An item's fate hangs on all
    before it, so each group (one query's list) is folded in its own array."""
    row = F.struct(*[F.col(c) for c in (*order, *[c for c in items.columns if c not in order and c != group])])
    taken = F.aggregate(
        F.array_sort(F.collect_list(row)),
        F.struct(F.lit(0).cast("long").alias("used"), F.array().cast(f"array<{_struct_type(items, order, group)}>").alias("kept")),
        lambda s, x: F.when((s["used"] + x[size] <= budget) & (F.size(s["kept"]) < most), F.struct((s["used"] + x[size]).cast("long").alias("used"), F.concat(s["kept"], F.array(x)).alias("kept"))).otherwise(s),
        lambda s: s["kept"],
    )
    return items.groupBy(group).agg(taken.alias("kept")).select(group, F.explode("kept").alias("x")).select(group, "x.*")


def _struct_type(items: DataFrame, order: list[str], group: str) -> str:
    names = (*order, *[c for c in items.columns if c not in order and c != group])
    return "struct<" + ",".join(f"`{c}`:{items.schema[c].dataType.simpleString()}" for c in names) + ">"


def document_evidence(chunks: DataFrame, ranked: DataFrame, identifiers: list[str], budget: int = 12_000, whole: int = 6_000, k: int = 5, min_score: float = 0.3) -> DataFrame:
    """Per document (document_id, ordinal, content): all of a short one; else its k best chunks with a score of min_score or more
    and those with an identifier of the question, with their neighbours for the latter, in order, within the budget."""
    size = chunks.groupBy("document_id").agg(F.sum(F.length("content")).alias("_chars"))
    best = topk_by_group(ranked.where(F.col("score") >= min_score).withColumn("id", F.col("ordinal")), "document_id", k).select("document_id", "ordinal")
    exact = reduce(lambda a, b: a | b, [F.contains(F.lower("content"), F.lit(i.lower())) for i in identifiers], F.lit(False))
    near = neighbours(chunks.where(exact), chunks, "document_id", "ordinal").select("document_id", "ordinal")
    wanted = best.union(near).distinct().withColumn("_wanted", F.lit(True))
    joined = chunks.join(size, "document_id").join(wanted, ["document_id", "ordinal"], "left")
    chosen = joined.where((F.col("_chars") <= whole) | F.col("_wanted")).select("document_id", "ordinal", "content", F.when(F.col("_chars") <= whole, 0).otherwise(F.length("content")).alias("size"))
    return within_budget(chosen, "document_id", ["ordinal"], "size", budget).drop("size")


#: Bytes of query vectors that one pass over the vectors takes along, and numbers of one product of blocks.
MOST_BYTES = 32 << 20
_PRODUCT = 1 << 21


def blocked_topk(vectors: DataFrame, queries: DataFrame, k: int, min_score: float = 0.3, keys: tuple[str, ...] = ("query_id",), id_col: str = "id", vector_col: str = "embedding", query_col: str = "q", most_bytes: int = MOST_BYTES) -> DataFrame:
    """keys, id, score (to 12 decimals) and rank of the k nearest vectors of every query by exact cosine, from min_score on; ties by id.

    Queries are taken in groups of up to about most_bytes. A pass over the vectors multiplies its batches with a group's matrix, block by
    block, and each task keeps the k best of a query as it goes, so tasks send k rows for a query and no pair is ever a row. With
    several groups each pass is stored before the next. Rows and queries without a finite vector of the queries' length are left out.
    """
    asked = queries.where(X.valid_vector(F.col(query_col))).select(*keys, F.transform(query_col, lambda x: x.cast("double")).alias("_q"))
    shape = asked.agg(F.count("*").alias("n"), F.min(F.size("_q")).alias("least"), F.max(F.size("_q")).alias("most")).first()
    if shape["least"] != shape["most"]:
        raise PlanError("queries must have vectors of one length")
    groups = max(1, -(-shape["n"] * (shape["most"] or 1) * 8 // most_bytes))
    rows = vectors.where(X.valid_vector(F.col(vector_col), shape["most"] or 1)).select(F.col(id_col).alias("id"), F.transform(vector_col, lambda x: x.cast("double")).alias("v"))
    found = []
    for g in range(groups):
        mine = asked.where(F.pmod(F.xxhash64(*keys), F.lit(groups)) == g) if groups > 1 else asked
        sent = vectors.sparkSession.sparkContext.broadcast(_matrix(mine.toArrow()))
        part = rows.mapInArrow(_nearest(sent, k, min_score), _nearest_schema(rows, queries, keys))
        if groups > 1:
            part = kept(part)
            sent.destroy()
        found.append(part)
    best = Window.partitionBy(*keys).orderBy(F.desc("score"), "id")
    return reduce(DataFrame.unionByName, found).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _matrix(queries: pa.Table):
    names = [c for c in queries.schema.names if c != "_q"]
    flat = queries.column("_q").combine_chunks()
    flat = (flat.flatten() if len(flat) else pa.array([], pa.float64())).to_numpy(zero_copy_only=False)
    matrix = flat.reshape(queries.num_rows, -1 if queries.num_rows else 0)
    norm = np.sqrt((matrix * matrix).sum(1))
    return queries.select(names).combine_chunks(), matrix / np.where(norm == 0, 1, norm)[:, None]


def _nearest_schema(rows: DataFrame, queries: DataFrame, keys: tuple[str, ...]) -> str:
    kinds = [f"`{c}` {queries.schema[c].dataType.simpleString()}" for c in keys]
    return ", ".join([*kinds, f"id {rows.schema['id'].dataType.simpleString()}", "score double"])


def _nearest(sent, k: int, min_score: float):
    """The k best of each query among a task's rows: candidates of a batch beat the k-th best so far, and are cut to k after each block."""

    def run(batches):
        keys, matrix = sent.value
        n = len(matrix)
        query, score, ids = np.zeros(0, np.int64), np.zeros(0), None
        least = np.full(n, min_score)
        for batch in batches:
            if not batch.num_rows or not n:
                continue
            points = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            norm = np.sqrt((points * points).sum(1))
            points = points / np.where(norm == 0, 1, norm)[:, None]
            names = batch.column(0).to_numpy(zero_copy_only=False)
            width = max(1, _PRODUCT // batch.num_rows)
            for a in range(0, n, width):
                cos = np.round(points @ matrix[a : a + width].T, 12)
                row, at = np.nonzero(cos >= least[a : a + width])
                if len(row):
                    query, score = np.append(query, at + a), np.append(score, cos[row, at])
                    ids = names[row] if ids is None else np.append(ids, names[row])
            order = np.lexsort((ids if ids is not None else query, -score, query))
            place = np.arange(len(order)) - np.searchsorted(query[order], query[order])
            order = order[place < k]
            query, score = query[order], score[order]
            ids = ids[order] if ids is not None else None
            full = np.flatnonzero(np.bincount(query, minlength=n) == k)
            least[full] = score[np.searchsorted(query, full, "right") - 1]
        if ids is not None:
            at = pa.array(query)
            yield pa.RecordBatch.from_arrays([*(c.combine_chunks().take(at) if isinstance(c, pa.ChunkedArray) else c.take(at) for c in keys.columns), pa.array(ids), pa.array(score)], names=[*keys.schema.names, "id", "score"])

    return run


def fan_out(vectors: DataFrame, branches: DataFrame, k: int, per_branch: int | None = None, min_score: float = 0.3, **how) -> DataFrame:
    """question_id, rank and id: the sub-questions of each question (question_id, branch, q) searched together, in one pass over the vectors, and
    their lists taken rank by rank and branch by branch, each id once, k in all."""
    found = blocked_topk(vectors, branches, per_branch or k, min_score, keys=("question_id", "branch"), **how)
    once = found.groupBy("question_id", "id").agg(F.min(F.struct("rank", "branch")).alias("at"))
    place = F.row_number().over(Window.partitionBy("question_id").orderBy("at.rank", "at.branch", "id"))
    return once.select("question_id", place.alias("rank"), "id").where(F.col("rank") <= k)
