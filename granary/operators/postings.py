"""A stored inverted index: posting lists in blocks by impact, added to in batches and merged without the texts.

A block holds up to BLOCK postings of one term, in descending frequency, and says its greatest. Blocks are partitioned by the term's hash, so a query
reads the folders of its terms alone. The live batches are what the pointers of a Commits name.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions import text as X
from granary.sources.commits import Commits

BLOCK = 1024
BUCKETS = 64


def words(docs: DataFrame) -> DataFrame:
    """id, term and tf of documents (id, text), by routing words."""
    return docs.select("id", F.explode(X.routing_words(F.col("text"))).alias("term")).groupBy("id", "term").agg(F.count("*").cast("int").alias("tf"))


_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    """For each code point whether it is a letter or digit; made once in each worker."""
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalnum() for c in range(0x110000)), bool, 0x110000))
    return _letters[0]


def bigrams(docs: DataFrame) -> DataFrame:
    """id, term and tf of documents (id, text): every two letters or digits in a row, of any script, in lower case. A document is one row's
    work in a task, and nothing is shuffled."""
    kind = docs.schema["id"].dataType.simpleString()

    def count(batches):
        known = _is_letter()
        for batch in batches:
            of, terms, tfs = [], [], []
            for k, text in enumerate(batch.column(1).to_pylist()):
                codes = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)
                inside = known[codes]
                at = np.flatnonzero(inside[:-1] & inside[1:])
                pairs, n = np.unique(codes[at].astype(np.uint64) << np.uint64(32) | codes[at + 1], return_counts=True)
                if not len(pairs):
                    continue
                two = np.stack([pairs >> np.uint64(32), pairs & np.uint64(0xFFFFFFFF)], 1).astype(np.uint32)
                of.append(np.full(len(pairs), k))
                terms.append(np.ascontiguousarray(two).view("<U2").ravel())
                tfs.append(n.astype(np.int32))
            rows = pa.array(np.concatenate(of) if of else [], pa.int64())
            made = [batch.column(0).take(rows), pa.array(np.concatenate(terms).tolist() if terms else [], pa.string()), pa.array(np.concatenate(tfs) if tfs else [], pa.int32())]
            yield pa.RecordBatch.from_arrays(made, names=["id", "term", "tf"])

    return docs.select("id", F.lower("text").alias("text")).mapInArrow(count, f"id {kind}, term string, tf int")


def text_bigrams(text: str) -> list[str]:
    """The distinct bigrams of a query, as bigrams() has them."""
    low = text.lower()
    return sorted({a + b for a, b in zip(low, low[1:], strict=False) if a.isalnum() and b.isalnum()})


class Postings:
    """An index of (id, term, tf) in the shared folder `root`. id_type is the ids' Spark type."""

    def __init__(self, spark: SparkSession, root: str, id_type: str = "long", buckets: int = BUCKETS, block: int = BLOCK) -> None:
        self.spark, self.buckets, self.block = spark, buckets, block
        self.id_type = id_type
        self.commits = Commits(spark, root, f"batch long, bucket int, term string, most int, n int, ids array<{id_type}>, tfs array<int>", ["batch"], ("bucket",))

    def add(self, docs: DataFrame, terms: Callable[[DataFrame], DataFrame] = words) -> int:
        """Indexes documents (id, text) that are not in it yet, as a batch of their own; gives the batch's number. Its status is their count."""
        number = self.commits.version() + 1
        attempt = self.commits.stage(self._blocks(terms(docs), number))
        self._point([(number, str(docs.count()), attempt)], number)
        return number

    def _blocks(self, postings: DataFrame, number: int) -> DataFrame:
        """The postings dealt out by range of (bucket, term, frequency), so that a term of any number of documents is spread over tasks."""
        bucket = F.pmod(F.xxhash64("term"), F.lit(self.buckets)).cast("int")
        order = ["bucket", "term", F.desc("tf"), "id"]
        dealt = postings.select(bucket.alias("bucket"), "term", "tf", "id").repartitionByRange(*order).sortWithinPartitions(*order)
        most = self.block

        def pack(batches):
            held = None
            for batch in batches:
                held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])]).combine_chunks()
                yield from cut(held, False)
                held = held.slice(done[0])
            if held is not None:
                yield from cut(held, True)

        done = [0]

        def cut(rows: pa.Table, last: bool):
            """Blocks of the rows; the last term's unfinished block waits for the next batch unless this is the last one."""
            n = rows.num_rows
            term = rows.column("term").combine_chunks().dictionary_encode().indices.to_numpy()
            first = np.flatnonzero(np.diff(term, prepend=-1))
            ends = np.append(first[1:], n)
            starts = np.concatenate([np.arange(a, b, most) for a, b in zip(first.tolist(), ends.tolist(), strict=True)]) if n else np.zeros(0, np.int64)
            if len(starts) and not last and n - starts[-1] < most:
                starts = starts[:-1]
            stops = np.minimum(starts + most, ends[np.searchsorted(first, starts, "right") - 1]) if len(starts) else starts
            if not last:
                done[0] = int(stops[-1]) if len(stops) else 0
            if not len(starts):
                return
            tfs, ids = rows.column("tf").combine_chunks(), rows.column("id").combine_chunks()
            upto = int(stops[-1])
            offsets = pa.array(np.append(starts, upto), pa.int32())
            at = pa.array(starts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(starts), number), pa.int64()), rows.column("bucket").combine_chunks().take(at), rows.column("term").combine_chunks().take(at), tfs.take(at), pa.array(stops - starts, pa.int32()), pa.ListArray.from_arrays(offsets, ids.slice(0, upto)), pa.ListArray.from_arrays(offsets, tfs.slice(0, upto))],
                names=["batch", "bucket", "term", "most", "n", "ids", "tfs"],
            )

        return dealt.mapInArrow(pack, f"batch long, bucket int, term string, most int, n int, ids array<{self.id_type}>, tfs array<int>")

    def _point(self, rows: list[tuple], version: int) -> None:
        """Pointers of batches in one file, so that all of them count from the same moment."""
        made = self.spark.createDataFrame(rows, "batch long, status string, attempt string").coalesce(1)
        made.select("batch", "status", "attempt", F.lit(version).cast("long").alias("version")).write.mode("append").parquet(f"{self.commits.root}/pointers")

    def live(self) -> list:
        """The batches that count, oldest first: batch, status (number of documents) and attempt. One row for each batch, few after merges."""
        return self.commits.pointers().where("attempt is not null").orderBy("batch").collect()

    def merge(self, fanout: int = 2) -> int | None:
        """Makes one batch of the newest live ones, as long as the one before holds less than `fanout` times the documents of those after it: batches of
        one size never pile up, and each posting is rewritten a logarithmic number of times. Blocks are merged, not texts. Gives the
        new batch's number, None if nothing is due."""
        live = self.live()
        take, total = 1, int(live[-1]["status"]) if live else 0
        while take < len(live) and int(live[-take - 1]["status"]) < fanout * max(1, total):
            total += int(live[-take - 1]["status"])
            take += 1
        if take < 2:
            return None
        old = live[-take:]
        number = self.commits.version() + 1
        opened = self._staged([r["attempt"] for r in old]).select("term", F.explode(F.arrays_zip("ids", "tfs")).alias("x")).select("term", F.col("x.ids").alias("id"), F.col("x.tfs").alias("tf"))
        attempt = self.commits.stage(self._blocks(opened, number))
        self._point([(number, str(total), attempt), *[(r["batch"], "MERGED", None) for r in old]], number)
        return number

    def _staged(self, attempts: list[str]) -> DataFrame:
        return self.commits.staged().where(F.col("attempt").isin(attempts))

    def blocks(self, terms: list[str]) -> DataFrame:
        """The live blocks of some terms; only their buckets of the live batches are read."""
        wanted = self.spark.createDataFrame([(t,) for t in terms], "term string").select(F.pmod(F.xxhash64("term"), F.lit(self.buckets)).cast("int").alias("b")).distinct()
        buckets = [r["b"] for r in wanted.collect()]
        return self._staged([r["attempt"] for r in self.live()]).where(F.col("bucket").isin(buckets) & F.col("term").isin(terms))

    def _plan(self, terms: list[str], k: int) -> tuple[DataFrame, dict[str, float], dict[str, float]]:
        """The terms' blocks, the terms' weights, and for each term the frequency from which on its blocks can hold one of the k best."""
        blocks = self.blocks(terms)
        n = sum(int(r["status"]) for r in self.live())
        levels: dict[str, list] = {}
        for r in blocks.groupBy("term", "most").agg(F.sum("n").alias("n")).collect():  # a row for each term and frequency of blocks
            levels.setdefault(r["term"], []).append((r["most"], r["n"]))
        weight = {t: (3.0 if t[:1].isascii() else 1.0) * (1 + float(np.log(1 + n / sum(c for _, c in ls)))) for t, ls in levels.items()}
        top = {t: max(m for m, _ in ls) for t, ls in levels.items()}
        first = {}
        for t, ls in levels.items():
            seen, ls = 0, sorted(ls, reverse=True)
            for m, c in ls:
                first[t], seen = m, seen + c
                if seen >= k:
                    break
        sums = self._sums(self._from(blocks, first), weight).orderBy(F.desc("score")).limit(k).agg(F.min("score"), F.count("*")).first()
        least = sums[0] * (1 - 1e-9) if sums[1] == k else 0.0
        others = {t: sum(weight[u] * top[u] for u in top if u != t) for t in top}
        return blocks, weight, {t: (least - others[t]) / weight[t] for t in top}

    @staticmethod
    def _from(blocks: DataFrame, least: dict[str, float]) -> DataFrame:
        keep = F.lit(False)
        for t, m in least.items():
            keep = keep | ((F.col("term") == t) & (F.col("most") >= m))
        return blocks.where(keep)

    @staticmethod
    def _sums(blocks: DataFrame, weight: dict[str, float]) -> DataFrame:
        w = F.lit(0.0)
        for t, x in weight.items():
            w = F.when(F.col("term") == t, x).otherwise(w)
        each = blocks.select(w.alias("w"), F.explode(F.arrays_zip("ids", "tfs")).alias("x")).select(F.col("x.ids").alias("id"), (F.col("w") * F.col("x.tfs")).alias("s"))
        return each.groupBy("id").agg(F.sum("s").alias("score"))

    def needed(self, terms: list[str], k: int) -> DataFrame:
        """The blocks that topk() opens."""
        blocks, _, least = self._plan(sorted(set(terms)), k)
        return self._from(blocks, least)

    def topk(self, terms: list[str], k: int) -> DataFrame:
        """id and score of the k best: the sum over the query's distinct terms of weight * (1 + ln(1 + N / df)) * tf; ties by id.

        Each term's blocks of the greatest frequencies give the k-th best score so far. A document that reaches it has in each of its terms a
        block whose greatest impact, with the most that all other terms could add, reaches it too; so only such blocks are opened, and of
        the documents that count none is missed or summed in part. Fewer terms or documents than asked for give what there is.
        """
        blocks, weight, least = self._plan(sorted(set(terms)), k)
        return self._sums(self._from(blocks, least), weight).where("score > 0").orderBy(F.desc("score"), "id").limit(k)
