"""Shards by a Feistel permutation of global row numbers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import mix, pick, stored


class Permutation:
    """A keyed permutation of 0 .. n - 1: a balanced Feistel network on the least even number of bits that holds n, walked
    along its cycle until it is below n again. The domain is under four times n, so a walk takes four steps on average."""

    def __init__(self, n: int, seed: int = 0, rounds: int = 6) -> None:
        if n < 1 or rounds < 3:
            raise ValueError("at least one row and three rounds are needed")
        self.n, self.half = n, np.uint64(max(1, ((n - 1).bit_length() + 1) // 2))
        self.mask = np.uint64((1 << int(self.half)) - 1)
        self.keys = mix(np.arange(1, rounds + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed % 2**64))

    def _once(self, x: np.ndarray, keys) -> np.ndarray:
        left, right = x >> self.half, x & self.mask
        for key in keys:
            left, right = right, left ^ (mix(right + key) & self.mask)
        return (right << self.half) | left  # the halves changed places: the same network with the keys reversed undoes it

    def _walk(self, x, keys) -> np.ndarray:
        y = self._once(np.asarray(x, np.uint64), keys)
        while (far := y >= np.uint64(self.n)).any():
            y[far] = self._once(y[far], keys)
        return y.astype(np.int64)

    def __call__(self, x) -> np.ndarray:
        return self._walk(x, self.keys)

    def inverse(self, y) -> np.ndarray:
        return self._walk(y, self.keys[::-1])


def global_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size (UTF-8 bytes), text_crc32 and row: the place of each row in the order of (doc_id, text's hash), nulls first.

    The rows are dealt out by range, written to the shared folder with their place within their partition, and joined
    with the partitions' first places: one row for each partition. Equal rows are told apart by their place in the
    input so that any number of them can be split over partitions; they are interchangeable in the result.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = pick(docs, doc_id=id_col, text=text_col).select(
        "doc_id", F.octet_length(text).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("_hash"), F.monotonically_increasing_id().alias("_tie")
    )
    order = [F.col(c).asc_nulls_first() for c in ("doc_id", "_hash", "_tie")]
    placed = stored(
        narrow.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "size", "text_crc32", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_at")), "rows"
    )
    counts = placed.groupBy("_part").count()
    before = F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    firsts = counts.select("_part", F.coalesce(before, F.lit(0)).alias("_first"))
    return placed.join(firsts, "_part").select("doc_id", "size", "text_crc32", (F.col("_first") + F.col("_at")).alias("row"))


def shard_rows(docs: DataFrame, shards: int = 16, seed: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of each row.

    place = Permutation(number of rows, seed)(row); shard = place mod shards, slot = place div shards. So shards differ by
    one row at most, slots have no gaps, and either direction is computable without a table. The same rows give the same
    result however they are partitioned. Null ids are numbered first; a null text has size 0; equal rows each have a
    place of their own; no rows give none.
    """
    if shards < 1:
        raise ValueError("at least one shard is needed")
    rows = stored(global_rows(docs, id_col, text_col), "numbered")
    n = rows.count()
    permute = Permutation(max(1, n), seed)
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def deal(batches):
        for b in batches:
            place = permute(b.column(3).to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array((place % shards).astype(np.int32)), pa.array(place // shards)], names=["doc_id", "size", "text_crc32", "shard", "slot"])

    return rows.mapInArrow(deal, f"doc_id {id_type}, size long, text_crc32 long, shard int, slot long")
