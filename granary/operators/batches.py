"""Arrow batches in portions: what a worker holds is bounded by the bytes of some texts, not by a number of rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

#: Bytes of text that are worked on at a time.
PORTION = 1 << 20


def small_batches(spark: SparkSession, most: str = "8m") -> None:
    """Has Spark send workers batches of 8 MB, unless the session was given another bound than Spark's own 64 MB."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name).rstrip("b") in (str(64 << 20), "64m"):
        spark.conf.set(name, most)


def portions(batch: pa.RecordBatch, column: int, most: int = PORTION) -> Iterator[pa.RecordBatch]:
    """The rows in order, in slices of up to `most` bytes in a text column; one row at least."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(ends, before + most, "right")))
        yield batch.slice(at, end - at)
        at = end
    pa.default_memory_pool().release_unused()
