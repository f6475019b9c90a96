"""Two-step commits over Parquet: rows are staged in files of their own, then a pointer for each key says which of them count.

A pointer is one row, so of a key readers see either all of a commit (its rows and its status) or nothing of it. What a killed batch
staged is named by no pointer. Pointers have versions; of a key the greatest counts, so commits never change a file.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Commits:
    """A table of rows (`schema`, with the columns of `key`) and a status for each key, in the shared folder `root`."""

    def __init__(self, spark: SparkSession, root: str, schema: str, key: list[str], partition_by: tuple[str, ...] = ()) -> None:
        self.spark, self.root, self.key, self.partition_by = spark, root.rstrip("/"), key, partition_by
        empty = spark.createDataFrame([], schema)
        self.columns = empty.columns
        self._rows_schema = empty.withColumn("attempt", F.lit("")).schema
        kinds = ", ".join(f"`{c}` {empty.schema[c].dataType.simpleString()}" for c in key)
        self._pointers_schema = f"{kinds}, status string, attempt string, version long"

    def _read(self, path: str, schema) -> DataFrame:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        there = folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(folder)
        return self.spark.read.schema(schema).parquet(path) if there else self.spark.createDataFrame([], schema)

    def stage(self, rows: DataFrame) -> str:
        """Writes rows that no reader sees yet; gives the attempt's name."""
        attempt = uuid.uuid4().hex
        rows.select(self.columns).write.partitionBy(*self.partition_by).parquet(f"{self.root}/rows/attempt={attempt}")
        return attempt

    def commit(self, pointers: DataFrame, attempt: str | None, version: int | None = None) -> int:
        """Makes an attempt's rows (None: no rows) those of the keys in `pointers` (key columns and status), all in a version above those
        before. To commit a version again with the same keys changes nothing but which try it names."""
        if version is None:
            version = self.version() + 1
        made = pointers.select(*self.key, "status", F.lit(attempt).cast("string").alias("attempt"), F.lit(version).cast("long").alias("version"))
        made.write.mode("append").parquet(f"{self.root}/pointers")
        return version

    def version(self) -> int:
        found = self._read(f"{self.root}/pointers", self._pointers_schema).agg(F.max("version")).first()[0]
        return -1 if found is None else found

    def pointers(self) -> DataFrame:
        """The key columns, status, attempt and version of every key."""
        rows = self._read(f"{self.root}/pointers", self._pointers_schema)
        last = F.max(F.struct("version", "attempt", "status")).alias("last")
        return rows.groupBy(*self.key).agg(last).select(*self.key, "last.status", "last.attempt", "last.version")

    def staged(self) -> DataFrame:
        """All rows with their attempt, whether they count or not."""
        return self._read(f"{self.root}/rows", self._rows_schema)

    def rows(self) -> DataFrame:
        """The rows that count."""
        live = self.pointers().where("attempt is not null").select(*self.key, "attempt")
        return self.staged().join(live, [*self.key, "attempt"], "left_semi").select(self.columns)

    def orphans(self) -> DataFrame:
        """Attempts that no pointer names any more: what killed and replaced batches left."""
        return self.staged().select("attempt").distinct().join(self.pointers().select("attempt").distinct(), "attempt", "left_anti")
