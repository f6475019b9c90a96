"""Queries over the standard tables, by subject."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class Catalog(dict):
    """name -> (function of (spark, sf_dir), SQL or None)."""

    def add(self, sql: str | None = None) -> Callable:
        def register(run: Callable[[SparkSession, str], DataFrame]) -> Callable:
            self[run.__name__] = (run, sql)
            return run

        return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
