"""Join shapes on keys: visibility, resumption, differences, neighbours and as-of lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def visible(rows: DataFrame, documents: DataFrame, key: str, ready: Column) -> DataFrame:
    """Rows of documents that are ready."""
    return rows.join(documents.where(ready).select(key), key, "left_semi")


def missing(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows without a counterpart: what is left to do after an interruption."""
    return rows.join(done.select(key), key, "left_anti")


def first_of_each(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key by an order that leaves no ties."""
    return rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rank = 1").drop("_rank")


def manifest_diff(found: DataFrame, stored: DataFrame, key: str = "source_key", fingerprint: str = "fingerprint") -> DataFrame:
    """key and change: added, updated, unchanged or removed."""
    a = found.select(key, F.col(fingerprint).alias("_new"), F.lit(True).alias("_found"))
    b = stored.select(key, F.col(fingerprint).alias("_old"), F.lit(True).alias("_stored"))
    change = F.when(F.col("_stored").isNull(), "added").when(F.col("_found").isNull(), "removed").when(F.col("_new").eqNullSafe(F.col("_old")), "unchanged").otherwise("updated")
    return a.join(b, key, "full_outer").select(key, change.alias("change"))


def neighbours(hits: DataFrame, rows: DataFrame, key: str, position: str, reach: int = 1) -> DataFrame:
    """The rows up to `reach` places beside a hit, hits included, once each."""
    around = hits.select(key, F.explode(F.sequence(F.col(position) - reach, F.col(position) + reach)).alias(position)).distinct()
    return rows.join(around, [key, position], "left_semi")


def containing(spans: DataFrame, places: DataFrame, key: str) -> DataFrame:
    """For each place (key, start, end) the first span (key, ordinal, start, end) of the same key that holds it; -1 if none.
    The key bounds the range join."""
    s = spans.select(key, "ordinal", F.col("start").alias("_from"), F.col("end").alias("_to"))
    hit = (F.col("_from") <= F.col("start")) & (F.col("end") <= F.col("_to"))
    found = places.join(s, key, "left").groupBy(*places.columns).agg(F.min(F.when(hit, F.col("ordinal"))).alias("ordinal"))
    return found.withColumn("ordinal", F.coalesce("ordinal", F.lit(-1)))


def as_of(anchors: DataFrame, places: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """For each place the value of the last anchor at or before it; of the first anchor if none is: by a union and two
    windows, so that nothing grows with the product of the two."""
    both = anchors.select(key, F.col(at), F.col(value), F.lit(0).alias("_place"), F.lit(None).cast("long").alias("_id")).unionByName(
        places.select(key, F.col(at), F.lit(None).cast(anchors.schema[value].dataType).alias(value), F.lit(1).alias("_place"), F.monotonically_increasing_id().alias("_id"))
    )
    before = Window.partitionBy(key).orderBy(at, "_place").rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy(key).orderBy(at, "_place").rowsBetween(0, Window.unboundedFollowing)
    return both.withColumn(value, F.coalesce(F.last(value, True).over(before), F.first(value, True).over(after))).where("_place = 1").select(key, at, value)


def priced(usage: DataFrame, models: DataFrame) -> DataFrame:
    """usage(model, input_tokens, output_tokens, ...) with cost: the enabled model of that name or model_name, defaults first,
    then by sort_order; each part is rounded half up to four places before they are added; 0 without a model."""
    on = models.where("enabled")
    names = on.select(F.col("name").alias("model"), "*").unionByName(on.where("name <> model_name").select(F.col("model_name").alias("model"), "*"))
    best = first_of_each(names, ["model"], F.col("is_default").desc(), F.col("sort_order"), F.col("id")).select("model", "input_price", "output_price")
    part = lambda tokens, price: F.round(F.col(tokens).cast("decimal(18,0)") * F.col(price).cast("decimal(10,6)") / 1000, 4)
    cost = F.coalesce(part("input_tokens", "input_price") + part("output_tokens", "output_price"), F.lit(0)).cast("decimal(18,4)")
    return usage.join(best, "model", "left").withColumn("cost", cost).drop("input_price", "output_price")
