"""Staged rows and pointers; embedding that is interrupted."""

import pytest
from pyspark.sql import functions as F

from granary.operators import embedding as B
from granary.sources.commits import Commits


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_nothing_is_seen_before_its_pointer(spark, tmp_path):
    table = Commits(spark, str(tmp_path / "t"), "document_id string, ordinal int, content string", ["document_id"])
    assert rows(table.rows()) == [] == rows(table.pointers()) and table.version() == -1
    first = table.stage(spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "document_id string, ordinal int, content string"))
    assert rows(table.rows()) == [] and [r.attempt for r in table.orphans().collect()] == [first]
    table.commit(spark.createDataFrame([("a", "READY")], "document_id string, status string"), first)
    assert rows(table.rows()) == [("a", 1, "x"), ("a", 2, "y")] and rows(table.pointers().select("document_id", "status")) == [("a", "READY")]  # b's rows were not committed

    class Killed(Exception):
        pass

    @F.udf("string")
    def fails(content):
        raise Killed

    killed = spark.createDataFrame([("a", 1, "new")], "document_id string, ordinal int, content string")
    with pytest.raises(Exception):  # noqa: B017
        table.stage(killed.withColumn("content", fails("content")))
    table.stage(killed)  # killed after staging, before the commit
    assert rows(table.rows()) == [("a", 1, "x"), ("a", 2, "y")] and table.version() == 0
    again = table.stage(killed)
    assert table.commit(spark.createDataFrame([("a", "READY"), ("c", "FAILED")], "document_id string, status string"), again) == 1
    assert rows(table.rows()) == [("a", 1, "new")] and rows(table.pointers().select("document_id", "status")) == [("a", "READY"), ("c", "FAILED")]
    table.commit(spark.createDataFrame([("a", "GONE")], "document_id string, status string"), None)
    assert rows(table.rows()) == [] and table.orphans().count() == 2  # the failed try left no file, and c names the last


def test_embedding_resumes_where_it_was_interrupted(spark, tmp_path):
    chunks = spark.createDataFrame([(d, o, f"text {d} {o}" if (d + o) % 11 else None) for d in range(20) for o in range(1, 3 + 5 * d % 37)], "document_id long, ordinal long, content string").repartition(4)

    def vector(part):
        return part.withColumn("vector", F.array(F.length(F.coalesce("content", F.lit(""))).cast("double"), F.crc32(F.coalesce("content", F.lit("")).cast("binary")).cast("double")))

    calls = []

    def stops(part):
        calls.append(part.count())
        if len(calls) == 3:
            raise KeyboardInterrupt
        return vector(part)

    whole, half = B.store(spark, str(tmp_path / "whole")), B.store(spark, str(tmp_path / "half"))
    all_steps = B.steps(chunks, 4).count()
    assert B.resume(chunks, whole, vector, size=4, rounds=4) == all_steps
    with pytest.raises(KeyboardInterrupt):
        B.resume(chunks, half, stops, size=4, rounds=4)
    done = half.pointers().count()
    assert 0 < done < all_steps and half.rows().count() == sum(calls[:2])
    assert B.resume(chunks, half, vector, size=4, rounds=4) == all_steps - done
    assert rows(half.rows()) == rows(whole.rows()) and B.resume(chunks, half, vector, size=4, rounds=4) == 0
    # one text changed, one document longer, one gone: the prefixes before the changes stay, and nothing else is made again
    changed = chunks.where("document_id <> 3").withColumn("content", F.when((F.col("document_id") == 5) & (F.col("ordinal") == 10), "other").otherwise(F.col("content")))
    n5 = chunks.where("document_id = 5").count()
    assert B.resume(changed, half, vector, size=4, rounds=4) == -(-n5 // 4) - 2
    fresh = B.store(spark, str(tmp_path / "fresh"))
    B.resume(changed, fresh, vector, size=4, rounds=1)
    assert rows(half.rows()) == rows(fresh.rows()) and half.rows().where("document_id = 3").isEmpty()


def test_embedding_digests_contents_once_for_all_rounds(spark, tmp_path):
    read = spark.sparkContext.accumulator(0)

    def counted(x):
        read.add(1)
        return f"text {x}"

    chunks = spark.range(200).select((F.col("id") % 20).alias("document_id"), (F.floor(F.col("id") / 20) + 1).alias("ordinal"), F.udf(counted, "string")("id").alias("content"))
    into = B.store(spark, str(tmp_path / "v"))
    assert B.resume(chunks, into, lambda part: part.withColumn("vector", F.array(F.length("content").cast("double"))), rounds=4) == 20
    assert into.rows().count() == 200 and 200 <= read.value <= 1000  # once for the digests, once at most in each round
