"""Embedding in small steps that survive interruption: what is done and still right is kept, only the rest is worked on."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granary.sources.commits import Commits
from granary.sources.files import kept

#: Chunks of a document that make a step.
STEP = 32
_ROWS = "document_id long, step long, ordinal long, vector array<double>, digest string"


def store(spark: SparkSession, root: str) -> Commits:
    """Where vectors are kept, a pointer for each document and step; a step's status is the digest of the chunks it was made from."""
    return Commits(spark, root, _ROWS, ["document_id", "step"])


def steps(chunks: DataFrame, size: int = STEP) -> DataFrame:
    """document_id, step, n and digest of the chunks (document_id, ordinal from 1, content): `size` chunks in a row are a step. The digest
    tells contents, their order and their number apart."""
    numbered = chunks.select("document_id", F.floor((F.col("ordinal") - 1) / size).alias("step"), "ordinal", F.sha2("content", 256).alias("part"))
    parts = F.array_sort(F.collect_list(F.struct("ordinal", F.coalesce("part", F.lit("-")).alias("part"))))
    return numbered.groupBy("document_id", "step").agg(F.count("*").alias("n"), F.sha2(F.array_join(F.transform(parts, lambda x: F.concat(x["ordinal"].cast("string"), F.lit(":"), x["part"])), ","), 256).alias("digest"))


def remaining(chunks: DataFrame, log: DataFrame, size: int = STEP) -> DataFrame:
    """document_id, step and digest of the steps still to do: of each document those from the first on whose digest is not the one in the log
    (document_id, step, digest). What comes before is a prefix that was made from these very chunks and holds."""
    return _remaining(steps(chunks, size), log)


def _remaining(now: DataFrame, log: DataFrame) -> DataFrame:
    logged = log.select("document_id", "step", F.col("digest").alias("_was"))
    changed = F.when(~F.col("digest").eqNullSafe(F.col("_was")), F.col("step"))
    judged = now.join(logged, ["document_id", "step"], "left").withColumn("_from", F.min(changed).over(Window.partitionBy("document_id")))
    return judged.where(F.col("step") >= F.col("_from")).select("document_id", "step", "digest")


def resume(chunks: DataFrame, into: Commits, embed: Callable[[DataFrame], DataFrame], size: int = STEP, rounds: int = 8) -> int:
    """Embeds what remains, in rounds that are committed one by one, and gives the number of steps done. embed: chunks (document_id, ordinal,
    content) to the same rows with a column vector.

    A round takes the documents of one hash class. Its vectors are staged, then a pointer for each step names them with the digest
    of the chunks they are of: an interruption loses a round at most, and never leaves vectors without their step or a step without its
    vectors. Pointers of steps beyond a document's present end are withdrawn. Run again, nothing remains and nothing changes.
    The steps and what remains of them are stored (a digest each), so that rounds don't digest all contents again.
    """
    log = into.pointers().where("attempt is not null").select("document_id", "step", F.col("status").alias("digest"))
    now = kept(steps(chunks, size))
    left = kept(_remaining(now, log))
    gone = log.join(now, ["document_id", "step"], "left_anti").select("document_id", "step", F.lit("GONE").alias("status"))
    if not gone.isEmpty():
        into.commit(gone, None)
    done = 0
    for r in range(rounds):
        of_round = F.pmod(F.xxhash64("document_id"), F.lit(rounds)) == r
        mine = left.where(of_round)
        numbered = chunks.where(of_round).select("document_id", "ordinal", "content", F.floor((F.col("ordinal") - 1) / size).alias("step"))
        wanted = numbered.join(mine, ["document_id", "step"])
        made = embed(wanted.select("document_id", "ordinal", "content")).withColumn("step", F.floor((F.col("ordinal") - 1) / size))
        attempt = into.stage(made.join(mine, ["document_id", "step"]))
        own = into.staged().where(F.col("attempt") == attempt)
        finished = own.groupBy("document_id", "step").agg(F.first("digest").alias("status"), F.count("*").alias("n")).cache()
        if (n := finished.count()) > 0:
            into.commit(finished, attempt)
            done += n
        finished.unpersist()
    return done
