"""The training corpus from raw documents: each stage gets what the one before it kept.

quality: documents that the discriminant scores below 0.3 go. near_dedup: of each component of near duplicates (word
5-shingles, Jaccard 0.8) the document with the least id stays. suffix_dedup: byte strings of 200 that occur twice or more
are cut out of the texts. decontaminate: documents of which a twentieth or more of the words are in benchmark windows go.
packing: what is left, as pieces of sequences of 1024 token ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm.common import shared_path, table
from granary.llm.decontaminate import decontaminate
from granary.llm.minhash import drop_near_duplicates
from granary.llm.packing import pack
from granary.llm.quality import keep_good, learn
from granary.llm.queries import tokenizer_path
from granary.llm.suffix import remove_repeats


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs, learn(docs, table(spark, sf_dir, "labels")), least=0.3)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_duplicates(docs, width=5, percent=80)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    left = remove_repeats(docs, length=200)
    return left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate(docs, table(spark, sf_dir, "benchmark"), n=13, remove="documents")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, tokenizer_path(), width=1024, end_id=0)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("suffix_dedup", suffix_dedup), ("decontaminate", benchmark_free), ("packing", packing)]

#: SQL cannot express the stages. tests/llm holds the operator of each against brute force; test_pipeline.py tests what the stages keep.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, each stage's written as Parquet in the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
