import corpus_pipeline as P
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_stages_keep_the_columns_and_do_their_work(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    before = {r.doc_id: r.text for r in docs.collect()}
    now = docs
    for name, stage in P.STAGES[:-1]:
        now = stage(spark, now, SF).cache()
        assert now.columns == columns, name
        got = {r.doc_id: r for r in now.collect()}
        assert set(got) < set(before) or (name in ("suffix_dedup", "decontaminate") and set(got) <= set(before)), name
        if name != "suffix_dedup":
            assert all(before[k] == r.text for k, r in got.items())
        assert all(len(r.text) == r.n_chars for r in got.values())
        before = {k: r.text for k, r in got.items()}
    pieces = P.STAGES[-1][1](spark, now, SF)
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == set(before)


def test_run_is_reproducible(spark):
    one, two = ({tuple(r) for r in P.run(spark, SF).select("doc_id", "start", "length", "ids_crc32", "doc_tokens").groupBy("doc_id").agg(F.sum("length"), F.max("doc_tokens")).collect()} for _ in range(2))
    assert one == two and one


def test_five_stages_in_order():
    assert [n for n, _ in P.STAGES] == ["quality", "near_dedup", "suffix_dedup", "decontaminate", "packing"]


def test_stages_on_odd_tables(spark, tmp_path):
    """Null ids and texts, repeated rows, ties, clashing names and no rows, from stage to stage."""
    from cases import SCHEMA, empty, rows, table

    same = spark.createDataFrame([rows()[6]] * 20, SCHEMA)
    nulls = spark.createDataFrame([(None,) * 10] * 3, SCHEMA)
    for name, docs, least in (("odd", table(spark), 10), ("same", same, 1), ("nulls", nulls, 1), ("none", empty(spark), 0)):
        columns, now = docs.columns, docs
        for stage, run in P.STAGES:
            now = run(spark, now, SF)
            now.write.parquet(f"{tmp_path}/{name}-{stage}")
            now = spark.read.parquet(f"{tmp_path}/{name}-{stage}")
            assert (now.columns == columns or stage == "packing") and (least == 0) == now.isEmpty(), (name, stage)
            assert stage == "packing" or now.count() >= least, (name, stage)
