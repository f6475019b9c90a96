import os
import shutil
import subprocess
import sys

import __spark_entry__ as entry


def test_flagship_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_every_query_of_the_engine_agrees_with_its_sql(spark, sf):
    import math

    import duckdb

    from granary import queries as core

    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")

    def plain(v):
        return f"{v:.6g}" if isinstance(v, float) and not math.isnan(v) else str([plain(x) for x in v]) if isinstance(v, list) else str(v)

    sql = core.oracle_sql()
    for name, run in core.queries().items():
        df = run(spark, sf)
        got = sorted(tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect())
        if name in sql:
            rel = con.sql(sql[name])
            at = [rel.columns.index(c) for c in sorted(rel.columns)]
            assert sorted(df.columns) == sorted(rel.columns), name
            assert got == sorted(tuple(plain(r[i]) for i in at) for r in rel.fetchall()), name


def test_a_copy_without_the_training_data_package(tmp_path):
    """The entry point and the engine stand where granary/llm, tests/llm and corpus_pipeline.py are gone: all other tests can be collected, a query
    runs, and nothing of the training-data operators is registered."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    copy = tmp_path / "copy"
    gone = {"llm", "corpus_pipeline.py", ".git", "__pycache__", ".pytest_cache", "spark-warehouse"}
    shutil.copytree(root, copy, ignore=lambda _, names: gone & set(names))
    assert not (copy / "granary/llm").exists() and not (copy / "tests/llm").exists()
    code = (
        "import __spark_entry__ as e\n"
        "from pyspark.sql import SparkSession\n"
        "names = set(e.queries())\n"
        "assert len(names) > 120 and set(e.oracle_sql()) <= names and 'pipeline' not in names and not any(n.startswith('op') and n[2].isdigit() for n in names)\n"
        "spark = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').getOrCreate()\n"
        "assert e.entry(spark).count() > 0\n"
    )
    own = {**os.environ, "PYTHONPATH": str(copy)}
    subprocess.run([sys.executable, "-c", code], cwd=copy, check=True, env=own)
    found = subprocess.run([sys.executable, "-m", "pytest", "tests", "--collect-only", "-q"], cwd=copy, env=own, capture_output=True, text=True)
    assert found.returncode == 0, found.stdout[-2000:]
