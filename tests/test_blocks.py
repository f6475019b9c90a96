"""A CSV file in blocks against the whole file at once."""

import csv
import io
import random

import pytest
from pyspark.errors import PySparkException

from granary.plans.table_plan import PlanError
from granary.sources import blocks as B
from granary.sources import delimited as D


@pytest.fixture()
def small_blocks(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    old = {k: spark.conf.get(k) for k in names}
    for k, v in zip(names, ("700b", "1b"), strict=True):
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def made(rnd, n, long=False):
    out = io.StringIO()
    w = csv.writer(out, lineterminator=rnd.choice(["\n", "\r\n"]), delimiter=";")
    w.writerow(["id", "no\nte", "amount"])
    for i in range(n):
        text = "".join(rnd.choice(["a", '"', "\n", ";", "ü", " ", "标"]) for _ in range(rnd.randint(0, 30 if not long or rnd.random() < 0.9 else 3000)))
        w.writerow([i, text, rnd.choice(["", "1.5"])])
    return out.getvalue()


@pytest.mark.parametrize("seed", range(4))
def test_blocks_equal_the_whole(spark, small_blocks, tmp_path, seed):
    rnd = random.Random(seed)
    text = made(rnd, 300, long=seed % 2 == 1)
    raw = text.encode("gb18030" if seed == 2 else "utf-8-sig" if seed == 3 else "utf-8")
    (tmp_path / "t.csv").write_bytes(raw)
    df = B.read_csv_blocks(spark, str(tmp_path / "t.csv"))
    columns, rows = D.table_cells(D.records(text))
    assert df.columns == [*columns, "_row"]
    got = df.orderBy("_row").collect()
    assert [list(r)[:3] for r in got] == rows and len({r._row for r in got}) == len(rows)
    assert spark.read.text(str(tmp_path / "t.csv")).rdd.getNumPartitions() > 5


def test_edges(spark, small_blocks, tmp_path):
    def read(raw):
        path = tmp_path / f"f{len(list(tmp_path.iterdir()))}.csv"
        path.write_bytes(raw)
        return [tuple(r)[:-1] for r in B.read_csv_blocks(spark, str(path)).orderBy("_row").collect()]

    assert read(b"a,b\n") == [] and read(b"a,b") == [] and read(b"\n\na,b\n\n1,2\n , \n3\n") == [("1", "2"), ("3", "")]
    assert read(b'"a\n1",b\n"' + b"x\n" * 2000 + b'",2\n3,4') == [("x\n" * 2000, "2"), ("3", "4")]  # a record over several blocks
    for raw in (b"", b"\n\n"):
        with pytest.raises(PlanError):
            read(raw)
    for raw in (b'a,b\n"x,1\n', b'a,b\nx"y",1\n', b"a,b\n1,2,3\n"):
        with pytest.raises(PySparkException):
            read(raw)
