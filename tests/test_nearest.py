"""Many queries against all vectors."""

import random

import pytest
from pyspark.sql import functions as F

from granary.operators import retrieval as R
from granary.plans.table_plan import PlanError


def cosine(a, b):
    norm = (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5
    return round(sum(x * y for x, y in zip(a, b, strict=True)) / norm, 12) if norm else 0.0


@pytest.mark.parametrize("most_bytes", [1 << 20, 200])
def test_blocks_equal_all_pairs(spark, most_bytes, monkeypatch):
    rnd = random.Random(8)
    points = [(i, [float(rnd.choice([-1, 0, 0.5, 2])) for _ in range(5)]) for i in range(150)]
    points += [(200 + i, points[3][1]) for i in range(60)]  # a third are copies: ties go by id
    rows = spark.createDataFrame([*points, (500, None), (501, [1.0]), (502, [float("nan")] * 5)], "id long, embedding array<double>").repartition(5)
    asked = spark.createDataFrame([(i, v) for i, v in points if i % 9 == 0] + [(999, None)], "query_id long, q array<double>")
    got = {}
    for r in R.blocked_topk(rows, asked, 4, 0.2, most_bytes=most_bytes).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.id, r.score))
    for i, v in points:
        if i % 9 == 0:
            best = sorted((-cosine(v, w), j) for j, w in points if cosine(v, w) >= 0.2)[:4]
            assert sorted(got.get(i, [])) == [(n, j, -s) for n, (s, j) in enumerate(best, 1)]


def test_branches_are_interleaved(spark):
    rows = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(-5, 6)], "id long, embedding array<double>")
    branches = spark.createDataFrame([(1, 0, [1.0, 0.0]), (1, 1, [-1.0, 0.0]), (2, 0, [0.0, 1.0])], "question_id int, branch int, q array<double>")
    got = R.fan_out(rows, branches, 5, per_branch=3).orderBy("question_id", "rank")
    assert [(r.question_id, r["rank"], r.id) for r in got.collect()] == [(1, 1, 5), (1, 2, -5), (1, 3, 4), (1, 4, -4), (1, 5, 3), (2, 1, 0), (2, 2, -1), (2, 3, 1)]
    plan = R.blocked_topk(rows, branches, 5, keys=("question_id", "branch"))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_empty_and_mixed(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0])], "id long, embedding array<double>")
    none = spark.createDataFrame([], "query_id long, q array<double>")
    assert R.blocked_topk(rows, none, 3).collect() == [] and R.blocked_topk(rows.where(F.lit(False)), spark.createDataFrame([(1, [1.0])], none.schema), 3).collect() == []
    with pytest.raises(PlanError):
        R.blocked_topk(rows, spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], none.schema), 3)
