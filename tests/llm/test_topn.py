from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from gradeloom.llm import topn

SCHEMA = "result_id long, project_name string, file_path string, score double, ingested_at long, position int, __rank int"


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, 7, 8) for r in rows], SCHEMA).repartition(3)


def brute(rows, n):
    out = {}
    for i, p, f, s in {r for r in rows if r[0] is not None and r[1] is not None and r[3] is not None and r[3] == r[3]}:
        out.setdefault(p, []).append((-s, f is not None, (f or "").encode(), i))
    return {p: [x[3] for x in sorted(v)[:n]] for p, v in out.items()}


def test_against_brute_force(spark):
    rnd = random.Random(1)
    rows = [(i, rnd.choice(["a"] * 8 + ["b", "c", None]), rnd.choice(["/x", "/ä", "/X", None]), rnd.choice([0.5, 0.5, 0.9, 1.00001, None, float("nan"), rnd.random()])) for i in range(1500)]
    rows += rnd.sample(rows, 300)  # delivered twice
    got = {}
    for r in topn.best_results(table(spark, rows), 10).orderBy("project_name", "position").collect():
        got.setdefault(r["project_name"], []).append(r["result_id"])
    assert got == brute(rows, 10)


def test_few_none_and_empty(spark):
    assert topn.best_results(table(spark, []), 10).count() == 0
    rows = [(1, "a", "/x", 0.1), (None, "a", "/x", 0.9), (2, None, "/x", 0.9), (3, "a", "/x", None)]
    assert [tuple(r) for r in topn.best_results(table(spark, rows), 10).select("project_name", "result_id", "position").collect()] == [("a", 1, 1)]
    with pytest.raises(ValueError):
        topn.top_n(table(spark, rows), ["project_name"], [F.col("score")], 0, "result_id")


def test_differing_copies(spark):
    rows = [(1, "a", "/x", 0.1), (1, "a", "/x", 0.9), (2, "a", "/x", 0.5)]
    order = [F.col("score").desc(), F.col("result_id")]
    df = table(spark, rows).drop("position", "__rank")
    got = topn.top_n(df, ["project_name"], order, 2, "result_id", copies="best").orderBy("position").collect()
    assert [(r["result_id"], r["score"]) for r in got] == [(1, 0.9), (2, 0.5)]


def test_group_limit_runs_before_the_shuffle(spark):
    plan = topn.best_results(table(spark, [(1, "a", "/x", 0.1)]))._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan
