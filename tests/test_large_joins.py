"""Joins of two tables without a bound: a task's share does not grow with them, and edges are made in one pass."""

from __future__ import annotations

from collections import Counter

import __spark_entry__ as entry
import pytest
from gridloom.functions import scratch
from gridloom.sources import manifest
from pyspark.sql import functions as F

from .conftest import DATA

SF = f"{DATA}/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_edges_join_once_without_broadcast(spark):
    told = plan(entry.queries()["lineage_edges"](spark, SF))
    assert told.count("FileScan") == 2 and "Broadcast" not in told


def test_tasks_of_edges_follow_the_rows(spark, monkeypatch):
    edges = lambda: entry.queries()["lineage_edges"](spark, SF)
    want = sorted(edges().collect())
    monkeypatch.setattr(scratch, "TASK_ROWS", 500, raising=False)
    got = edges()
    assert got.rdd.getNumPartitions() >= spark.read.parquet(f"{SF}/lineitem.parquet").count() // 500
    assert sorted(got.collect()) == want


@pytest.mark.parametrize("many", [0, 3000])
def test_join_dealt(spark, monkeypatch, many):
    """Every pair: keys that repeat on both sides, that only one side has, none, and one with most rows, which no task gets whole."""
    monkeypatch.setattr(scratch, "TASK_ROWS", 500)
    monkeypatch.setattr(scratch, "ONE_OF", 4)
    left = [*[7] * many, *[k % 900 for k in range(1800)], None, None]
    right = [*range(0, 600), *range(0, 600, 3), 7, 5000, None]
    a = spark.createDataFrame(list(enumerate(left)), "i long, k long").repartition(6)
    b = spark.createDataFrame(list(enumerate(right)), "j long, m long").repartition(3)
    got = scratch.join_dealt(a, b, "k", "m")
    assert got.columns == ["i", "k", "j", "m"]
    at = {}
    for j, m in enumerate(right):
        at.setdefault(m, []).append(j)
    want = Counter((i, k, j, k) for i, k in enumerate(left) if k is not None for j in at.get(k, []))
    assert Counter(map(tuple, got.collect())) == want
    if many:
        shares = got.filter("k = 7").groupBy(F.spark_partition_id()).count().collect()
        assert max(r["count"] for r in shares) < sum(r["count"] for r in shares) / 2
    assert scratch.join_dealt(a, b.limit(0), "k", "m").count() == scratch.join_dealt(a.limit(0), b, "k", "m").count() == 0


def test_edges_without_an_end_are_left_out(spark):
    steps = [(1, 1, "a", ["x", "y"], ["z"], {"dims": ["lat", "lon"], "area": ["0"]}), (1, 2, "b", [], None, {}), (1, 3, None, ["x"], ["z"], None), (2, 1, "c", [None, "x"], ["z"], None)]
    df = spark.createDataFrame(steps, "run long, step int, operator string, inputs array<string>, outputs array<string>, parameters map<string,array<string>>")
    got = manifest.lineage(df)
    assert got.dtypes == [("run", "bigint"), ("step", "int"), ("edge", "string"), ("subject", "string"), ("object", "string")]
    assert set(map(tuple, got.collect())) == {(1, 1, "used", "a", "x"), (1, 1, "generated", "z", "a"), (1, 1, "parameters", "a", "area=0;dims=lat,lon"), (1, 2, "parameters", "b", ""), (2, 1, "generated", "z", "c"), (2, 1, "parameters", "c", "")}
