"""The join that deals hot keys apart: every pair, whichever side of the bound a key falls on."""

from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

from gridloom.llm._common import join_split


@pytest.mark.parametrize("how", ["inner", "left_semi"])
def test_join_split(spark, how):
    keys = ["hot"] * 300 + [f"k{i % 40}" for i in range(200)] + ["once", None, None, ""]
    rows = spark.createDataFrame(list(enumerate(keys)), "i long, key string").repartition(5)
    counts = {k: n for k, n in Counter(keys).items() if k is not None and n > 1}
    counted = spark.createDataFrame(list(counts.items()), "_k string, _n long")
    got = join_split(rows, counted, F.col("key"), F.col("_k"), "_n", how)
    assert got.columns == (["i", "key", "_k", "_n"] if how == "inner" else ["i", "key"])
    assert sorted(r["i"] for r in got.collect()) == [i for i, k in enumerate(keys) if k in counts]
    assert join_split(rows, counted.limit(0), F.col("key"), F.col("_k"), "_n", how).count() == 0
    assert join_split(rows.limit(0), counted, F.col("key"), F.col("_k"), "_n", how).count() == 0
