"""Requests and files that overlap, against every pair."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from gridloom.functions.params import FIRST_TIME, LAST_TIME
from gridloom.sources import catalog


def test_nodes_make_up_their_months(spark):
    r = random.Random(1)
    spans = [(0, 0), (0, 119_999), (7, 8), (8, 15), (511, 4096), (12 * 1900, 12 * 2100)] + [(a, a + r.randrange(3000)) for a in (r.randrange(100_000) for _ in range(200))] + [(5, 4)]
    rows = spark.createDataFrame(spans, "a long, b long").select("a", "b", catalog.nodes_over(F.col("a"), F.col("b")).alias("n")).collect()
    for row in rows:
        months = [m for n in row["n"] for m in range(n["number"] * catalog.RADIX ** n["level"], (n["number"] + 1) * catalog.RADIX ** n["level"])]
        assert sorted(months) == list(range(row["a"], row["b"] + 1))
        assert len(row["n"]) <= 2 * catalog.RADIX * catalog.LEVELS


def test_overlaps(spark):
    r = random.Random(2)

    def time(day):
        return f"{1900 + day // 360:04d}-{1 + day // 30 % 12:02d}-{1 + day % 30:02d}T00:00:00"

    def span():
        a = r.randrange(60_000)
        return time(a), time(a + r.choice([0, 1, 29, 30, 400, 9000]))

    files = [("hot" if k % 3 else f"d{k % 5}", *span(), f"f{k}") for k in range(400)] + [("hot", FIRST_TIME, LAST_TIME, "open"), ("hot", time(50), time(40), "turned round")]
    asks = [("hot" if k % 4 else f"d{k % 5}", *span()) for k in range(150)] + [("hot", None, None), ("hot", time(99), None), ("hot", None, time(99)), ("none", *span()), ("hot", time(45), time(45))]
    c = spark.createDataFrame(files, "ds_id string, start_time string, end_time string, path string").repartition(3)
    got = sorted(map(tuple, catalog.search_many(c, spark.createDataFrame([*asks, asks[0]], "ds_id string, start string, end string")).collect()))
    whole = {(i, s or FIRST_TIME, e or LAST_TIME) for i, s, e in asks}
    assert got == sorted((i, s, e, p) for i, s, e in whole for d, a, b, p in files if d == i and b >= s and a <= e)
