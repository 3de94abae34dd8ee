"""Positions and running values against plain loops."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from gridloom.operators import ranks


@pytest.mark.parametrize("few", [100, 50_000])
def test_numbered(spark, monkeypatch, few):
    """Positions within keys of which one has most rows."""
    monkeypatch.setattr(ranks, "FEW", few)
    rows = [(k % 4 if k % 3 else 9, (k * 7919) % 5000, k) for k in range(5000)] + [(None, 3, -1), (9, None, -2)]
    df = spark.createDataFrame(rows, "key int, at int, row int").repartition(7)
    got = {r["row"]: r["n"] for r in ranks.numbered(df, ["key"], ["at", "row"], "n").collect()}
    want = {}
    for key in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == key), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        want |= {r[2]: k for k, r in enumerate(own)}
    assert got == want
    assert ranks.numbered(df.limit(0), ["key"], ["at"]).count() == 0
    spread = ranks.numbered(df.filter("key = 9"), ["key"], ["at", "row"], "n").agg(F.count_distinct("n")).first()[0]
    assert spread == sum(r[0] == 9 for r in rows)


def test_running(spark, monkeypatch):
    """Sums and exclusive-or sums over many spans; a key with most rows."""
    monkeypatch.setattr(ranks, "SPAN", 7)
    rows = [("a" if k % 5 else "b", k, k * k) for k in range(300)]
    values = {"before": ("v", F.sum, lambda a, b: a + b), "mixed": ("v", F.bit_xor, lambda a, b: a.bitwiseXOR(b))}
    got = ranks.running(spark.createDataFrame(rows, "key string, at long, v long").repartition(3), ["key"], "at", values).collect()
    for r in got:
        earlier = [v for key, at, v in rows if key == r["key"] and at < r["at"]]
        mixed = 0
        for v in earlier:
            mixed ^= v
        assert (r["before"], r["mixed"]) == ((sum(earlier), mixed) if earlier else (None, None))
    assert len(got) == len(rows)
