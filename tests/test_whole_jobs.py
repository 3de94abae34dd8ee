"""The queries named ..._all take all members and times."""

from __future__ import annotations

from datetime import datetime

import __spark_entry__ as entry
from gridloom.operators import ensemble
from gridloom.plans.fixtures import grid_cells

from .conftest import DATA

SF = f"{DATA}/sf0.001"


def test_align_of_ten_members_equals_brute_force(spark):
    rows = [(k, datetime(1994 + k % 4, 1 + k % 3, 1), 100.0, float(k % 2), 2.5, float(10 * k + j)) for k in range(1, 11) for j in range(2)]
    g = spark.createDataFrame([("tas", *r) for r in rows], "variable string, realization int, time timestamp, level double, lat double, lon double, value double")
    places = {r[1:5] for r in rows}
    wanted = {(*p, k): next((sum(v) / len(v) for v in [[r[5] for r in rows if r[0] == k and r[1:5] == p]] if v), None) for p in places for k in range(1, 11)}
    got = ensemble.align(g).collect()
    assert len(got) == len(wanted) and {(r["time"], r["level"], r["lat"], r["lon"], r["realization"]): r["value"] for r in got} == wanted


def test_align_query_fills_every_member_and_time(spark):
    g = grid_cells(spark, SF)
    places, members = g.select("time", "level", "lat", "lon").distinct().count(), g.select("realization").distinct().count()
    out = entry.queries()["ensemble_align_all"](spark, SF)
    assert members == 10 and out.count() == places * members == out.select("time", "level", "lat", "lon", "realization").distinct().count()


def test_stacks_hold_ten_members(spark):
    assert {r[0] for r in entry.queries()["concat_members_all"](spark, SF).select("realization").collect()} == set(range(1, 11))
