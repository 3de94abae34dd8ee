"""Steps and cells are read once, and what is large is not sorted or moved for a join."""

from __future__ import annotations

import __spark_entry__ as entry
import pytest
from gridloom.operators import ensemble

from .conftest import DATA

SF = f"{DATA}/sf0.001"


@pytest.fixture
def plan(spark):
    """The plan of a table, where nothing is small enough to be broadcast by itself."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield lambda df: df._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_alignment_does_not_move_its_result(spark, plan):
    rows = [("tas", 1, 1, 1.0, 2.0, 3.0, 5.0), ("tas", 1, 1, 1.0, 2.0, 3.0, 7.0), ("tas", 2, 1, 1.0, 2.0, 4.0, None), ("tas", None, 1, 9.0, 2.0, 3.0, 1.0), ("tas", 2, 1, None, 2.0, 3.0, 8.0)]
    cells = spark.createDataFrame(rows, "variable string, realization int, time long, level double, lat double, lon double, value double")
    out = ensemble.align(cells)
    assert "SortMergeJoin" not in plan(out)
    got = sorted((tuple(r) for r in out.collect()), key=str)
    places = [("tas", 1, 1.0, 2.0, 3.0), ("tas", 1, 1.0, 2.0, 4.0), ("tas", 1, 9.0, 2.0, 3.0), ("tas", 1, None, 2.0, 3.0)]
    assert got == sorted(((*p, k, 6.0 if p == places[0] and k == 1 else None) for p in places for k in (1, 2)), key=str)


def test_remapping_reads_the_cells_once(spark):
    assert not [f for f in entry.queries()["regrid_conservative_curvilinear"](spark, SF).inputFiles() if "lineitem" in f]
