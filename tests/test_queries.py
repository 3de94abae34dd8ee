"""Every registered query against its SQL in DuckDB, row by row."""

from __future__ import annotations

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from gridloom.plans import registry

from .conftest import DATA

#: The smallest tables have ten longitudes only, and the SQL of these counts on all 72.
LARGER = {"regrid_nearest", "regrid_bilinear", "regrid_nearest_uneven", "regrid_bilinear_uneven", "regrid_conservative_uneven"}


def plain(value):
    if value is None or value is pd.NA or value != value:
        return None
    if isinstance(value, (bool, str)):
        return value
    try:
        return round(float(value), 5) + 0.0
    except TypeError:
        return str(value).replace(" 00:00:00", "")


def rows(df):
    columns = sorted(df.columns)
    return columns, sorted((tuple(map(plain, r)) for r in df[columns].itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_sql(spark, name):
    folder = f"{DATA}/sf0.01" if name in LARGER else f"{DATA}/sf0.001"
    con = duckdb.connect()
    for f in os.listdir(folder):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{folder}/{f}'")
    got = rows(registry.QUERIES[name](spark, folder).toPandas())
    if name not in registry.SQL:
        assert got[1]
        return
    assert got == rows(con.execute(registry.SQL[name]).df())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
