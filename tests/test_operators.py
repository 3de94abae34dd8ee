"""Small hand-made frames for the edges, equivalent forms, and plans."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from gridloom.functions.params import Area, Components, Grid, Levels, Time, widen
from gridloom.operators import aggregate, chunks, ensemble, fixes, polygon, regrid, select, usage
from gridloom.plans import workflow
from gridloom.sources import accesslog, catalog, manifest
from gridloom.streaming import daily

from .conftest import DATA

D = dt.datetime


def cells(spark, rows):
    return spark.createDataFrame(rows, "dataset_id string, variable string, realization int, time timestamp_ntz, level double, lat double, lon double, value double")


@pytest.fixture(scope="module")
def psl(spark):
    """Daily for 1961 and 1962, lat 20..80 and lon 0..350 by 10."""
    days = spark.sql("select explode(sequence(timestamp_ntz'1961-01-01', timestamp_ntz'1962-12-31', interval 1 day)) as time")
    at = spark.range(7).select((20 + 10 * F.col("id")).cast("double").alias("lat")).join(spark.range(36).select((10 * F.col("id")).cast("double").alias("lon")), F.lit(True))
    df = days.join(at, F.lit(True)).select(F.lit("a").alias("dataset_id"), F.lit("psl").alias("variable"), F.lit(1).alias("realization"), "time", F.lit(0.0).alias("level"), "lat", "lon", (F.col("lat") + F.col("lon")).alias("value"))
    return df.cache()


def test_box_across_the_meridian(psl):
    got = select.subset(psl, area="-10,30,35,70", time_components="year:1962|month:aug")
    assert got.count() == 31 * 5 * 5
    assert [r[0] for r in got.select("lon").distinct().orderBy("lon").collect()] == [-10.0, 0.0, 10.0, 20.0, 30.0]


def test_no_match_is_empty(psl):
    assert select.subset(psl, time_components={"year": [1850]}).count() == 0


def test_missing_dimension_is_an_error(psl):
    with pytest.raises(ValueError, match="time"):
        select.subset(psl.drop("time"), time="1961/1962")


def test_times():
    assert widen("2001-02", True) == "2001-02-28T23:59:59"
    assert Time.parse("2001/2010") == Time("2001-01-01T00:00:00", "2010-12-31T23:59:59")
    assert Time.parse("/2010").start is None
    assert Time.parse("2001-05,2002").points == ("2001-05-01T00:00:00", "2002-01-01T00:00:00")


def test_components():
    c = Components.parse("year:2000,2001|month:" + ",".join(map(str, range(1, 13))) + "|day=1")
    assert c.needed(Time.parse("2000/2001")) == Components(day=(1,))
    assert Components(year=(1999,)).narrow(Time.parse("2001/2003")) == Time.parse("2001/2003")
    assert Components(year=(2002, 2010)).narrow(Time.parse("2001/2003")) == Time("2002-01-01T00:00:00", "2003-12-31T23:59:59")


def test_areas_and_levels():
    assert Area.parse("-10,70,35,30").ranges(360) == [(350.0, 360.0), (0.0, 35.0)]
    assert Area.parse("350,30,35,70").ranges(180) == [(-10.0, 35.0)]
    assert Area.parse("0,-100,360,100").ranges(360) == [(0.0, 360.0)]
    assert Levels.parse("500/100") == Levels(100.0, 500.0)


def test_grids():
    assert (Grid.parse("0.5").nlat, Grid.parse("0.5").nlon) == (360, 720)
    assert (Grid.parse("1deg").nlat, Grid.parse("1deg").nlon) == (180, 360)
    assert Grid.parse("-10 30 5 35 70 5").lons()[0] == -7.5
    with pytest.raises(ValueError):
        Grid.parse("1 2 3 4")


def test_predicates_reach_the_scan(spark):
    li = spark.read.parquet(f"{DATA}/sf0.001/lineitem.parquet").select(F.col("l_shipdate").alias("time"), F.col("l_tax").alias("lon"), F.col("l_discount").alias("lat"))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(l_shipdate" in plan(li.filter(Components(year=(1997,)).where()))
    assert ", Or" in plan(li.filter(Area.parse("-10,30,35,70").where(360)))


def test_missing_cells_have_no_weight(spark):
    t = D(2000, 1, 1)
    df = cells(spark, [("a", "v", 1, t, 0.0, 60.0, 0.0, 4.0), ("a", "v", 1, t, 0.0, 0.0, 0.0, 1.0), ("a", "v", 1, t, 0.0, 30.0, 0.0, None)])
    assert aggregate.weighted_average(df).first()["value"] == pytest.approx((0.5 * 4 + 1) / 1.5)
    assert aggregate.average(df, ["lat"]).first()["value"] == 2.5
    with pytest.raises(ValueError):
        aggregate.average(df, ["depth"])
    assert aggregate.average(df, ["depth"], True).count() == 3


def test_all_missing_is_null(spark):
    df = cells(spark, [("a", "v", 1, D(2000, 1, 1), 0.0, 1.0, 1.0, None)])
    assert aggregate.weighted_average(df).first()["value"] is None


def test_gaps_filled(spark):
    df = cells(spark, [("a", "v", 1, D(2000, 1, 1), 0.0, 1.0, 1.0, 1.0), ("a", "v", 1, D(2003, 1, 1), 0.0, 1.0, 1.0, 2.0)])
    assert aggregate.average_time(df, "year").count() == 2
    assert aggregate.average_time(df, "year", fill_gaps=True).count() == 4


def test_select_before_or_after_stacking(psl):
    two = psl.withColumn("realization", F.lit(2)).withColumn("value", F.col("value") + 1)
    before = ensemble.stack([select.subset(m, time="1962-03/1962-04", area="-10,30,35,70", frame=360) for m in (psl, two)])
    after = ensemble.concat([psl, two], time="1962-03/1962-04", area="-10,30,35,70", frame=360)
    assert before.exceptAll(after).count() == 0 and after.exceptAll(before).count() == 0
    assert ensemble.concat([psl, two], time="1962-03-01/1962-03-01", apply_average=True).count() == 7 * 36


def test_steps(psl):
    got = chunks.by_steps(psl.filter("year(time) = 1961"), 200).orderBy("chunk").collect()
    assert [str(r["end"]) for r in got] == ["1961-07-19 23:59:59", "1961-12-31 00:00:00"]


@pytest.mark.parametrize(("steps", "years"), [(365, [2000, 2005, 2010]), (12, [2000, 2010, 2020])])
def test_years(spark, steps, years):
    n = spark.range(1).select(chunks.chunk_years(F.lit(steps), 2000, 1, 10).alias("years"))
    end = 2012 if steps == 365 else 2025
    spans = n.select(F.lit("a").alias("dataset_id"), F.expr("timestamp_ntz'2000-01-01'").alias("start"), F.expr(f"timestamp_ntz'{end}-12-31'").alias("end"), "years")
    assert [r["start"].year for r in chunks.by_years(spans).orderBy("chunk").collect()] == years


def test_cadence(spark):
    monthly = spark.sql("select 'a' as dataset_id, explode(sequence(timestamp_ntz'2000-01-01', timestamp_ntz'2000-12-01', interval 1 month)) as time")
    daily_ = spark.sql("select 'a' as dataset_id, explode(sequence(timestamp_ntz'2000-01-01', timestamp_ntz'2000-01-30', interval 1 day)) as time")
    assert aggregate.cadence(monthly).first()["steps_per_year"] == 12
    assert aggregate.cadence(daily_).first()["steps_per_year"] == 365


def test_regrid_keeps_a_constant(psl):
    flat = psl.filter("time = timestamp_ntz'1961-01-01'").withColumn("value", F.lit(3.0))
    for method in regrid.METHODS:
        got = regrid.regrid(flat, "0 350 7 30 70 8", method)
        assert {round(r[0], 9) for r in got.select("value").distinct().collect()} == {3.0}


def test_point_in_polygon(spark):
    ring = {"box": [(-5.0, -5.0), (5.0, -5.0), (5.0, 5.0), (-5.0, 5.0)]}
    at = spark.createDataFrame([(0.0, 0.0), (0.0, 358.0), (0.0, 20.0), (9.0, 0.0)], "lat double, lon double")
    assert {tuple(r) for r in polygon.inside(at, polygon.edges(spark, ring)).select("lat", "lon").collect()} == {(0.0, 0.0), (0.0, 358.0)}
    assert polygon.from_geojson('{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1],[0,0]]]}') == {"0": [(0, 0), (1, 0), (1, 1), (0, 0)]}


def test_compaction(spark):
    files = spark.createDataFrame([("a", f"f{k}", s) for k, s in enumerate([40, 50, 30, 90, 10, 5])] + [("b", "g0", 10), ("b", "g1", 90), ("b", "g2", 10)], "ds_id string, path string, size long")
    got = {(r["ds_id"], r["path"]): r["group_no"] for r in manifest.compaction(files, 100).collect()}
    assert [got["a", f"f{k}"] for k in range(6)] == [0, 0, 1, 2, 2, 3]
    assert [got["b", f"g{k}"] for k in range(3)] == [0, 0, 1]


def test_aligned(spark):
    rows = [("a", f"f{y}", f"{y}-01-01T00:00:00", f"{y}-12-31T21:00:00") for y in (2015, 2016, 2017)]
    files = spark.createDataFrame(rows, "ds_id string, path string, fstart string, fend string")
    assert catalog.aligned(files).first()["aligned"]
    assert catalog.aligned(files, "2000-01-01T00:00:00", "2016-12-31T21:00:00").first()["files"] == ["f2015", "f2016"]
    assert not catalog.aligned(files, "2015-02-01T00:00:00", None).first()["aligned"]
    assert not catalog.aligned(files, years=[2015, 2017]).first()["aligned"]


def test_log_lines(spark):
    good = '10.1.2.3 - - [08/Jun/2021:16:08:37 +0200] "GET /outputs/app/1/tas.nc HTTP/1.1" 200 - "-" "agent/1" "-"'
    lines = [good, good.replace("10.1.2.3", "0.0.0.0"), good.replace("10.1.2.3", "::1"), good.replace("200", "ok"), good.replace("08/Jun", "40/Jun"), good.replace("tas.nc", "tas.xml"), "short", ""]
    got = accesslog.downloads(spark.createDataFrame([(x,) for x in lines], "line string")).collect()
    assert [(r["ip_number"], r["size"], str(r["datetime"])) for r in got] == [(10 * 2**24 + 2**16 + 2 * 2**8 + 3, 0, "2021-06-08 16:08:37")]


def test_stream_equals_batch(spark, tmp_path):
    line = '10.1.2.3 - - [0{}/Jun/2021:16:08:37 +0200] "GET /outputs/app/1/tas.nc HTTP/1.1" 200 {} "-" "agent/1" "-"\n'
    (tmp_path / "a.txt").write_text("".join(line.format(1 + k % 3, k) for k in range(12)))
    q = daily.daily_transfer(daily.read_log(spark, str(tmp_path))).writeStream.outputMode("complete").format("memory").queryName("per_day").start()
    q.processAllAvailable()
    q.stop()
    batch = usage.daily(accesslog.downloads(accesslog.read_lines(spark, str(tmp_path))), "datetime", n=F.count("*"), bytes=F.sum("size"))
    assert {tuple(r) for r in spark.sql("select * from per_day").collect()} == {tuple(r) for r in batch.collect()}


def test_starts_before_ends(spark):
    t = lambda h: D(2021, 6, 8, h)
    df = spark.createDataFrame([("a", t(1), t(2)), ("b", t(2), t(3)), ("c", D(2021, 6, 10, 1), D(2021, 6, 10, 2))], "uuid string, time_start timestamp_ntz, time_end timestamp_ntz")
    assert [r["peak"] for r in usage.concurrency_per_day(df).orderBy("day").collect()] == [2, None, 1]


def test_reference_times(spark):
    df = spark.createDataFrame([("p.a.i.m.e.s1960-r1.x", "s196113"), ("p.a.i.m.e.s1960-r1.x", "s196111"), ("p.a.i.m.e.s1960-r1.x", None), ("p.a.i.m.e.r1.x", None)], "dataset_id string, attr string")
    got = [r[0] for r in df.select(fixes.reference_time(F.col("attr"))).collect()]
    assert got == [D(1960, 11, 1), D(1961, 11, 1), D(1960, 11, 1), None]


def test_recipes_repeat(spark):
    df = spark.createDataFrame([("p.a.i.m.e.s1960-r1.x", D(1961, 1, 1), "proleptic_gregorian", {"realization_index": "3"})], "dataset_id string, time timestamp_ntz, calendar string, attrs map<string,string>")
    once = fixes.apply(df, "c3s.cmip6_decadal")
    twice = fixes.apply(once, "c3s.cmip6_decadal").select(once.columns)
    assert once.first().asDict() == twice.first().asDict()
    assert once.first()["leadtime"] == 61 and once.first()["realization"] == 3
    with pytest.raises(ValueError):
        fixes.apply(df, "none")


def test_calendars(spark):
    day = lambda c, y, m, d: spark.range(1).select(fixes.ordinal(F.lit(c), F.lit(y), F.lit(m), F.lit(d))).first()[0]
    assert day("360_day", 2015, 12, 31) == day("360_day", 2015, 12, 30)
    assert day("noleap", 2000, 3, 1) - day("noleap", 2000, 2, 28) == 1
    assert day("all_leap", 2001, 3, 1) - day("all_leap", 2001, 2, 28) == 2


def test_workflow_documents(psl):
    doc = {"doc": "x", "inputs": {"c": ["psl"]}, "outputs": {"o": "w/output"}, "steps": {"s": {"run": "subset", "in": {"collection": "inputs/c", "time": "1962/1962"}}, "w": {"run": "average_time", "in": {"collection": "s/output", "freq": "year", "output_type": "netcdf"}}}}
    assert workflow.execute(doc, {"psl": psl}).count() == 7 * 36
    assert set(workflow.execute(doc, {"psl": psl}, all_outputs=True)) == {"o"}
    with pytest.raises(ValueError, match="steps"):
        workflow.load({"doc": "", "inputs": {}, "outputs": {}})
    with pytest.raises(ValueError, match="circular"):
        workflow.execute({**doc, "steps": {"w": {"run": "average_time", "in": {"collection": "w/output"}}}}, {"psl": psl})
