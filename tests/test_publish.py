"""Versions of a table: writers that die, meet, and come twice; the archive source; names; sources and logs at fault."""

from __future__ import annotations

import datetime
import threading

import pytest
from pyspark.sql import functions as F

from gridloom.functions import names
from gridloom.operators import ensemble
from gridloom.sources import accesslog, archive, catalog, manifest, publish


def test_versions(spark, tmp_path):
    t, rows = f"file://{tmp_path}/t", spark.range(100)
    assert publish.versions(spark, t) == []
    with pytest.raises(FileNotFoundError):
        publish.read(spark, t)
    assert publish.publish(rows, t, "a", base=0) == 1
    assert publish.publish(rows.limit(7), t, "b") == 2
    assert publish.publish(rows.limit(3), t, "a") == 1  # a run comes twice
    assert publish.read(spark, t).count() == 7 and publish.read(spark, t, 1).count() == 100
    with pytest.raises(publish.Conflict):
        publish.publish(rows, t, "late", base=1)
    assert publish.versions(spark, t) == [1, 2] and len(list((tmp_path / "t/data").iterdir())) == 2
    assert publish.manifest_of(spark, t, 2)["rows"] == 7


def test_a_write_that_dies(spark, tmp_path):
    t = f"file://{tmp_path}/t"
    publish.publish(spark.range(10), t, "a")
    bad = spark.range(1000, numPartitions=4).select(F.when(F.col("id") < 900, F.col("id")).otherwise(F.raise_error(F.lit("lost"))).alias("id"))
    with pytest.raises(Exception, match="lost"):
        publish.publish(bad, t, "b")
    assert publish.versions(spark, t) == [1] and publish.read(spark, t).count() == 10 and len(list((tmp_path / "t/data").iterdir())) == 1
    # The writer dies after its rows: nobody sees them, and they can be swept up.
    spark.range(5).write.parquet(f"{t}/data/dead")
    assert publish.read(spark, t).count() == 10
    assert publish.sweep(spark, t) == [] and publish.sweep(spark, t, patience=0) == ["data/dead"]
    assert publish.read(spark, t).count() == 10
    # It dies between its claim and its manifest: the next one takes another number, or waits until the claim is old.
    (tmp_path / "t/versions/000000002.claim").touch()
    with pytest.raises(publish.Conflict):
        publish.publish(spark.range(1), t, "c", base=1)
    assert publish.publish(spark.range(2), t, "d") == 3 and publish.read(spark, t).count() == 2
    (tmp_path / "t/versions/000000004.claim").touch()
    assert publish.publish(spark.range(4), t, "e", base=3, patience=-1) == 4


@pytest.mark.parametrize("base", [None, 0])
def test_writers_that_meet(spark, tmp_path, base):
    t, done, lost = f"file://{tmp_path}/t", [], []

    def write(k):
        try:
            done.append((publish.publish(spark.range(k + 1), t, f"run{k}", base=base), k))
        except publish.Conflict:
            lost.append(k)

    threads = [threading.Thread(target=write, args=(k,)) for k in range(4)]
    for x in threads:
        x.start()
    for x in threads:
        x.join()
    assert sorted(v for v, _ in done) == publish.versions(spark, t) == (list(range(1, 5)) if base is None else [1])
    assert len(done) + len(lost) == 4 and len(list((tmp_path / "t/data").iterdir())) == len(done)
    for version, k in done:
        assert publish.read(spark, t, version).count() == k + 1


def test_archive_reads_files_of_its_years(spark, tmp_path):
    start = F.lit(datetime.datetime(1990, 1, 1))
    rows = spark.range(4000).select(F.lit("tas.day").alias("dataset_id"), (start + F.make_dt_interval(days=F.col("id").cast("int"))).cast("timestamp_ntz").alias("time"), F.col("id").alias("value"))
    rows = rows.withColumn("year", F.year("time"))
    out = f"file://{tmp_path}/a"
    manifest.write_named(rows, out)
    spark.dataSource.register(archive.Archive)
    load = lambda: spark.read.format("archive").load(out)
    with archive.pushed_down(spark):
        assert load().count() == 4000 and set(load().columns) == {"dataset_id", "time", "value", "year"}
    (tmp_path / "a/output=tas_day_29990101-29991231.nc").mkdir()
    (tmp_path / "a/output=tas_day_29990101-29991231.nc/bad.parquet").write_text("not a file that can be read")
    with archive.pushed_down(spark):
        for where, years in (("year = 1993", 1), ("year >= 1993 and year < 1996", 3), ("year in (1990, 1999)", 2), ("year in (1999, 2000) and value > 0", 2), ("year = 1800", 0)):
            got = load().filter(where)
            assert got.count() == rows.filter(where).count()
            assert got.select("value").rdd.getNumPartitions() == years or not years
    assert archive.years_of("x/output=tas_1996_avg-year.nc/part-00000-12.parquet") == (1996, 1996)
    assert archive.years_of("a/tas_day.parquet") is None


def test_names(spark):
    ids = ["c3s-cmip6.ScenarioMIP.INM.INM-CM5-0.ssp245.r1i1p1f1.Amon.rlds.gr1.v20190619", "c3s-cmip5.output1.MPI-M.MPI-ESM-LR.historical.mon.atmos.Amon.r1i1p1.tas.latest", "other.a/b", "c3s-cmip6.short"]
    df = spark.createDataFrame([(i, datetime.datetime(2015, 1, 1), datetime.datetime(2100, 1, 1)) for i in ids], "i string, a timestamp, b timestamp")
    got = [r[0] for r in df.select(names.output_name(F.col("i"), F.col("a"), F.col("b"), names.averaged(freq="year"))).collect()]
    assert got[0] == "rlds_Amon_INM-CM5-0_ssp245_r1i1p1f1_gr1_20150101-21000101_avg-year.nc"
    assert got[2:] == ["other_a_b_20150101-21000101_avg-year.nc", "c3s-cmip6_short_20150101-21000101_avg-year.nc"]
    assert df.select(names.output_name(F.col("i"), done=names.averaged(["time"]))).collect()[1][0] == "tas_mon_MPI-ESM-LR_historical_r1i1p1_avg-t.nc"
    assert names.averaged(["lon", "lat"]) == "avg-xy"


def test_faults_are_errors(spark):
    files = lambda *paths: spark.createDataFrame([("d", p) for p in paths], "ds_id string, path string")
    assert catalog.usable(files("/a.nc", "/b.nc")).count() == 1
    for paths, why in ((("/a.nc", "s3://b.nc"), "mixed transports"), (("/a.zarr", "/b.zarr"), "several stores"), ((), "at least one")):
        with pytest.raises(ValueError, match=why):
            catalog.usable(files(*paths))
    lines = spark.createDataFrame([('1.2.3.4 - - [02/Jan/2020:03:04:05 +0000] "GET /outputs/x/a.nc HTTP/1.1" 200 5 "-" "agent"',)], "line string")
    assert accesslog.downloads(lines, required=True).count() == 1
    assert accesslog.downloads(lines, start="2021-01-01", required=True).count() == 0
    with pytest.raises(ValueError, match="no downloads"):
        accesslog.downloads(lines.limit(0), required=True)


def test_concat_time(spark):
    at = lambda k: datetime.datetime(2000 + k, 1, 1)
    rows = [("a", f"f{k}", at(k), float(lat), float(lon), float(10 * k + lat), 100.0 * k + lat) for k in range(3) for lat in (0, 1) for lon in (5, 6)]
    rows += [("b", f"f{k}", at(k), float(lat), float(lon if k < 2 else 7), 0.0, 0.0) for k in range(3) for lat in (0, 1) for lon in (5, 6)]
    df = spark.createDataFrame(rows, "dataset_id string, file string, time timestamp, lat double, lon double, value double, orog double").repartition(3)
    axes = ("lat", "lon")
    assert [tuple(r) for r in ensemble.concat_faults(df, axes).collect()] == [("b", "f2", "lon")]
    with pytest.raises(ValueError, match="b: f2 has another lon"):
        ensemble.concat_time(df, axes)
    got = ensemble.concat_time(df, axes, ["orog"], strict=False).collect()
    assert len(got) == 12 and {r["dataset_id"] for r in got} == {"a"} and all(r["orog"] == r["lat"] for r in got) and "file" not in got[0].asDict()
