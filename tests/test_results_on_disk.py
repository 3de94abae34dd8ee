"""Writing by period, compaction that carries out its plan, shapes of several rings, derivations."""

from __future__ import annotations

import datetime
import random

import pytest
from pyspark.sql import functions as F

from gridloom.functions import scratch
from gridloom.functions.scratch import cut
from gridloom.operators import fixes, polygon, ranks, usage
from gridloom.plans import fixtures
from gridloom.sources import catalog, manifest


def cells(spark, n=4000):
    start = F.lit(datetime.datetime(2001, 1, 1))
    return spark.range(n).select((start + F.make_dt_interval(hours=F.col("id").cast("int") * 4)).cast("timestamp_ntz").alias("time"), F.col("id").cast("double").alias("value"), F.lit("abcd").alias("name"))


@pytest.mark.parametrize("period", ["year", "month", "day"])
def test_no_file_is_above_the_limit(spark, tmp_path, period):
    df = cells(spark)
    n, width = manifest.row_bytes(df)
    assert (n, width) == (4000, 20)
    manifest.write_by_period(df, f"file://{tmp_path}/x", period, 5000)
    got = spark.read.parquet(f"file://{tmp_path}/x")
    files = manifest.files_of(got).collect()
    assert got.count() == 4000 and max(r["rows"] for r in files) <= 250 and all(r["size"] > 0 for r in files)
    assert set(got.columns) == {"time", "value", "name", *("year", "month", "day")[: ("year", "month", "day").index(period) + 1]}
    with pytest.raises(ValueError):
        manifest.write_by_period(df, f"file://{tmp_path}/y", "week")


def test_compaction_is_carried_out(spark, tmp_path):
    df = cells(spark).withColumn("half", F.when(F.col("value") < 1000, "a").otherwise("b"))
    df.repartition(12).write.partitionBy("half").parquet(f"file://{tmp_path}/in")
    files = manifest.files_of(spark.read.parquet(f"file://{tmp_path}/in"), "half").cache()
    size = files.agg(F.max("size")).first()[0]
    plan = manifest.compaction(files, 3 * size, key="half").cache()
    sizes = {(r["half"], r["group_no"]): r["s"] for r in plan.groupBy("half", "group_no").agg(F.sum("size").alias("s")).collect()}
    assert plan.count() == files.count() and max(sizes.values()) <= 3 * size and len(sizes) < files.count() / 2
    out = manifest.compact(spark, f"file://{tmp_path}/in", plan, f"file://{tmp_path}/out", "half", target=10 * size)
    assert sorted(map(tuple, out.select("value", "half").collect())) == sorted(map(tuple, df.select("value", "half").collect()))
    assert {(r["half"], r["group_no"]) for r in out.select("half", "group_no").distinct().collect()} == set(sizes)
    assert manifest.files_of(out).count() < files.count()
    # A failed merge leaves the inputs as the result, and nothing of its own.
    again = manifest.compact(spark, f"file://{tmp_path}/in", plan, f"file://{tmp_path}/bad", "no_such_column", target=size)
    assert again.count() == 4000 and not (tmp_path / "bad").exists()


def test_compaction_equals_plain_greedy(spark):
    rows = [(f"d{k % 3}", f"p{k:04d}", (k * 37) % 90) for k in range(600)]
    got = {(r["ds_id"], r["path"]): r["group_no"] for r in manifest.compaction(spark.createDataFrame(rows, "ds_id string, path string, size long").repartition(7), 200).collect()}
    for d in ("d0", "d1", "d2"):
        group, total = 0, None
        for _, p, s in sorted(r for r in rows if r[0] == d):
            s = max(1, s)
            group, total = (0, s) if total is None else (group, total + s) if total + s <= 200 else (group + 1, s)
            assert got[d, p] == group
    assert manifest.compaction(spark.createDataFrame([], "ds_id string, path string, size long"), 200).count() == 0


def test_holes_and_parts(spark):
    text = '{"type":"MultiPolygon","coordinates":[[[[0,0],[8,0],[8,8],[0,8],[0,0]],[[2,2],[6,2],[6,6],[2,6],[2,2]]],[[[20,0],[24,0],[24,4],[20,4],[20,0]]]]}'
    shapes = polygon.from_geojson(text)
    assert list(shapes) == ["0"] and len(shapes["0"]) == 3
    at = spark.createDataFrame([(float(y) + 0.5, float(x) + 0.5) for y in range(-1, 10) for x in range(-1, 26)], "lat double, lon double")
    got = {tuple(r) for r in polygon.inside(at, polygon.edges(spark, shapes)).select("lon", "lat").collect()}
    want = {(x + 0.5, y + 0.5) for y in range(-1, 10) for x in range(-1, 26) if (0 <= x < 8 and 0 <= y < 8 and not (2 <= x < 6 and 2 <= y < 6)) or (20 <= x < 24 and 0 <= y < 4)}
    assert got == want


def test_derivations_are_named(spark):
    df = spark.createDataFrame([("a.b.c.m.e.s1990-x",)], "dataset_id string")
    assert df.transform(fixes.derive("d", "start_date")).first()["d"] == datetime.date(1990, 11, 1)
    with pytest.raises(ValueError):
        fixes.derive("d", "os.system")


def test_bootstrap_is_made_once(spark):
    files = spark.createDataFrame([("p", "d", "x", None, "undefined")], "project string, ds_id string, path string, start_time string, end_time string")
    first = catalog.bootstrap(files, "catalog_once")
    assert catalog.bootstrap(files.limit(0), "catalog_once").count() == first.count() == 1
    assert first.first()["start_time"] == catalog.FIRST_TIME
    spark.sql("drop table catalog_once")


def test_requests_without_a_day_count_in_totals(spark):
    t = lambda d, h: datetime.datetime(2020, 1, d, h)
    rows = [("a", "execute", "x", t(1, 1), t(1, 2), 4, None), ("b", "execute", "x", t(4, 1), t(4, 3), 5, None), ("c", "execute", "x", None, None, 4, None)]
    requests = spark.createDataFrame(rows, "uuid string, operation string, identifier string, time_start timestamp_ntz, time_end timestamp_ntz, status int, message string")
    downloads = spark.createDataFrame([(t(1, 1), 1 << 30), (t(2, 1), 1 << 31)], "datetime timestamp_ntz, size long")
    got = {r["property"]: r["value"] for r in usage.overview(requests, downloads).collect()}
    assert (got["total"], got["failed"], got["total_gib"], got["gib_per_request"]) == (3, 1, 3, 1.5)
    assert (got["min_requests_per_day"], got["max_requests_per_day"], got["median_requests_per_day"]) == (0, 1, 0.5)
    assert (got["median_duration"], got["max_concurrency"], got["median_gib_per_day"]) == (5400, 1, 1.5)


def test_compaction_of_a_long_dataset(spark, monkeypatch):
    """Datasets above a task's share are grouped by pointers; the plan is the same."""
    rows = [(f"d{k % 3}" if k % 7 else None, f"p{k % 2000:05d}", (k * 7919) % 120 if k % 50 else 1000) for k in range(2500)]
    files = spark.createDataFrame(rows, "ds_id string, path string, size long").repartition(7)
    told = lambda df: sorted(map(tuple, df.collect()), key=str)
    whole = told(manifest.compaction(files, 300))
    monkeypatch.setattr(ranks, "FEW", 100)
    monkeypatch.setattr(ranks, "SPAN", 64)
    assert ranks.hot_keys(files, ["ds_id"]).count() == 4
    assert told(manifest.compaction(files, 300)) == whole
    assert told(manifest.compaction(files, 10**9)) == [(*r[:3], 0) for r in whole]


def test_compaction_keeps_what_it_did_not_write(spark, tmp_path):
    df = cells(spark, 500)
    df.repartition(4).write.parquet(f"file://{tmp_path}/in")
    plan = manifest.files_of(spark.read.parquet(f"file://{tmp_path}/in").withColumn("k", F.lit("a"))).withColumn("group_no", F.lit(0)).cache()
    kept = tmp_path / "there"
    kept.mkdir()
    (kept / "note.txt").write_text("mine")
    with pytest.raises(FileExistsError):
        manifest.compact(spark, f"file://{tmp_path}/in", plan, f"file://{kept}", "name", "time")
    assert (kept / "note.txt").read_text() == "mine" and len(list(tmp_path.iterdir())) == 2
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        manifest.compact(spark, f"file://{tmp_path}/none", plan, f"file://{tmp_path}/out", "name", "time")
    with pytest.warns(UserWarning, match="not merged"):
        got = manifest.compact(spark, f"file://{tmp_path}/in", plan, f"file://{tmp_path}/out", "no_such_column", "time")
    assert got.count() == 500 and [p.name for p in sorted(tmp_path.iterdir())] == ["in", "there"]
    # A group is one file, however small the tasks.
    merged = manifest.compact(spark, f"file://{tmp_path}/in", plan, f"file://{tmp_path}/out", "name", "time", target=100)
    assert manifest.files_of(merged).count() == 1 and merged.count() == 500


def plain_upstream(edges):
    above = {}
    for e, s in edges:
        above.setdefault(e, set()).add(s)
    out = set()
    for e in above:
        seen, last, d = {e}, {e}, 0
        while last:
            d += 1
            last = {s for x in last for s in above.get(x, ())} - seen
            seen |= last
            out |= {(e, s, d) for s in last}
    return out


@pytest.mark.parametrize("seed", range(3))
def test_upstream(spark, seed):
    """Chains, fans and cycles against a search from each entity."""
    r = random.Random(seed)
    edges = [(f"c{k}", f"c{k - 1}") for k in range(1, 40)] + [(f"n{r.randrange(40)}", f"n{r.randrange(40)}") for _ in range(50)]
    edges += [("c0", "c39") if seed else ("c0", "root"), ("self", "self"), ("n1", "c20"), ("n1", "c20")]
    df = spark.createDataFrame([*edges, (None, "x"), ("x", None)], "entity string, source string").repartition(4)
    got = list(map(tuple, manifest.upstream(df).collect()))
    assert len(got) == len(set(got)) and set(got) == plain_upstream(edges)
    assert manifest.upstream(df.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_compaction_by_ranges_moves_files_twice(spark, monkeypatch, seed):
    """Whatever the sizes, and however many groups, ranges and stretches there are."""
    r = random.Random(seed)
    most = (1, 90, 400, 3)[seed]  # all equal; a few files a group; files above the target; groups longer than a stretch
    rows = [(k % 3 if k % 5 else None, f"p{r.randrange(900):04d}", r.randrange(1, most + 1)) for k in range(3000)]
    files = spark.createDataFrame(rows, "ds_id int, path string, size long").repartition(7)
    told = lambda df: sorted(map(tuple, df.collect()), key=str)
    whole = {target: told(manifest.compaction(files, target)) for target in (0, 200, 1500)}
    monkeypatch.setattr(ranks, "FEW", 100)
    monkeypatch.setattr(manifest, "STRETCH", 50)
    written = []
    monkeypatch.setattr(manifest, "cut", lambda df, label="step": written.append(label) or cut(df, label))
    for target, plan in whole.items():
        written.clear()
        assert told(manifest.compaction(files, target)) == plan
        assert len(written) == 3


def test_tasks_of_a_write_have_a_size_of_their_own(spark, tmp_path, monkeypatch):
    """A task never holds what a file may: few rows a task under a high limit."""
    monkeypatch.setattr(manifest, "TASK_BYTES", 5000, raising=False)
    manifest.write_by_year(cells(spark), f"file://{tmp_path}/x")
    got = spark.read.parquet(f"file://{tmp_path}/x")
    assert got.count() == 4000 and max(r["rows"] for r in manifest.files_of(got).collect()) <= 1000


def test_grid_cells_are_grouped_as_their_columns_say(spark, tmp_path):
    """Keys below 0 and missing ones too: cells are counted by remainders, and named after them."""
    r = random.Random(1)
    some = lambda low, high: None if r.random() < 0.05 else r.randrange(low, high)
    rows = [(some(-70, 70), some(-90, 90), some(-150, 150), some(1, 4), datetime.datetime(2000, 1, 1 + k % 2), r.choice([0.0, 0.1, None]), r.random()) for k in range(3000)]
    lines = spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_shipdate timestamp_ntz, l_tax double, l_quantity double")
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    want = lines.groupBy(*[F.expr(e).alias(c) for c, e in fixtures._GRID.items()]).agg(F.expr(fixtures._VALUE).alias("value"))
    got = fixtures.grid_cells(spark, str(tmp_path))
    told = lambda df: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in row) for row in df.na.fill(-1e9).na.fill("").collect())
    assert got.schema == want.schema and told(got) == told(want) and got.count() > 1000


@pytest.mark.parametrize("named", [False, True])
def test_small_files_are_no_tasks(spark, tmp_path, named):
    """Each task sends samples and a list of its files to the driver; files far below a task's size are not one each."""
    if named:
        manifest.write_named(cells(spark).withColumn("dataset_id", F.lit("d")), f"file://{tmp_path}/x", most_bytes=5000)
    else:
        manifest.write_by_year(cells(spark), f"file://{tmp_path}/x", 5000)
    files = list((tmp_path / "x").rglob("*.parquet"))
    assert len(files) >= 16 and len({f.name.split("-")[1] for f in files}) == 1


def test_upstream_writes_each_pair_once(spark, tmp_path, monkeypatch):
    """Known pairs stay where they are: a round writes what is new alone, in buckets that later rounds read in place."""
    folder = lambda *_: f"file://{tmp_path}"
    monkeypatch.setattr(scratch, "shared_folder", folder)
    monkeypatch.setattr(manifest, "shared_folder", folder, raising=False)
    edges = [(f"c{k}", f"c{k - 1}") for k in range(1, 40)] + [("c0", "root"), ("c7", "c2")]
    got = set(map(tuple, manifest.upstream(spark.createDataFrame(edges, "entity string, source string")).collect()))
    written = [str(p) for p in (tmp_path / "gridloom").rglob("*.parquet")]
    assert got == plain_upstream(edges) and spark.read.parquet(*written).count() == len(got)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("lineage_")]
