"""Queries on gridded cells."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from gridloom.functions.params import Components, Grid, Time
from gridloom.functions.scratch import cut
from gridloom.operators import aggregate as agg
from gridloom.operators import chunks, ensemble, polygon, regrid, select
from gridloom.plans import workflow
from gridloom.plans.fixtures import GRID, SHAPES, grid_cells, table
from gridloom.plans.registry import dts, query, r6, ts

CELL = ["dataset_id", "realization", "level", "lat", "lon"]
CELL_SQL = "dataset_id, realization, level, lat, lon"


def cells(df):
    return df.select(*CELL[:2], ts("time"), *CELL[2:], r6().alias("value"))


def cells_sql(where: str, lon: str = "lon") -> str:
    return GRID + f"select dataset_id, realization, {dts('time')}, level, lat, {lon} as lon, round(value, 6) as value from grid_cells where {where}"


def selection(name: str, where: str, lon: str = "lon", **params):
    query(name, cells_sql(where, lon))(lambda spark, sf, p=params: cells(select.subset(grid_cells(spark, sf), frame=360, **p)))


selection("subset_time", "time >= timestamp '1996-01-01' and time <= timestamp '1996-06-30 23:59:59'", time="1996/1996-06")
selection("subset_time_points", "time in (timestamp '1996-03-01', timestamp '1997-05-05')", time="1996-03-01,1997-05-05")
selection("subset_components", "year(time) in (1996, 1998) and month(time) in (1, 7)", time_components="year:1996,1998|month:jan,jul")
selection("subset_area", "lat >= 30 and lat <= 70 and lon >= 10 and lon <= 45", area="10,30,45,70")
selection("subset_area_wrap", "lat >= 30 and lat <= 70 and (lon >= 350 or lon <= 35)", "case when lon > 350 then lon - 360 when lon < -10 then lon + 360 else lon end", area="-10,30,35,70")
selection("subset_level", "level between 200 and 400", level="200/400")
selection("subset_level_list", "level in (100, 700)", level="100,700")
selection("subset_all", "time >= timestamp '1996-01-01' and time <= timestamp '1998-12-31 23:59:59' and month(time) in (6, 7, 8) and lat between -30 and 30 and lon between 40 and 120 and level in (100, 200)", time="1996/1998", time_components="month:jun,jul,aug", area="40,-30,120,30", level="100,200")
selection("subset_sparse_years", "time >= timestamp '1995-06-01' and year(time) in (1996, 2000) and month(time) = 2", time="1995-06/2001", time_components="year=1996,2000|month=2")
selection("subset_empty", "year(time) = 1850", time_components="year:1850")


@query("scan_dataset", GRID + "select dataset_id, count(*) as n, count(value) as present, round(sum(value), 6) as total from grid_cells where dataset_id like '%.MODEL1.%' group by dataset_id")
def scan_dataset(spark, sf):
    one = grid_cells(spark, sf).filter(F.split("dataset_id", "\\.")[3] == "MODEL1")
    return one.groupBy("dataset_id").agg(F.count("*").alias("n"), F.count("value").alias("present"), r6(F.sum("value")).alias("total"))


@query("static_dim_join", "select l_partkey as cell, p_size as area, count(*) as steps, round(avg(l_quantity), 6) as value from lineitem join part on l_partkey = p_partkey group by 1, 2")
def static_dim_join(spark, sf):
    grid = table(spark, sf, "part").select(F.col("p_partkey").alias("cell"), F.col("p_size").alias("area"))
    at = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("cell")).agg(F.count("*").alias("steps"), r6(F.avg("l_quantity")).alias("value"))
    return ensemble.static_join(at, grid, "cell").select("cell", "area", "steps", "value")


@query("concat_time_exact", GRID + """, f as (select distinct dataset_id, year(time) as y, lat, lon, level from grid_cells),
s as (select dataset_id, y, string_agg(concat(lat, '|', lon, '|', level), ';' order by lat, lon, level) as sig from f group by dataset_id, y)
select dataset_id, count(*) as files, count(distinct sig) = 1 as aligned from s group by dataset_id""")
def concat_time_exact(spark, sf):
    return ensemble.concat_time_exact(grid_cells(spark, sf).withColumn("file", F.year("time")))


#: Positions in coarse boxes, so that the files of a year differ in a few places only.
_BOXES = GRID.rstrip() + """, files as (select dataset_id, cast(year(time) * 10 + quarter(time) as int) as file, time, cast(lat + 90 as int) // 30 as lat, cast(lon as int) // 45 as lon, level, value from grid_cells),
sig as (select dataset_id, file, coordinate, string_agg(distinct cast(p as varchar), ';' order by cast(p as varchar)) as s from (select dataset_id, file, 'lat' as coordinate, lat as p from files union all select dataset_id, file, 'lon', lon from files union all select dataset_id, file, 'level', level from files) group by 1, 2, 3),
faults as (select a.dataset_id, a.file, a.coordinate from sig a join sig b on a.dataset_id = b.dataset_id and a.coordinate = b.coordinate and b.file = (select min(file) from files f where f.dataset_id = a.dataset_id) where a.s <> b.s)
"""


def _boxes(spark, sf):
    lat, lon = F.floor((F.col("lat") + 90).cast("int") / 30), F.floor(F.col("lon").cast("int") / 45)
    return grid_cells(spark, sf).select("dataset_id", (F.year("time") * 10 + F.quarter("time")).alias("file"), "time", lat.alias("lat"), lon.alias("lon"), "level", "value")


@query("concat_time_faults", _BOXES + "select * from faults")
def concat_time_faults(spark, sf):
    return ensemble.concat_faults(_boxes(spark, sf))


@query("concat_time_rows", _BOXES + f"select dataset_id, {dts('time')}, lat, lon, level, count(*) as n, round(sum(value), 6) as total from files where dataset_id not in (select dataset_id from faults) group by all")
def concat_time_rows(spark, sf):
    rows = ensemble.concat_time(_boxes(spark, sf), strict=False)
    return rows.groupBy("dataset_id", ts("time"), "lat", "lon", "level").agg(F.count("*").alias("n"), r6(F.sum("value")).alias("total"))


@query("subset_collection", GRID + "select dataset_id, count(*) as n, round(avg(value), 6) as value from grid_cells where time >= timestamp '1997-01-01' and time <= timestamp '1997-12-31 23:59:59' group by dataset_id")
def subset_collection(spark, sf):
    return select.subset(grid_cells(spark, sf), time="1997/1997").groupBy("dataset_id").agg(F.count("*").alias("n"), r6(F.avg("value")).alias("value"))


def mean(name: str, dims: list[str]):
    left = [c for c in ("dataset_id", "realization", "time", "level", "lat", "lon") if c not in dims]
    sql = GRID + f"select {', '.join(dts(c) if c == 'time' else c for c in left)}, round(avg(value), 6) as value from grid_cells group by {', '.join(f'grid_cells.{c}' for c in left)}"
    query(name, sql)(lambda spark, sf: agg.average(grid_cells(spark, sf), dims).select(*[ts(c) if c == "time" else c for c in left], r6().alias("value")))


mean("average_time_dim", ["time"])
mean("average_latlon", ["lat", "lon"])
mean("average_level", ["level"])
mean("average_realization", ["realization"])
mean("average_multi", ["time", "level", "lon"])


def period(freq: str):
    sql = GRID + f"select dataset_id, realization, strftime(date_trunc('{freq}', time), '%Y-%m-%d %H:%M:%S') as time, level, round(avg(value), 6) as value from (select dataset_id, realization, time, level, avg(value) as value from grid_cells group by 1, 2, 3, 4) group by dataset_id, realization, date_trunc('{freq}', time), level"
    query(f"average_{freq}", sql)(lambda spark, sf: agg.average_time(agg.average(grid_cells(spark, sf), ["lat", "lon"]), freq).select("dataset_id", "realization", ts("time"), "level", r6().alias("value")))


for _freq in ("year", "month", "day"):
    period(_freq)

_W = "cos(radians(lat))"
_WMEAN = f"round(sum({_W} * value) / sum(case when value is not null then {_W} end), 6) as value"


@query("weighted_average", GRID + f"select dataset_id, realization, {dts('time')}, level, {_WMEAN} from grid_cells group by dataset_id, realization, grid_cells.time, level")
def weighted_average(spark, sf):
    return agg.weighted_average(grid_cells(spark, sf)).select("dataset_id", "realization", ts("time"), "level", r6().alias("value"))


@query("ensemble_mean", GRID + f"select {dts('time')}, level, lat, lon, round(avg(value), 6) as value from grid_cells group by grid_cells.time, level, lat, lon")
def ensemble_mean(spark, sf):
    return agg.ensemble_mean(grid_cells(spark, sf)).select(ts("time"), "level", "lat", "lon", r6().alias("value"))


@query("cadence", GRID + """, a as (select dataset_id, count(distinct time) as n, min(time) as t0, max(time) as t1 from grid_cells group by 1)
select dataset_id, n, cast(greatest(1, case when t1 > t0 then floor((n - 1) * 31556952.0 / date_diff('second', t0, t1) + 0.5) else n end) as bigint) as steps_per_year from a""")
def cadence(spark, sf):
    return agg.cadence(grid_cells(spark, sf))


@query("dataset_profile", GRID + "select dataset_id, count(distinct time) as n_time, count(distinct level) as n_level, count(distinct lat) as n_lat, count(distinct lon) as n_lon, count(distinct realization) as n_realization, count(*) as cells, count(value) as present from grid_cells group by 1")
def dataset_profile(spark, sf):
    return agg.profile(grid_cells(spark, sf))


@query("payload_per_step", GRID + "select dataset_id, cast(ceil(count(value) * 8.0 / count(distinct time)) as bigint) as bytes_per_step from grid_cells group by 1")
def payload_per_step(spark, sf):
    return agg.payload_per_step(grid_cells(spark, sf))


# ---- ensembles and chunks ------------------------------------------------------------------


def _members(spark, sf, which=(1, 2, 3)):
    g = grid_cells(spark, sf)
    return [g.filter(F.col("realization") == k) for k in which]


#: All members of ``grid_cells``; the queries named ..._all take every one, and all times.
ALL = tuple(range(1, 11))


@query("concat_members", GRID + "select realization, count(*) as n, round(sum(value), 6) as total from grid_cells where realization in (1, 2, 3) group by 1")
def concat_members(spark, sf):
    return ensemble.stack(_members(spark, sf)).groupBy("realization").agg(F.count("*").alias("n"), r6(F.sum("value")).alias("total"))


@query("concat_subset", cells_sql("realization in (1, 2, 3) and year(time) = 1996 and month(time) = 8 and lat between 30 and 70 and (lon >= 350 or lon <= 35)", "case when lon > 350 then lon - 360 else lon end"))
def concat_subset(spark, sf):
    return cells(ensemble.concat(_members(spark, sf), time="1995/1997", time_components="year:1996|month:8", area="-10,30,35,70", frame=360))


@query("concat_mean_subset", GRID + f"select {dts('time')}, level, lat, lon, round(avg(value), 6) as value from grid_cells where realization in (1, 2, 3) and time >= timestamp '1996-01-01' and time <= timestamp '1997-12-31 23:59:59' group by grid_cells.time, level, lat, lon")
def concat_mean_subset(spark, sf):
    return ensemble.concat(_members(spark, sf), time="1996/1997", apply_average=True).select(ts("time"), "level", "lat", "lon", r6().alias("value"))


@query("ensemble_align", GRID + f""", w as (select distinct time, level, lat, lon from grid_cells where year(time) = 1996 and realization <= 3), m as (select distinct realization from grid_cells where year(time) = 1996 and realization <= 3),
v as (select time, level, lat, lon, realization, avg(value) as value from grid_cells where year(time) = 1996 and realization <= 3 group by all)
select {dts('w.time', 'time')}, w.level, w.lat, w.lon, m.realization, round(value, 6) as value from w, m left join v on v.time = w.time and v.level = w.level and v.lat = w.lat and v.lon = w.lon and v.realization = m.realization""")
def ensemble_align(spark, sf):
    g = select.subset(grid_cells(spark, sf), time="1996/1996").filter("realization <= 3")
    return ensemble.align(g).select(ts("time"), "level", "lat", "lon", "realization", r6().alias("value"))


@query("concat_members_all", GRID + "select realization, count(*) as n, round(sum(value), 6) as total from grid_cells group by 1")
def concat_members_all(spark, sf):
    return ensemble.stack(_members(spark, sf, ALL)).groupBy("realization").agg(F.count("*").alias("n"), r6(F.sum("value")).alias("total"))


@query("concat_subset_all", cells_sql("year(time) = 1996 and month(time) = 8 and lat between 30 and 70 and (lon >= 350 or lon <= 35)", "case when lon > 350 then lon - 360 else lon end"))
def concat_subset_all(spark, sf):
    return cells(ensemble.concat(_members(spark, sf, ALL), time="1995/1997", time_components="year:1996|month:8", area="-10,30,35,70", frame=360))


@query("concat_mean_subset_all", GRID + f"select {dts('time')}, level, lat, lon, round(avg(value), 6) as value from grid_cells where time >= timestamp '1996-01-01' and time <= timestamp '1997-12-31 23:59:59' group by grid_cells.time, level, lat, lon")
def concat_mean_subset_all(spark, sf):
    return ensemble.concat(_members(spark, sf, ALL), time="1996/1997", apply_average=True).select(ts("time"), "level", "lat", "lon", r6().alias("value"))


# No SQL: its product of cells and members is slow on whole tables; tests compare with brute force.
@query("ensemble_align_all")
def ensemble_align_all(spark, sf):
    return ensemble.align(grid_cells(spark, sf)).select(ts("time"), "level", "lat", "lon", "realization", r6().alias("value"))


@query("chunk_timesteps", GRID + f""", a as (select dataset_id, time, row_number() over (partition by dataset_id order by time) - 1 as k from (select distinct dataset_id, time from grid_cells)),
c as (select dataset_id, cast(k // 200 as int) as chunk, min(time) as s, max(time) as l, count(*) as n from a group by 1, 2)
select dataset_id, chunk, {dts('s', 'start')}, strftime(coalesce(lead(s) over (partition by dataset_id order by chunk) - interval 1 second, l), '%Y-%m-%d %H:%M:%S') as "end", n from c""")
def chunk_timesteps(spark, sf):
    return chunks.by_steps(grid_cells(spark, sf), 200).select("dataset_id", "chunk", ts("start"), ts("end"), "n")


def _year_chunks(spark, sf):
    g = grid_cells(spark, sf)
    ends = g.groupBy("dataset_id").agg(F.min("time").alias("start"), F.max("time").alias("end"))
    rate = agg.cadence(g).select("dataset_id", chunks.chunk_years(F.col("steps_per_year"), 500, 1, 10).alias("years"))
    return chunks.by_years(ends.join(rate, "dataset_id"))


_YEARS = """, a as (select dataset_id, count(distinct time) as n, min(time) as t0, max(time) as t1 from grid_cells group by 1),
p as (select dataset_id, t0, t1, cast(greatest(1, least(10, floor(500.0 / greatest(1, floor((n - 1) * 31556952.0 / date_diff('second', t0, t1) + 0.5))))) as int) as y from a),
k as (select *, cast(unnest(range(0, 40)) as int) as chunk from p),
yc as (select dataset_id, chunk, t0 + to_years(y * chunk) as s, least(t1, t0 + to_years(y * (chunk + 1)) - interval 1 second) as e from k where t0 + to_years(y * chunk) <= t1)
"""


@query("chunk_years", GRID + _YEARS + f"select dataset_id, chunk, {dts('s', 'start')}, strftime(e, '%Y-%m-%d %H:%M:%S') as \"end\" from yc")
def chunk_years(spark, sf):
    return _year_chunks(spark, sf).select("dataset_id", "chunk", ts("start"), ts("end"))


@query("batch_year_filter", GRID + _YEARS + f"select dataset_id, chunk, {dts('s', 'start')} from yc where 1997 between year(s) and year(e) or 2001 between year(s) and year(e)")
def batch_year_filter(spark, sf):
    return chunks.with_year_in(_year_chunks(spark, sf), [1997, 2001]).select("dataset_id", "chunk", ts("start"))


@query("chunk_plan", GRID + """, a as (select dataset_id, count(distinct time) as n, min(time) as t0, max(time) as t1 from grid_cells group by 1),
p as (select dataset_id, n, cast(greatest(1, floor((n - 1) * 31556952.0 / date_diff('second', t0, t1) + 0.5)) as bigint) as steps_per_year from a)
select dataset_id, n, steps_per_year, case when n <= 400 then 'whole' when steps_per_year > 400 then 'steps' else 'years' end as kind,
case when n > 400 and steps_per_year <= 400 then cast(greatest(1, least(50, floor(400.0 / steps_per_year))) as int) else 0 end as years, case when n > 400 and steps_per_year > 400 then 400 else 0 end as steps from p""")
def chunk_plan(spark, sf):
    return chunks.plan(grid_cells(spark, sf), 400).fillna(0, ["years", "steps"])


@query("chunked_subset", GRID + _YEARS + "select g.dataset_id, chunk, count(*) as n, round(sum(value), 6) as total from grid_cells g join yc on g.dataset_id = yc.dataset_id and g.time >= s and g.time <= e where lat >= 0 group by 1, 2")
def chunked_subset(spark, sf):
    g = grid_cells(spark, sf).filter("lat >= 0")
    return chunks.chunked(g, _year_chunks(spark, sf)).groupBy("dataset_id", "chunk").agg(F.count("*").alias("n"), r6(F.sum("value")).alias("total"))


# ---- grids -----------------------------------------------------------------------------------

_MEAN = "m as (select lat, lon, avg(value) as value from grid_cells group by lat, lon)"


def _mean_map(spark, sf):
    return agg.average(grid_cells(spark, sf).drop("dataset_id", "variable"), ["time", "level", "realization"])


def _targets(grid: str):
    return lambda spark, sf: regrid.target_cells(grid_cells(spark, sf), Grid.parse(grid)).groupBy("row", "col").agg(F.count("*").alias("n"), r6(F.avg("value")).alias("value"))


query("target_grid", GRID + "select cast(floor((lat + 90) / 10) as int) as row, cast(floor((case when lon >= 180 then lon - 180 else lon + 180 end) / 20) as int) as col, count(*) as n, round(avg(value), 6) as value from grid_cells group by 1, 2")(_targets("20 10"))
query("target_grid_named", GRID + "select cast(floor((lat + 90) / 2.5) as int) as row, cast(floor((case when lon >= 180 then lon - 180 else lon + 180 end) / 2.5) as int) as col, count(*) as n, round(avg(value), 6) as value from grid_cells group by 1, 2")(_targets("2pt5deg"))

_AXES = ", tlat as (select cast(-90 + {d} * (i + 0.5) as double) as tlat from range(0, cast(180 / {d} as int)) r(i)), tlon as (select cast(-180 + {d} * (i + 0.5) as double) as tlon from range(0, cast(360 / {d} as int)) r(i))"


def _regrid(method: str, grid: str, threshold=0.5):
    return lambda spark, sf: regrid.regrid(_mean_map(spark, sf), grid, method, threshold).select("lat", "lon", r6().alias("value"))


query("regrid_nearest", GRID + ", " + _MEAN + _AXES.format(d="4.0") + """
select tlat as lat, tlon as lon, round(value, 6) as value from tlat, tlon, m
where m.lat = -87.5 + 5 * greatest(0, least(35, ceil((tlat + 87.5) / 5 - 0.5))) and m.lon = 2.5 + 5 * ((cast(ceil((tlon - 2.5) / 5 - 0.5) as int) % 72 + 72) % 72)""")(_regrid("nearest_s2d", "4"))
query("regrid_bilinear", GRID + ", " + _MEAN + _AXES.format(d="4.0") + """
, f as (select tlat, tlon, greatest(0, least(35, (tlat + 87.5) / 5)) as fy, (tlon - 2.5) / 5 as fx from tlat, tlon),
k as (select tlat, tlon, least(35, floor(fy) + dy) as iy, case dy when 0 then 1 - (fy - floor(fy)) else fy - floor(fy) end as wy, (cast(floor(fx) as int) + dx + 144) % 72 as ix, case dx when 0 then 1 - (fx - floor(fx)) else fx - floor(fx) end as wx from f, (values (0), (1)) a(dy), (values (0), (1)) b(dx)),
s as (select tlat, tlon, sum(wy * wx * value) as v, sum(case when value is not null then wy * wx end) as g, sum(wy * wx) as w from k join m on m.lat = -87.5 + 5 * iy and m.lon = 2.5 + 5 * ix where wy > 1e-12 and wx > 1e-12 group by 1, 2)
select tlat as lat, tlon as lon, round(case when g / w >= 0.5 - 1e-9 then v / g end, 6) as value from s""")(_regrid("bilinear", "4"))
_CONS = """
, wy as (select tlat, lat, sin(radians(least(90, tlat + 6, lat + 2.5))) - sin(radians(greatest(-90, tlat - 6, lat - 2.5))) as wy from tlat, (select distinct lat from m) where least(tlat + 6, lat + 2.5) - greatest(tlat - 6, lat - 2.5) > 1e-12),
wx as (select tlon, lon, sum(least(tlon + 6, lon + t + 2.5) - greatest(tlon - 6, lon + t - 2.5)) as wx from tlon, (select distinct lon from m), (values (-360), (0), (360)) a(t) where least(tlon + 6, lon + t + 2.5) - greatest(tlon - 6, lon + t - 2.5) > 1e-12 group by 1, 2),
s as (select tlat, tlon, sum(wy * wx * value) as v, sum(case when value is not null then wy * wx end) as g, sum(wy * wx) as w from {m} join wy using (lat) join wx using (lon) group by 1, 2)
select tlat as lat, tlon as lon, round({value}, 6) as value from s"""
query("regrid_conservative", GRID + ", " + _MEAN + _AXES.format(d="12.0") + _CONS.format(m="m", value="v / g"))(_regrid("conservative", "12", None))


@query("regrid_masked", GRID + ", " + _MEAN + _AXES.format(d="12.0") + ", h as (select lat, lon, case when (lat > 0 and lon < 150) or lat > 60 then null else value end as value from m)" + _CONS.format(m="h", value="case when g / w >= 0.75 - 1e-9 then v / g end"))
def regrid_masked(spark, sf):
    held = _mean_map(spark, sf).withColumn("value", F.when(~(((F.col("lat") > 0) & (F.col("lon") < 150)) | (F.col("lat") > 60)), F.col("value")))
    return regrid.regrid(held, "12", "conservative", 0.25).select("lat", "lon", r6().alias("value"))


def _edge_rows() -> str:
    rows = [(n, *a, *b) for n, ring in SHAPES.items() for a, b in zip(ring, ring[1:], strict=False)]
    return ", ".join(f"('{n}', {a}, {b}, {c}, {d})" for n, a, b, c, d in rows)


@query("average_shape", GRID + f""", e(geom, x1, y1, x2, y2) as (select column0, cast(column1 as double), cast(column2 as double), cast(column3 as double), cast(column4 as double) from (values {_edge_rows()}) v(column0, column1, column2, column3, column4)),
p as (select lat, lon, case when lon > 180 then lon - 360 else lon end as x from (select distinct lat, lon from grid_cells)),
i as (select lat, lon, geom from p, e where (y1 > lat) <> (y2 > lat) and x < (x2 - x1) * (lat - y1) / (y2 - y1) + x1 group by 1, 2, 3 having count(*) % 2 = 1)
select geom, realization, level, {_WMEAN} from grid_cells join i using (lat, lon) group by 1, 2, 3""")
def average_shape(spark, sf):
    g = grid_cells(spark, sf).drop("dataset_id", "variable")
    # The time mean is asked for with the area mean, so it is one grouping.
    return polygon.average_shape(g.drop("time"), polygon.edges(spark, SHAPES)).select("geom", "realization", "level", r6().alias("value"))


@query("average_shape_exact", GRID + f""", e(geom, x1, y1, x2, y2) as (select column0, cast(column1 as double), cast(column2 as double), cast(column3 as double), cast(column4 as double) from (values {_edge_rows()}) v(column0, column1, column2, column3, column4)),
c as (select lat, lon, lat - 2.5 as c, lat + 2.5 as d, lon + turn - 2.5 as a, lon + turn + 2.5 as b from (select distinct lat from grid_cells), (select distinct lon from grid_cells), (values (-360), (0)) t(turn)),
p as (select geom, lat, lon, radians(c) as c, radians(d) as d, sign(x2 - x1) as s, radians(greatest(a, least(x1, x2))) as xa, radians(least(b, greatest(x1, x2))) as xb,
  radians(y1 + (y2 - y1) / (x2 - x1) * (greatest(a, least(x1, x2)) - x1)) as ya, radians(y1 + (y2 - y1) / (x2 - x1) * (least(b, greatest(x1, x2)) - x1)) as yb from e, c where x1 <> x2 and least(b, greatest(x1, x2)) > greatest(a, least(x1, x2))),
h as (select *, case when ya < c then sin(c) * (ya - c) when ya > d then cos(c) - cos(d) + sin(d) * (ya - d) else cos(c) - cos(ya) end as ha, case when yb < c then sin(c) * (yb - c) when yb > d then cos(c) - cos(d) + sin(d) * (yb - d) else cos(c) - cos(yb) end as hb from p),
g as (select geom, lat, lon, abs(sum(s * (xb - xa) * (case when abs(yb - ya) < 1e-14 then sin(greatest(c, least(d, ya))) else (hb - ha) / (yb - ya) end - sin(c)))) as area from h group by 1, 2, 3)
select geom, realization, level, round(sum(area * value) / sum(case when value is not null then area end), 6) as value from grid_cells join g using (lat, lon) where area > 1e-12 group by 1, 2, 3""")
def average_shape_exact(spark, sf):
    g = grid_cells(spark, sf).drop("dataset_id", "variable", "time")
    return polygon.average_shape_exact(g, polygon.oriented(spark, SHAPES)).select("geom", "realization", "level", r6().alias("value"))


@query("shape_areas", f"""with e(geom, x1, y1, x2, y2) as (select column0, radians(column1), radians(column2), radians(column3), radians(column4) from (values {_edge_rows()}) v(column0, column1, column2, column3, column4)),
n as (select count(distinct l_partkey % 36) as rows from lineitem)
select geom, round(abs(sum((x2 - x1) * case when y1 = y2 then sin(y1) else (cos(y1) - cos(y2)) / (y2 - y1) end)), 9) as area from e, n where rows = 36 group by 1""")
def shape_areas(spark, sf):
    """What a shape has of all cells adds up to its area on the sphere, if the cells cover the sphere."""
    lats = regrid.positions(grid_cells(spark, sf), "lat")
    found = polygon.areas(spark, lats, [2.5 + 5 * k for k in range(72)], polygon.oriented(spark, SHAPES))
    return found.groupBy("geom").agg(F.round(F.sum("area"), 9).alias("area"))


#: One shape with a hole, and one of two parts.
HOLED = """{"type": "FeatureCollection", "features": [
{"type": "Feature", "properties": {"name": "ring"}, "geometry": {"type": "Polygon", "coordinates": [[[10, -40], [60, -40], [60, 40], [10, 40], [10, -40]], [[20, -20], [40, -20], [40, 20], [20, 20], [20, -20]]]}},
{"type": "Feature", "properties": {"name": "two"}, "geometry": {"type": "MultiPolygon", "coordinates": [[[[100, 0], [140, 0], [140, 30], [100, 30], [100, 0]]], [[[-80, -30], [-40, -30], [-40, 10], [-80, 10], [-80, -30]]]]}}]}"""


@query("average_shape_parts", GRID + f""", i as (select lat, lon, case when x between 10 and 60 then 'ring' else 'two' end as geom from (select distinct lat, lon, case when lon > 180 then lon - 360 else lon end as x from grid_cells)
  where (x between 10 and 60 and lat between -40 and 40 and not (x between 20 and 40 and lat between -20 and 20)) or (x between 100 and 140 and lat between 0 and 30) or (x between -80 and -40 and lat between -30 and 10))
select geom, realization, level, {_WMEAN} from grid_cells join i using (lat, lon) group by 1, 2, 3""")
def average_shape_parts(spark, sf):
    g = grid_cells(spark, sf).drop("dataset_id", "variable", "time")
    return polygon.average_shape(g, polygon.edges(spark, polygon.from_geojson(HOLED))).select("geom", "realization", "level", r6().alias("value"))


# ---- remapping from uneven axes and from positions that are no axes -----------------------------

#: Gaussian latitudes of 36 rows: the zeros of a Legendre polynomial, from south to north.
GAUSS = [round(float(x), 6) for x in np.degrees(np.arcsin(np.polynomial.legendre.leggauss(36)[0]))]
#: The mean map on these latitudes, and without the longitudes of a sector.
_UNEVEN = f", u as (select ([{', '.join(map(str, GAUSS))}])[cast((lat + 87.5) / 5 as int) + 1] as lat, lon, value from m where lon not between 100 and 150)"
_AXIS = """, plat as (select lat, row_number() over (order by lat) as k from (select distinct lat from u)), plon as (select lon + turn as place, lon, row_number() over (order by lon + turn) as k from (select distinct lon from u), (values (-360), (0), (360)) t(turn))"""
_WEIGHTED = """, s as (select tlat, tlon, sum(wy * wx * value) as v, sum(case when value is not null then wy * wx end) as g, sum(wy * wx) as w from u join wlat using (lat) join wlon using (lon) group by 1, 2)
select tlat as lat, tlon as lon, round(case when g / w >= 0.5 - 1e-9 then v / g end, 6) as value from s"""


def _uneven(spark, sf):
    row = ((F.col("lat") + 87.5) / 5).cast("int")
    return _mean_map(spark, sf).filter("lon not between 100 and 150").withColumn("lat", F.element_at(F.array(*[F.lit(x) for x in GAUSS]), row + 1))


def _regrid_uneven(method: str, grid: str):
    return lambda spark, sf: regrid.regrid(_uneven(spark, sf), grid, method).select("lat", "lon", r6().alias("value"))


query("regrid_nearest_uneven", GRID + ", " + _MEAN + _AXES.format(d="4.0") + _UNEVEN + _AXIS + """,
wlat as (select tlat, arg_min(lat, {'d': round(abs(lat - tlat), 9), 'p': lat}) as lat, 1.0 as wy from tlat, plat group by 1), wlon as (select tlon, arg_min(lon, {'d': round(abs(place - tlon), 9), 'p': place}) as lon, 1.0 as wx from tlon, plon group by 1)""" + _WEIGHTED)(_regrid_uneven("nearest_s2d", "4"))
query("regrid_bilinear_uneven", GRID + ", " + _MEAN + _AXES.format(d="4.0") + _UNEVEN + _AXIS + """,
clat as (select tlat, greatest((select min(lat) from plat), least((select max(lat) from plat), tlat)) as x from tlat),
blat as (select tlat, x, max(case when lat <= x then lat end) as a, min(case when lat > x then lat end) as b from clat, plat group by 1, 2),
wlat as (select tlat, a as lat, case when b is null then 1.0 else 1 - (x - a) / (b - a) end as wy from blat where b is null or (x - a) / (b - a) < 1 - 1e-12 union all select tlat, b, (x - a) / (b - a) from blat where b is not null and (x - a) / (b - a) > 1e-12),
blon as (select tlon, max(case when place <= tlon then place end) as a, min(case when place > tlon then place end) as b from tlon, plon group by 1),
wlon as (select tlon, lon, 1 - (tlon - a) / (b - a) as wx from blon join plon on place = a union all select tlon, lon, (tlon - a) / (b - a) from blon join plon on place = b where (tlon - a) / (b - a) > 1e-12)""" + _WEIGHTED)(_regrid_uneven("bilinear", "4"))
query("regrid_conservative_uneven", GRID + ", " + _MEAN + _AXES.format(d="12.0") + _UNEVEN + _AXIS + """,
elat as (select lat, coalesce((lat + lag(lat) over w) / 2, lat - (lead(lat) over w - lat) / 2) as a, coalesce((lat + lead(lat) over w) / 2, lat + (lat - lag(lat) over w) / 2) as b from plat window w as (order by lat)),
elon as (select lon, (place + lag(place) over w) / 2 as a, (place + lead(place) over w) / 2 as b from plon window w as (order by place)),
wlat as (select tlat, lat, sin(radians(least(90, tlat + 6, b))) - sin(radians(greatest(-90, tlat - 6, a))) as wy from tlat, elat where least(90, tlat + 6, b) - greatest(-90, tlat - 6, a) > 1e-12),
wlon as (select tlon, lon, sum(least(tlon + 6, b) - greatest(tlon - 6, a)) as wx from tlon, elon where a is not null and b is not null and least(tlon + 6, b) - greatest(tlon - 6, a) > 1e-12 group by 1, 2)""" + _WEIGHTED)(_regrid_uneven("conservative", "12"))

#: A bent grid, whose positions are pairs.
BENT = {"lat": "round(lat * 0.95 + 3 * sin(radians(lon)), 6)", "lon": "round(lon + 8 * cos(radians(2 * lat)), 6)"}


@query("regrid_curvilinear", GRID + ", " + _MEAN + _AXES.format(d="6.0") + f""", u as (select {BENT['lat']} as lat, {BENT['lon']} as lon, value from m),
p as (select lat, lon, value, cos(radians(lat)) * cos(radians(lon)) as x, cos(radians(lat)) * sin(radians(lon)) as y, sin(radians(lat)) as z from u),
t as (select tlat, tlon, cos(radians(tlat)) * cos(radians(tlon)) as a, cos(radians(tlat)) * sin(radians(tlon)) as b, sin(radians(tlat)) as c from tlat, tlon)
select tlat as lat, tlon as lon, round(arg_min(value, {{'d': round(sqrt((x - a) * (x - a) + (y - b) * (y - b) + (z - c) * (z - c)), 12), 'p': lat, 'l': lon}}), 6) as value from t, (select lat, lon, x, y, z, coalesce(value, -999) as value from p) group by 1, 2""")
def regrid_curvilinear(spark, sf):
    bent = _mean_map(spark, sf).select(*[F.expr(e) for e in BENT.values()], F.coalesce("value", F.lit(-999.0)).alias("value")).toDF(*BENT, "value")
    return regrid.regrid_scattered(bent, "6").select("lat", "lon", r6().alias("value"))


_CORNERS = ((-2.5, -2.5), (-2.5, 2.5), (2.5, 2.5), (2.5, -2.5))
_EDGES = ", ".join(f"({a}, {b}, {c}, {d})" for (a, b), (c, d) in zip(_CORNERS, (*_CORNERS[1:], _CORNERS[0]), strict=True))


def _bent(lat: str, lon: str) -> dict[str, str]:
    return {k: e.replace("lat", "@").replace("lon", f"({lon})").replace("@", f"({lat})") for k, e in BENT.items()}


@query("regrid_conservative_curvilinear", GRID + ", " + _MEAN + _AXES.format(d="12.0") + f""",
e as (select lat, lon, value, {_bent('lat + a', 'lon + b')['lon']} as x1, {_bent('lat + a', 'lon + b')['lat']} as y1, {_bent('lat + c', 'lon + d')['lon']} as x2, {_bent('lat + c', 'lon + d')['lat']} as y2 from m, (values {_EDGES}) v(a, b, c, d)),
t as (select tlat, tlon, tlat - 6 as c, tlat + 6 as d, tlon + turn - 6 as a, tlon + turn + 6 as b from tlat, tlon, (values (-360), (0), (360)) r(turn)),
p as (select lat, lon, value, tlat, tlon, radians(c) as c, radians(d) as d, sign(x2 - x1) as s, radians(greatest(a, least(x1, x2))) as xa, radians(least(b, greatest(x1, x2))) as xb,
  radians(y1 + (y2 - y1) / (x2 - x1) * (greatest(a, least(x1, x2)) - x1)) as ya, radians(y1 + (y2 - y1) / (x2 - x1) * (least(b, greatest(x1, x2)) - x1)) as yb from e, t where x1 <> x2 and least(b, greatest(x1, x2)) > greatest(a, least(x1, x2))),
h as (select *, case when ya < c then sin(c) * (ya - c) when ya > d then cos(c) - cos(d) + sin(d) * (ya - d) else cos(c) - cos(ya) end as ha, case when yb < c then sin(c) * (yb - c) when yb > d then cos(c) - cos(d) + sin(d) * (yb - d) else cos(c) - cos(yb) end as hb from p),
g as (select lat, lon, any_value(value) as value, tlat, tlon, abs(sum(s * (xb - xa) * (case when abs(yb - ya) < 1e-9 then sin(greatest(c, least(d, (ya + yb) / 2))) else (hb - ha) / (yb - ya) end - sin(c)))) as area from h group by lat, lon, tlat, tlon)
select tlat as lat, tlon as lon, round(case when sum(case when value is not null then area end) / sum(area) >= 0.5 - 1e-9 then sum(area * value) / sum(case when value is not null then area end) end, 5) as value from g where area > 1e-9 group by 1, 2""")
def regrid_conservative_curvilinear(spark, sf):
    """The bent grid's cells have bent corners; what each shares with a target is exact."""
    mean = cut(_mean_map(spark, sf), "mean-map")  # one row a position, for values and for corners
    at = F.array(*[F.struct(*[F.expr(e).alias(k) for k, e in _bent(f"lat + {a}", f"lon + {b}").items()]) for a, b in _CORNERS])
    return polygon.regrid_cells(mean, mean.select("lat", "lon", at.alias("corners")), "12").select("lat", "lon", F.round("value", 5).alias("value"))


# ---- workflows -------------------------------------------------------------------------------


def _flow(steps: dict, out: str) -> dict:
    return {"doc": "test", "inputs": {"cells": "cells"}, "outputs": {"output": f"{out}/output"}, "steps": steps}


def _run(spark, sf, steps: dict, out: str):
    return workflow.execute(_flow(steps, out), {"cells": grid_cells(spark, sf)})


_SUB = {"run": "subset", "in": {"collection": "inputs/cells", "time": "1996/1997", "area": "0,-40,90,40", "frame": 360}}
_SUB_SQL = "time >= timestamp '1996-01-01' and time <= timestamp '1997-12-31 23:59:59' and lat between -40 and 40 and lon between 0 and 90"


@query("wf_subset_average", GRID + f"select dataset_id, realization, strftime(date_trunc('year', time), '%Y-%m-%d %H:%M:%S') as time, level, lat, lon, round(avg(value), 6) as value from grid_cells where {_SUB_SQL} group by dataset_id, realization, date_trunc('year', time), level, lat, lon")
def wf_subset_average(spark, sf):
    return cells(_run(spark, sf, {"s": _SUB, "a": {"run": "average_time", "in": {"collection": "s/output", "freq": "year"}}}, "a"))


@query("wf_average_latlon", GRID + f"select dataset_id, realization, {dts('time')}, level, round(avg(value), 6) as value from grid_cells where {_SUB_SQL} group by dataset_id, realization, grid_cells.time, level")
def wf_average_latlon(spark, sf):
    return _run(spark, sf, {"s": _SUB, "a": {"run": "average", "in": {"collection": "s/output", "dims": "latitude,longitude"}}}, "a").select("dataset_id", "realization", ts("time"), "level", r6().alias("value"))


@query("wf_subset_weighted_average", GRID + f"select realization, strftime(date_trunc('month', time), '%Y-%m-%d %H:%M:%S') as time, level, round(avg(value), 6) as value from (select dataset_id, realization, time, level, sum({_W} * value) / sum(case when value is not null then {_W} end) as value from grid_cells where {_SUB_SQL} group by 1, 2, 3, 4) group by realization, date_trunc('month', time), level")
def wf_subset_weighted_average(spark, sf):
    steps = {"s": _SUB, "w": {"run": "weighted_average", "in": {"collection": "s/output"}}}
    daily = _run(spark, sf, steps, "w").drop("dataset_id")
    return agg.average_time(daily, "month").select("realization", ts("time"), "level", r6().alias("value"))


@query("wf_subset_regrid", GRID + ", " + f"m as (select level, lat, lon, avg(value) as value from grid_cells where {_SUB_SQL} group by 1, 2, 3)" + ", tlat as (select cast(-36 + 12 * i as double) as tlat from range(0, 7) r(i)), tlon as (select cast(6 + 12 * i as double) as tlon from range(0, 7) r(i))" + _CONS.format(m="m", value="case when g / w >= 0.5 - 1e-9 then v / g end").replace("select tlat, tlon, sum(wy * wx * value)", "select level, tlat, tlon, sum(wy * wx * value)").replace("using (lon) group by 1, 2)", "using (lon) group by 1, 2, 3)").replace("select tlat as lat, tlon as lon", "select level, tlat as lat, tlon as lon"))
def wf_subset_regrid(spark, sf):
    steps = {"s": _SUB, "a": {"run": "average", "in": {"collection": "s/output", "dims": "time,realization"}}, "r": {"run": "regrid", "in": {"collection": "a/output", "grid": "custom", "custom_grid": "0 84 12 -42 42 12", "method": "conservative"}}}
    flow = _flow(steps, "r")
    return workflow.execute(flow, {"cells": grid_cells(spark, sf).drop("dataset_id")}).select("level", "lat", "lon", r6().alias("value"))

@query("wf_concat_subset", cells_sql("realization in (1, 2, 3) and time >= timestamp '1996-01-01' and time <= timestamp '1996-12-31 23:59:59' and lat between -40 and 40 and lon between 0 and 90"))
def wf_concat_subset(spark, sf):
    a, b, c = _members(spark, sf)
    doc = {"doc": "", "inputs": {"a": "a", "b": "b", "c": "c"}, "outputs": {"output": "s/output"}, "steps": {"c": {"run": "concat", "in": {"collection": ["inputs/a", "inputs/b", "inputs/c"]}}, "s": {"run": "subset", "in": {"collection": "c/output", "time": "1996/1996", "area": "0,-40,90,40", "frame": 360}}}}
    return cells(workflow.execute(doc, {"a": a, "b": b, "c": c}))


@query("wf_concat_subset_all", cells_sql("time >= timestamp '1996-01-01' and time <= timestamp '1996-12-31 23:59:59' and lat between -40 and 40 and lon between 0 and 90"))
def wf_concat_subset_all(spark, sf):
    members = {f"m{k}": m for k, m in zip(ALL, _members(spark, sf, ALL), strict=True)}
    doc = {"doc": "", "inputs": {k: k for k in members}, "outputs": {"output": "s/output"}, "steps": {"c": {"run": "concat", "in": {"collection": [f"inputs/{k}" for k in members]}}, "s": {"run": "subset", "in": {"collection": "c/output", "time": "1996/1996", "area": "0,-40,90,40", "frame": 360}}}}
    return cells(workflow.execute(doc, members))
