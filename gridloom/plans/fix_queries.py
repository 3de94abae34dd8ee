"""Queries on dataset fixes."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.operators import fixes
from gridloom.plans.fixtures import GRID, MODELS, grid_cells
from gridloom.plans.registry import dts, query, ts

_SETS = ", sets as (select dataset_id, realization, min(time) as time, count(*) as n from grid_cells group by 1, 2)\n"
_ATTR = "case when realization % 3 = 0 then 's199013' when realization % 3 = 1 then 's199205' else null end"
_MODEL_SQL = ", ".join(str(m) for m in MODELS)


def _sets(spark, sf):
    return grid_cells(spark, sf).groupBy("dataset_id", "realization").agg(F.min("time").alias("time"), F.count("*").alias("n"))


def _attrs(spark, sf):
    s = _sets(spark, sf)
    attrs = F.create_map(F.lit("realization_index"), F.col("realization").cast("string"), F.lit("title"), F.when(F.col("n") % 2 == 0, "").otherwise("kept"), F.lit("comment"), F.lit("x"))
    start = F.expr(_ATTR)
    return s.withColumn("attrs", F.when(start.isNotNull(), F.map_concat(attrs, F.create_map(F.lit("startdate"), start))).otherwise(attrs))


def _told(attrs: str = "attrs"):
    return F.array_join(F.array_sort(F.transform(F.map_entries(attrs), lambda e: F.concat_ws("=", e["key"], e["value"]))), ";").alias("attrs")


@query("fix_policy", GRID + _SETS + "select dataset_id, 'c3s.cmip6_decadal' as recipe, dataset_id is not null as fixed from sets")
def fix_policy(spark, sf):
    r = fixes.recipe_of(F.col("dataset_id"))
    return _sets(spark, sf).select("dataset_id", r.alias("recipe"), r.isNotNull().alias("fixed"))


@query("fix_start_date", GRID + _SETS + "select dataset_id, make_date(cast(regexp_extract(dataset_id, '\\.s(\\d+)-', 1) as int), 11, 1) as start_date from sets")
def fix_start_date(spark, sf):
    return _sets(spark, sf).select("dataset_id", fixes.start_date().alias("start_date"))


@query("fix_sub_experiment", GRID + _SETS + "select dataset_id, concat('s', regexp_extract(dataset_id, '\\.s(\\d+)-', 1), '11') as sub_experiment_id from sets")
def fix_sub_experiment(spark, sf):
    return _sets(spark, sf).select("dataset_id", fixes.sub_experiment().alias("sub_experiment_id"))


@query("fix_reftime", GRID + _SETS + "select dataset_id, realization, case when realization % 3 = 1 then '1992-05-01 00:00:00' else concat(regexp_extract(dataset_id, '\\.s(\\d+)-', 1), '-11-01 00:00:00') end as reftime from sets")
def fix_reftime(spark, sf):
    return _attrs(spark, sf).select("dataset_id", "realization", F.date_format(fixes.reference_time(F.element_at("attrs", "startdate")), "yyyy-MM-dd HH:mm:ss").alias("reftime"))


@query("fix_leadtime", GRID + f"select dataset_id, {dts('time')}, cast(floor(date_diff('second', timestamp '1994-11-01', grid_cells.time) / 86400.0) as bigint) as leadtime, count(*) as n from grid_cells group by dataset_id, grid_cells.time, 3")
def fix_leadtime(spark, sf):
    return grid_cells(spark, sf).groupBy("dataset_id", "time").agg(F.count("*").alias("n")).withColumn("leadtime", fixes.lead_days()).select("dataset_id", ts("time"), "leadtime", "n")


@query("fix_realization", GRID + _SETS + "select dataset_id, realization from sets")
def fix_realization(spark, sf):
    return _attrs(spark, sf).select("dataset_id", F.element_at("attrs", "realization_index").cast("int").alias("realization"))


@query("fix_model_attrs", GRID + _SETS + f"select dataset_id, model, f as forcing_description, p as physics_description, i as initialization_description from (select dataset_id, split_part(dataset_id, '.', 4) as model from sets) left join (values {_MODEL_SQL}) m(model, f, p, i) using (model)")
def fix_model_attrs(spark, sf):
    models = spark.createDataFrame(MODELS, "model string, forcing_description string, physics_description string, initialization_description string")
    return fixes.model_descriptions(_sets(spark, sf), models).select("dataset_id", "model", "forcing_description", "physics_description", "initialization_description")


@query("fix_attrs", GRID + _SETS + f"select dataset_id, concat('long_name=valid_time;realization_index=', realization, coalesce(';startdate=' || {_ATTR}, ''), ';title=', case when n % 2 = 0 then 'given' else 'kept' end) as attrs from sets")
def fix_attrs(spark, sf):
    df = _attrs(spark, sf).transform(fixes.set_attr("long_name", F.lit("valid_time"))).transform(fixes.set_missing("title", F.lit("given"))).transform(fixes.remove_attr("comment"))
    return df.select("dataset_id", _told())


@query("dataset_signature", GRID + _SETS + f"select dataset_id, {_ATTR} is not null as has_startdate, {_ATTR} as startdate, concat(rpad('t', 77, 't'), '...') as title, false as has_none from sets")
def dataset_signature(spark, sf):
    df = _attrs(spark, sf).transform(fixes.set_attr("title", F.lit("t" * 100)))
    return df.select("dataset_id", *fixes.signature(F.col("attrs"), ["startdate", "title", "none"])).drop("has_title", "none")


@query("fix_squeeze", GRID + f"select dataset_id, {dts('time')}, lat, lon, round(value, 6) as value from grid_cells where level = 100 and realization = 4")
def fix_squeeze(spark, sf):
    one = grid_cells(spark, sf).filter("level = 100 and realization = 4")
    return fixes.squeeze(one, "level", "realization").select("dataset_id", ts("time"), "lat", "lon", F.round("value", 6).alias("value"))


@query("fix_calendar", GRID + _SETS + """, c as (select dataset_id, time, case cast(realization % 4 as int) when 0 then 'standard' when 1 then '360_day' when 2 then 'noleap' else 'standard' end as calendar from sets)
select dataset_id, calendar, cast(case calendar when '360_day' then year(time) * 360 + (month(time) - 1) * 30 + least(day(time), 30) - 1 when 'noleap' then year(time) * 365 + list_extract([0, 31, 59, 90, 120, 151, 181, 212, 243, 273, 304, 334], month(time)) + day(time) - 1 else date_diff('day', date '1970-01-01', cast(time as date)) end as bigint) as ord_days from c""")
def fix_calendar(spark, sf):
    given = F.when(F.col("realization") % 4 == 0, "proleptic_gregorian").when(F.col("realization") % 4 == 1, "360_day").when(F.col("realization") % 4 == 2, "noleap").otherwise("standard")
    df = fixes.relabel_calendar(_sets(spark, sf).withColumn("calendar", given))
    return df.select("dataset_id", "calendar", fixes.ordinal(F.col("calendar"), F.year("time"), F.month("time"), F.dayofmonth("time")).cast("long").alias("ord_days"))


@query("fix_project_id", GRID + _SETS + "select dataset_id, split_part(dataset_id, '.', 1) as project_id from sets")
def fix_project_id(spark, sf):
    return fixes.atlas(_sets(spark, sf)).select("dataset_id", "project_id")


_ALL = f"case when realization % 3 = 1 then '1992-05-01 00:00:00' else '1994-11-01 00:00:00' end as reftime, cast(floor(date_diff('second', timestamp '1994-11-01', time) / 86400.0) as bigint) as leadtime"


@query("fix_decadal_all", GRID + _SETS + f"select dataset_id, 'standard' as calendar, 's199411' as sub_experiment_id, {_ALL}, realization, concat('comment=x;long_name=valid_time;realization_index=', realization, ';startdate=', coalesce({_ATTR}, 's199411'), ';title=', case when n % 2 = 0 then '' else 'kept' end) as attrs from sets")
def fix_decadal_all(spark, sf):
    df = fixes.forecast(_attrs(spark, sf).withColumn("calendar", F.lit("proleptic_gregorian")))
    return df.select("dataset_id", "calendar", "sub_experiment_id", F.date_format("reftime", "yyyy-MM-dd HH:mm:ss").alias("reftime"), "leadtime", "realization", _told())


@query("fix_recipe", GRID + _SETS + "select case when realization = 1 then 'c3s-cica-atlas.x' when realization = 2 then 'other.x' when realization > 2 then dataset_id end as dataset_id, case when realization = 1 then 'c3s.atlas' when realization > 2 then 'c3s.cmip6_decadal' end as recipe from sets")
def fix_recipe(spark, sf):
    named = F.when(F.col("realization") == 1, "c3s-cica-atlas.x").when(F.col("realization") == 2, "other.x").otherwise(F.col("dataset_id"))
    return _sets(spark, sf).select(named.alias("dataset_id")).withColumn("recipe", fixes.recipe_of(F.col("dataset_id")))


@query("fix_stats", GRID + _SETS + "select dataset_id, count(*) as attempted, count(*) filter (realization % 2 = 0) as changed from sets group by 1")
def fix_stats(spark, sf):
    before = _sets(spark, sf).withColumn("calendar", F.when(F.col("realization") % 2 == 0, "proleptic_gregorian").otherwise("standard"))
    return fixes.statistics(before, fixes.relabel_calendar(before), ["dataset_id", "realization"], ["calendar"])


@query("fix_coordinates", GRID + f"select dataset_id, {dts('time')}, lat, cast(2.0 as double) as height, case when lat >= 0 then 'north' else 'south' end as side, count(*) as n from grid_cells group by dataset_id, grid_cells.time, lat, 5")
def fix_coordinates(spark, sf):
    cells = grid_cells(spark, sf)
    sides = cells.select("lat").distinct().withColumn("side", F.when(F.col("lat") >= 0, "north").otherwise("south"))
    df = cells.transform(fixes.add_scalar("height", 2.0)).transform(fixes.add_along("side", "lat", sides))
    return df.groupBy("dataset_id", "time", "lat", "height", "side").agg(F.count("*").alias("n")).select("dataset_id", ts("time"), "lat", "height", "side", "n")


@query("fix_derived", GRID + _SETS + "select dataset_id, concat('s', regexp_extract(dataset_id, '\\.s(\\d+)-', 1), '11') as experiment, split_part(dataset_id, '.', 1) as project_id, split_part(dataset_id, '.', 4) as model from sets")
def fix_derived(spark, sf):
    df = _sets(spark, sf).transform(fixes.derive("experiment", "sub_experiment")).transform(fixes.derive("project_id", "project")).transform(fixes.derive("model", "model"))
    return df.select("dataset_id", "experiment", "project_id", "model")
