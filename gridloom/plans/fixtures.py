"""Views over the given tables in the shape of the engine's core tables, in Spark and in DuckDB SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_GRID = {
    "dataset_id": "concat('c3s-cmip6-decadal.DCPP.INST.MODEL', cast(1 + l_orderkey % 3 as string), '.hindcast.s1994-r', cast(1 + l_orderkey % 10 as string), 'i1p1f1.day.tas.gn.v1')",
    "variable": "'tas'",
    "realization": "cast(1 + l_orderkey % 10 as int)",
    "time": "l_shipdate",
    "level": "cast(100 * l_linenumber as double)",
    "lat": "cast(-87.5 + 5 * (l_partkey % 36) as double)",
    "lon": "cast(2.5 + 5 * (l_suppkey % 72) as double)",
}
_VALUE = "avg(case when l_tax = 0 then null else l_quantity end)"


#: What the columns are made of: cells are counted by these numbers, which are a third as wide as the texts made of them.
_OWN = {"_order": "l_orderkey % 30", "l_shipdate": "l_shipdate", "l_linenumber": "l_linenumber", "_part": "l_partkey % 36", "_supp": "l_suppkey % 72"}
_OF_OWN = {"l_orderkey": "_order", "l_partkey": "_part", "l_suppkey": "_supp"}


def grid_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = table(spark, sf_dir, "lineitem").groupBy(*[F.expr(e).alias(c) for c, e in _OWN.items()]).agg(F.expr(_VALUE).alias("value"))
    # Remainders by 3 and 10 of a remainder by 30 are those of the number itself, also below 0.
    return cells.select(*[F.expr(reduce(lambda x, o: x.replace(o, _OF_OWN[o]), _OF_OWN, e)).alias(c) for c, e in _GRID.items()], "value")


GRID = "with grid_cells as (select " + ", ".join(f"{e} as {c}" for c, e in _GRID.items()) + f", {_VALUE} as value from lineitem group by 1, 2, 3, 4, 5, 6, 7)\n"

_REQUESTS = """select concat('req-', cast(event_id as string)) as uuid, case when event_type = 'view' then 'describeprocess' else 'execute' end as operation,
case cast(event_id % 3 as int) when 0 then 'orchestrate' when 1 then 'subset' else 'average' end as identifier, ts as time_start,
ts + cast(floor(value * 40) as int) * interval '1' second as time_end,
case event_type when 'error' then 5 when 'signup' then 3 else 4 end as status,
case when event_type = 'error' then concat('Process error: code ', cast(event_id % 7 as string)) end as message from {events}"""
_LOG = """select case when event_id % 50 = 0 then 'truncated line' else concat('10.0.', cast(user_id % 200 as string), '.', cast(1 + event_id % 250 as string), ' - - [', {stamp}, ' +0200] "GET /outputs/app/', cast(event_id as string),
case when event_type = 'click' then '/input.meta4' else '/tas_day.nc' end, ' HTTP/1.1" 200 ', case when event_id % 17 = 0 then '-' else cast(cast(floor(value * 1000000) as bigint) as string) end, ' "-" "python-requests/2.25.1" "-"') end as line from {events}"""
_DAYS = "o_orderdate + cast(o_orderkey % 700 as int) * interval '1' day"


def _catalog(day, iso, orders: str) -> str:
    return f"""select concat('p', cast(o_custkey % 3 as string)) as project, concat('p', cast(o_custkey % 3 as string), '.ds', cast(o_custkey % 40 as string)) as ds_id,
concat('ds', cast(o_custkey % 40 as string), '/tas_day_', cast(o_orderkey as string), '_', {day("o_orderdate")}, '-', {day(_DAYS)}, '.nc') as path,
case o_orderpriority when '5-LOW' then 'undefined' when '3-MEDIUM' then null else {iso("o_orderdate")} end as start_time,
case o_orderpriority when '5-LOW' then 'undefined' when '3-MEDIUM' then null else {iso(_DAYS)} end as end_time,
cast(floor(o_totalprice) as bigint) as size from {orders}"""


def _files(iso, orders: str) -> str:
    return f"""select concat('ds', cast(o_custkey % 40 as string)) as ds_id, concat('ds', cast(o_custkey % 40 as string), '_', cast(year(o_orderdate) as string), '.nc') as path,
{iso("min(o_orderdate)")} as fstart, {iso("max(o_orderdate)")} as fend from {orders} group by o_custkey % 40, year(o_orderdate)"""


def _spark_iso(x: str) -> str:
    return f"concat(date_format({x}, 'yyyy-MM-dd'), 'T', date_format({x}, 'HH:mm:ss'))"


def _duck_iso(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%dT%H:%M:%S')"


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_REQUESTS.format(events="{events}"), events=table(spark, sf_dir, "events"))


def access_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_LOG.format(events="{events}", stamp="date_format(ts, 'dd/MMM/yyyy:HH:mm:ss')"), events=table(spark, sf_dir, "events"))


def catalog_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_catalog(lambda x: f"date_format({x}, 'yyyyMMdd')", _spark_iso, "{orders}"), orders=table(spark, sf_dir, "orders"))


def dataset_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_files(_spark_iso, "{orders}"), orders=table(spark, sf_dir, "orders"))


REQ = "with requests as (" + _REQUESTS.format(events="events") + ")\n"
#: Parsed lines, by positions of the whole lines' tokens.
LOG = "with access_log as (" + _LOG.format(events="events", stamp="strftime(ts, '%d/%b/%Y:%H:%M:%S')") + r"""),
tok as (select regexp_split_to_array(trim(line), '\s+') as t from access_log where len(regexp_split_to_array(trim(line), '\s+')) >= 12),
parsed as (select t[1] as remote_host_ip,
  cast(split_part(t[1], '.', 1) as bigint) * 16777216 + cast(split_part(t[1], '.', 2) as bigint) * 65536 + cast(split_part(t[1], '.', 3) as bigint) * 256 + cast(split_part(t[1], '.', 4) as bigint) as ip_number,
  strptime(t[4][2:], '%d/%b/%Y:%H:%M:%S') as datetime, rtrim(t[5], ']') as timezone, trim(t[6], '"') as request_type, t[7] as request, trim(t[8], '"') as protocol,
  cast(t[9] as int) as status_code, case when t[10] = '-' then 0 else cast(t[10] as bigint) end as size, trim(t[11], '"') as referer, trim(t[12], '"') as user_agent from tok),
downloads as (select * from parsed where regexp_matches(request, '^/outputs/.*/.*\.nc$'))
"""
CAT = "with catalog_files as (" + _catalog(lambda x: f"strftime({x}, '%Y%m%d')", _duck_iso, "orders") + """),
catalog as (select project, ds_id, path, coalesce(nullif(start_time, 'undefined'), '0001-01-01T00:00:00') as start_time, coalesce(nullif(end_time, 'undefined'), '9999-12-30T00:00:00') as end_time, size from catalog_files)
"""
FILES = "with dataset_files as (" + _files(_duck_iso, "orders") + ")\n"

#: A ring over Europe and northern Africa, and a box across the meridian (lon, lat).
SHAPES = {
    "europe": [(-8.0, 36.0), (2.0, 52.0), (18.0, 58.0), (31.0, 45.0), (27.0, 31.0), (9.0, 29.0), (-8.0, 36.0)],
    "meridian": [(-22.0, -11.0), (21.0, -11.0), (21.0, 13.0), (-22.0, 13.0), (-22.0, -11.0)],
}
MODELS = [(f"MODEL{k}", f"forcing text {k}", f"physics text {k}", f"initialization text {k}") for k in (1, 2)]
