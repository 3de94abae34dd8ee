"""Queries on request records and access logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.operators import usage
from gridloom.plans.fixtures import LOG, REQ, access_log, requests, table
from gridloom.plans.registry import dts, query, r6, ts
from gridloom.sources import accesslog

REQ_COLS = "uuid, operation, identifier, time_start, time_end, status, message"


def _downloads(spark, sf):
    return accesslog.downloads(access_log(spark, sf))


def _req_rows(df):
    return df.select("uuid", "operation", "identifier", ts("time_start"), ts("time_end"), "status", "message")


_REQ_SQL = f"select uuid, operation, identifier, {dts('time_start')}, {dts('time_end')}, status, message from requests"


@query("usage_requests", REQ + _REQ_SQL + " where operation = 'execute' and requests.time_start >= (select min(ts) + interval 5 day from events) and requests.time_end <= (select min(ts) + interval 20 day from events)")
def usage_requests(spark, sf):
    first = table(spark, sf, "events").agg(F.min("ts")).first()[0]  # one value: the log's first time
    end = lambda d: (first + __import__("datetime").timedelta(days=d)).isoformat(" ")
    return _req_rows(usage.collect(requests(spark, sf), end(5), end(20)))


@query("usage_finished", REQ + _REQ_SQL + " where status in (4, 5) and operation = 'execute' and identifier = 'subset'")
def usage_finished(spark, sf):
    return _req_rows(usage.finished(requests(spark, sf), "subset"))


_LOG_ROWS = f"select remote_host_ip, ip_number, {dts('datetime')}, timezone, request_type, request, protocol, status_code, size, referer, user_agent from "


@query("downloads_parse", LOG + _LOG_ROWS + "parsed")
def downloads_parse(spark, sf):
    return accesslog.parse(access_log(spark, sf)).select("remote_host_ip", "ip_number", ts("datetime"), "timezone", "request_type", "request", "protocol", "status_code", "size", "referer", "user_agent")


@query("downloads_filter", LOG + _LOG_ROWS + "downloads where day(datetime) >= 1 and datetime <= (select min(ts) + interval 10 day from events)")
def downloads_filter(spark, sf):
    first = table(spark, sf, "events").agg(F.min("ts")).first()[0]
    until = (first + __import__("datetime").timedelta(days=10)).isoformat(" ")
    return accesslog.downloads(access_log(spark, sf), end=until).select("remote_host_ip", "ip_number", ts("datetime"), "timezone", "request_type", "request", "protocol", "status_code", "size", "referer", "user_agent")


@query("ip_number", LOG + "select ip_number, count(*) as n from parsed group by 1")
def ip_number(spark, sf):
    return accesslog.parse(access_log(spark, sf)).groupBy("ip_number").agg(F.count("*").alias("n"))


@query("usage_combine", REQ + "select case when cast(substr(uuid, 5) as bigint) % 2 = 0 then 'north' else 'south' end as site, case when cast(substr(uuid, 5) as bigint) % 2 = 0 then 'https://north.example.org' else 'https://south.example.org' end as url, status, count(*) as n from requests group by 1, 2, 3")
def usage_combine(spark, sf):
    r = requests(spark, sf)
    even = F.substring("uuid", 5, 20).cast("long") % 2 == 0
    both = accesslog.combine({"north": (r.filter(even), "https://north.example.org"), "south": (r.filter(~even), "https://south.example.org")})
    return both.groupBy("site", "url", "status").agg(F.count("*").alias("n"))


def _zero(source: str, column: str, counts: dict[str, str]) -> str:
    got = ", ".join(f"{e} as {n}" for n, e in counts.items())
    out = ", ".join(f"coalesce({n}, 0) as {n}" for n in counts)
    return f", g as (select cast({column} as date) as day, {got} from {source} group by 1), d as (select cast(unnest(generate_series(min(day), max(day), interval 1 day)) as date) as day from g), z as (select day, {out} from d left join g using (day))\n"


@query("req_per_day", REQ + _zero("requests", "time_start", {"success": "count(*) filter (status <> 5)", "failed": "count(*) filter (status = 5)"}) + "select * from z")
def req_per_day(spark, sf):
    return usage.requests_per_day(requests(spark, sf)).orderBy(F.desc("day"))


@query("req_per_day_total", REQ + _zero("requests", "time_start", {"n": "count(*)"}) + "select * from z")
def req_per_day_total(spark, sf):
    return usage.daily(requests(spark, sf), "time_start", n=F.count("*")).orderBy(F.desc("day"))


@query("req_weekday", REQ + "select cast(isodow(time_start) - 1 as int) as weekday, count(*) as n from requests group by 1")
def req_weekday(spark, sf):
    return usage.requests_per_weekday(requests(spark, sf))


@query("req_hour", REQ + "select cast(h as int) as hour, count(uuid) as n from range(0, 24) t(h) left join requests on hour(time_start) = h group by 1")
def req_hour(spark, sf):
    return usage.requests_per_hour(requests(spark, sf))


@query("req_pulse", REQ + "select cast(isodow(time_start) - 1 as int) as weekday, cast(hour(time_start) as int) as hour, count(*) as n from requests group by 1, 2")
def req_pulse(spark, sf):
    return usage.pulse(requests(spark, sf))


_DUR = "((date_diff('second', time_start, time_end) % 86400) + 86400) % 86400"


@query("duration_hist", REQ + f""", d as (select cast(least(60, {_DUR}) as double) as d from requests where time_end is not null),
e as (select case when min(d) = max(d) then min(d) - 0.5 else min(d) end as low, case when min(d) = max(d) then max(d) + 0.5 else max(d) end as high, count(*) as total from d),
k as (select cast(least(59, floor((d - low) / ((high - low) / 60))) as int) as bin, count(*) as c from d, e group by 1)
select cast(b as int) as bin, round(low + b * ((high - low) / 60), 6) as bin_start, round(coalesce(c, 0) / (total * ((high - low) / 60)), 6) as density from range(0, 60) r(b) cross join e left join k on k.bin = b""")
def duration_hist(spark, sf):
    return usage.duration_histogram(requests(spark, sf)).select("bin", r6("bin_start").alias("bin_start"), r6("density").alias("density"))


@query("dl_per_day", LOG + _zero("downloads", "datetime", {"n": "count(*)"}) + "select * from z")
def dl_per_day(spark, sf):
    return usage.downloads_per_day(_downloads(spark, sf)).orderBy(F.desc("day"))


@query("transfer_per_day", LOG + _zero("downloads", "datetime", {"b": "sum(size)"}) + "select day, round(b / 1073741824.0, 6) as gib from z")
def transfer_per_day(spark, sf):
    return usage.transfer_per_day(_downloads(spark, sf)).select("day", r6("gib").alias("gib")).orderBy(F.desc("day"))


@query("error_table", REQ + "select message, cast(min(time_start) as date) as first, cast(max(time_start) as date) as last, count(*) as n from requests where status = 5 and message is not null group by 1")
def error_table(spark, sf):
    return usage.error_table(requests(spark, sf)).orderBy(F.desc("last"))


_EVENTS = """, ev as (select time_start as time, 1 as w, uuid from requests where time_start is not null union all select time_end, -1, uuid from requests where time_end is not null),
run as (select time, cast(time as date) as day, w, cast(sum(w) over (order by time, w desc, uuid rows unbounded preceding) as bigint) as running from ev),
pos as (select * from run where running > 0)
"""
_PEAK = ", pk as (select day, max(running) as peak from pos group by 1), dd as (select cast(unnest(generate_series(min(day), max(day), interval 1 day)) as date) as day from pk), pd as (select day, peak from dd left join pk using (day))\n"


@query("concurrency", REQ + _EVENTS + f"select {dts('time')}, w, running from pos")
def concurrency(spark, sf):
    return usage.concurrency(requests(spark, sf)).select(ts("time"), "w", "running")


@query("concurrency_day", REQ + _EVENTS + _PEAK + "select day, peak from pd")
def concurrency_day(spark, sf):
    return usage.concurrency_per_day(requests(spark, sf))


def _three(name: str, source: str, column: str) -> str:
    return " union all ".join(f"select '{s}_{name}' as property, cast({s}({column}) as double) as value from {source}" for s in ("min", "max", "median"))


_OVER = (
    REQ.rstrip()
    + ", "
    + LOG[len("with ") :]
    + _zero("requests", "time_start", {"n": "count(*)"}).replace("g as", "g1 as").replace("d as", "d1 as").replace("z as", "z1 as").replace("from g)", "from g1)").replace("from d left join g ", "from d1 left join g1 ")
    + _zero("downloads", "datetime", {"n": "count(*)", "b": "sum(size)"}).replace("g as", "g2 as").replace("d as", "d2 as").replace("z as", "z2 as").replace("from g)", "from g2)").replace("from d left join g ", "from d2 left join g2 ")
    + _EVENTS
    + _PEAK
    + f", t as (select count(*) as n, count(*) filter (status = 5) as f from requests), v as (select sum(size) / 1073741824.0 as g from downloads), du as (select {_DUR} as s from requests where {_DUR} > 0), zz as (select b / 1073741824.0 as gib from z2)\n"
    + "select property, round(value, 6) as value from (select 'total' as property, cast(n as double) as value from t union all select 'failed', cast(f as double) from t union all select 'total_gib', g from v union all select 'gib_per_request', g / nullif(n - f, 0) from t, v union all "
    + " union all ".join([_three("requests_per_day", "z1", "n"), _three("duration", "du", "s"), _three("concurrency", "pd", "peak"), _three("downloads_per_day", "z2", "n"), _three("gib_per_day", "zz", "gib")])
    + ")"
)


@query("overview", _OVER)
def overview(spark, sf):
    return usage.overview(requests(spark, sf), _downloads(spark, sf)).select("property", r6().alias("value"))
