"""Queries on catalogs, files, manifests and lineage."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gridloom.functions.names import averaged
from gridloom.functions.scratch import cut, join_dealt, shared_folder
from gridloom.operators import chunks
from gridloom.plans.fixtures import CAT, FILES, GRID, catalog_files, dataset_files, grid_cells, table
from gridloom.plans.registry import query
from gridloom.sources import catalog, manifest, publish
from gridloom.sources.archive import Archive, pushed_down

#: Shapes of paths that a catalog may hold, by the file's size (test data for format and transport).
_PATH = "case cast(size % 7 as int) when 0 then concat('s3://bucket/', path) when 1 then concat('https://host.org/', path, '.zarr/?v=1') when 2 then concat('reference://', path) when 3 then concat('/data/', path, '.json') when 4 then concat('file:///data/', path) when 5 then concat('ftp://host.org/', path) else concat('/data/', path) end"
_FORMAT = "case when regexp_matches(lower(regexp_replace({p}, '[?#].*$', '')), '\\.zarr/*$') then 'zarr' when starts_with(lower({p}), 'reference://') or regexp_matches(lower(regexp_replace({p}, '[?#].*$', '')), '\\.(json|zst|zstd|parquet)$') then 'kerchunk' else 'netcdf' end"
_TRANSPORT = "case when not contains({p}, '://') or starts_with({p}, 'file://') then 'filesystem' when starts_with({p}, 'http') then 'http' when starts_with({p}, 's3://') then 's3' when starts_with({p}, 'reference://') then 'reference' else 'other' end"
_PATHS = CAT.rstrip() + f", paths as (select project, ds_id, {_PATH} as path from catalog_files)\n"


def _shaped(spark, sf):
    return catalog_files(spark, sf).withColumn("path", F.expr(_PATH))


@query("source_format", _PATHS + f"select path, {_FORMAT.format(p='path')} as format from paths")
def source_format(spark, sf):
    return _shaped(spark, sf).select("path", catalog.format_of(F.col("path")).alias("format"))


@query("source_transport", _PATHS + f"select ds_id, count(distinct {_TRANSPORT.format(p='path')}) as transports, count(distinct {_TRANSPORT.format(p='path')}) > 1 as mixed from paths group by 1")
def source_transport(spark, sf):
    n = F.count_distinct(catalog.transport_of(F.col("path")))
    return _shaped(spark, sf).groupBy("ds_id").agg(n.alias("transports"), (n > 1).alias("mixed"))


@query("source_normalise", CAT + f"""select coalesce(case when size % 3 = 0 then null else ds_id end, path) as source, string_agg(path, ',' order by path) as paths from catalog_files group by 1""")
def source_normalise(spark, sf):
    files = catalog_files(spark, sf).withColumn("ds_id", F.when(F.col("size") % 3 != 0, F.col("ds_id")))
    return catalog.sources(files).select("source", F.array_join("paths", ",").alias("paths"))


#: Sources of two projects that differ in what they hold: the shapes of paths follow the file's size.
_SOURCES = _PATHS.rstrip() + f", shaped as (select concat(ds_id, '-', project, '-', cast(length(path) % 4 as varchar)) as ds_id, path from paths), told as (select ds_id, count(*) as n, count(distinct {_TRANSPORT.format(p='path')}) as transports, bool_or({_FORMAT.format(p='path')} <> 'netcdf') as store from shaped group by 1)\n"


@query("source_faults", _SOURCES + "select ds_id as source, n as paths, case when transports > 1 then 'mixed transports' when store and n > 1 then 'several stores' end as fault from told")
def source_faults(spark, sf):
    files = _shaped(spark, sf).withColumn("ds_id", F.concat_ws("-", "ds_id", "project", (F.length("path") % 4).cast("string")))
    return catalog.sources(files).select("source", F.size("paths").cast("long").alias("paths"), "fault")


@query("catalog_normalise", CAT + "select project, ds_id, path, start_time, end_time, size from catalog")
def catalog_normalise(spark, sf):
    return catalog.normalise(catalog_files(spark, sf)).select("project", "ds_id", "path", "start_time", "end_time", "size")


_IDS = ["p0.ds0", "p1.ds7", "p2.ds11", "p1.ds25"]


@query("catalog_search", CAT + f"select ds_id, string_agg(path, ',' order by path) as paths from catalog where ds_id in ({', '.join(repr(i) for i in _IDS)}) and end_time >= '1997-01-01T00:00:00' and start_time <= '1998-06-30T23:59:59' group by 1")
def catalog_search(spark, sf):
    found = catalog.search(catalog.normalise(catalog_files(spark, sf)), _IDS, "1997-01-01T00:00:00", "1998-06-30T23:59:59")
    return found.select("ds_id", F.array_join("paths", ",").alias("paths"))


_ASK = ", ask as (select distinct concat(ds_id, case when size % 50 = 0 then 'x' else '' end) as ds_id, case when size % 5 = 0 then '1890-01-01T00:00:00' else '1996-01-01T00:00:00' end as s, case when size % 5 = 0 then '1890-06-01T00:00:00' else '1996-03-01T00:00:00' end as e from catalog where size % 10 < 6)\n"


#: Requests made of every file; the queries named ..._all answer these.
_ASK_ALL = _ASK.replace(" where size % 10 < 6", "")


def _ask(spark, sf, which="size % 10 < 6"):
    c = catalog.normalise(catalog_files(spark, sf)).filter("start_time > '1900'")
    ask = catalog_files(spark, sf).filter(which).select(F.concat("ds_id", F.when(F.col("size") % 50 == 0, "x").otherwise("")).alias("ds_id"), F.when(F.col("size") % 5 == 0, "1890-01-01T00:00:00").otherwise("1996-01-01T00:00:00").alias("start"), F.when(F.col("size") % 5 == 0, "1890-06-01T00:00:00").otherwise("1996-03-01T00:00:00").alias("end"))
    return c, ask


_DATED = ", dated as (select * from catalog where start_time > '1900')\n"


@query("catalog_join", CAT.rstrip() + _ASK.rstrip() + _DATED + 'select a.ds_id, s as start, e as "end", path from ask a join dated d on a.ds_id = d.ds_id and end_time >= s and start_time <= e')
def catalog_join(spark, sf):
    return catalog.search_many(*_ask(spark, sf))


@query("catalog_join_all", CAT.rstrip() + _ASK_ALL.rstrip() + _DATED + 'select a.ds_id, s as start, e as "end", path from ask a join dated d on a.ds_id = d.ds_id and end_time >= s and start_time <= e')
def catalog_join_all(spark, sf):
    return catalog.search_many(*_ask(spark, sf, "true"))


@query("catalog_status", CAT.rstrip() + _ASK.rstrip() + _DATED + """select ds_id, s as start, e as "end", case when exists (select 1 from dated d where d.ds_id = a.ds_id and end_time >= s and start_time <= e) then 'ok' when exists (select 1 from dated d where d.ds_id = a.ds_id) then 'empty_range' else 'unknown' end as status from ask a""")
def catalog_status(spark, sf):
    return catalog.status(*_ask(spark, sf))


@query("catalog_status_all", CAT.rstrip() + _ASK_ALL.rstrip() + _DATED + """select ds_id, s as start, e as "end", case when exists (select 1 from dated d where d.ds_id = a.ds_id and end_time >= s and start_time <= e) then 'ok' when exists (select 1 from dated d where d.ds_id = a.ds_id) then 'empty_range' else 'unknown' end as status from ask a""")
def catalog_status_all(spark, sf):
    return catalog.status(*_ask(spark, sf, "true"))


@query("catalog_missing", CAT.rstrip() + _ASK.rstrip() + _DATED + "select distinct ds_id from ask where ds_id not in (select ds_id from dated)")
def catalog_missing(spark, sf):
    c, ask = _ask(spark, sf)
    return ask.select("ds_id").distinct().join(c, "ds_id", "left_anti")


@query("catalog_missing_all", CAT.rstrip() + _ASK_ALL.rstrip() + _DATED + "select distinct ds_id from ask where ds_id not in (select ds_id from dated)")
def catalog_missing_all(spark, sf):
    c, ask = _ask(spark, sf, "true")
    return ask.select("ds_id").distinct().join(c, "ds_id", "left_anti")


@query("catalog_paths", CAT + "select ds_id, path, concat(case when project = 'p0' then 's3://own' when project = 'p1' then 's3://all' else '/base' end, '/', path) as file, concat('https://node.org/', path) as url from catalog")
def catalog_paths(spark, sf):
    files = catalog.normalise(catalog_files(spark, sf)).withColumn("data_node_root", F.lit("https://node.org/")).withColumn("base_dir", F.lit("/base/"))
    files = files.withColumn("s3_root", F.when(F.col("project") == "p0", "s3://own/").when(F.col("project") == "p1", "s3://all"))
    return catalog.resolve(files).select("ds_id", "path", "file", "url")


_YEARS = ", y as (select project, ds_id, path, start_time, end_time, cast(regexp_extract(path, '_(\\d{4})\\d{4}-\\d{8}\\.nc$', 1) as int) as y0, cast(regexp_extract(path, '-(\\d{4})\\d{4}\\.nc$', 1) as int) as y1 from catalog)\n"


@query("file_years", CAT.rstrip() + _YEARS + "select path, array_to_string(range(y0, y1 + 1), ',') as years from y")
def file_years(spark, sf):
    return catalog_files(spark, sf).select("path", F.array_join(catalog.name_years(F.col("path")).cast("array<string>"), ",").alias("years"))


@query("files_in_range", CAT.rstrip() + _YEARS + "select ds_id, path from y where y0 <= 1998 and y1 >= 1997")
def files_in_range(spark, sf):
    return catalog.files_in_range(catalog_files(spark, sf), 1997, 1998).select("ds_id", "path")


@query("files_in_series", CAT.rstrip() + _YEARS + "select ds_id, path from y where (y0 <= 1996 and y1 >= 1996) or (y0 <= 2000 and y1 >= 2000)")
def files_in_series(spark, sf):
    return catalog.files_in_series(catalog_files(spark, sf), [1996, 2000]).select("ds_id", "path")


@query("consolidate", CAT.rstrip() + f", p as (select project, ds_id, {_PATH} as path, start_time, end_time from catalog), r as (select *, case when {_FORMAT.format(p='path')} <> 'netcdf' or starts_with(path, 's3://') then 'direct' when project in ('p0', 'p1') then 'catalog' else 'lookup' end as route, try_cast(regexp_extract(path, '_(\\d{{4}})\\d{{4}}-\\d{{8}}\\.nc$', 1) as int) as y0, try_cast(regexp_extract(path, '-(\\d{{4}})\\d{{4}}\\.nc$', 1) as int) as y1 from p)\nselect project, ds_id, path, route from r where route = 'direct' or (route = 'catalog' and end_time >= '1997-02-01T00:00:00' and start_time <= '1998-01-31T00:00:00') or (route = 'lookup' and y0 <= 1998 and y1 >= 1997)")
def consolidate(spark, sf):
    return catalog.consolidate(_shaped(spark, sf), ["p0", "p1"], "1997-02-01T00:00:00", "1998-01-31T00:00:00")


@query("paths_homogeneous", _PATHS + "select ds_id, bool_and(starts_with(path, 'http')) or bool_and(starts_with(path, '/')) as homogeneous from (select concat(ds_id, '-', project, '-', cast(length(path) % 3 as varchar)) as ds_id, path from paths where starts_with(path, '/') or starts_with(path, 'http')) group by 1")
def paths_homogeneous(spark, sf):
    files = _shaped(spark, sf).filter(F.col("path").rlike("^(/|http)")).withColumn("ds_id", F.concat_ws("-", "ds_id", "project", (F.length("path") % 3).cast("string")))
    return catalog.homogeneous(files)


def _aligned_sql(low: str, high: str) -> str:
    return f""", o as (select *, greatest('{low}', min(fstart) over (partition by ds_id)) as s, least('{high}', max(fend) over (partition by ds_id)) as e from dataset_files where fend >= '{low}' and fstart <= '{high}'),
a as (select ds_id, bool_or(fstart = s) and bool_or(fend = e) as ok, string_agg(path, ',' order by fstart, path) as f from o group by 1), al as (select ds_id, coalesce(ok, false) as aligned, case when ok then f else '' end as files from (select distinct ds_id from dataset_files) left join a using (ds_id))
"""


def _aligned(spark, sf, **p):
    return catalog.aligned(dataset_files(spark, sf), **p).select("ds_id", "aligned", F.array_join("files", ",").alias("files"))


query("aligned_files", FILES.rstrip() + _aligned_sql("1996-01-01T00:00:00", "1999-12-31T00:00:00") + "select * from al")(lambda spark, sf: _aligned(spark, sf, start="1996-01-01T00:00:00", end="1999-12-31T00:00:00"))
query("aligned_files_years", FILES.rstrip() + _aligned_sql("1997-01-01T00:00:00", "1999-06-30T00:00:00") + "select * from al")(lambda spark, sf: _aligned(spark, sf, end="1999-06-30T00:00:00", years=[1997, 1998, 1999, 2000]))


@query("request_decision", FILES.rstrip() + _aligned_sql("1996-01-01T00:00:00", "1999-12-31T00:00:00") + ", q as (select *, cast(substr(ds_id, 3) as int) % 8 as request from al) select request, count(*) as datasets, case when request = 5 then 'run_operation' when request = 3 or bool_and(aligned) then 'original_files' else 'run_operation' end as decision from q group by 1")
def request_decision(spark, sf):
    got = catalog.aligned(dataset_files(spark, sf), "1996-01-01T00:00:00", "1999-12-31T00:00:00")
    request = (F.substring("ds_id", 3, 9).cast("int") % 8).alias("request")
    return catalog.decide(got, request, request == 3, request == 5)


@query("catalog_by_project", CAT + "select project, count(*) as n, cast(sum(size) as bigint) as bytes from catalog group by 1")
def catalog_by_project(spark, sf):
    import uuid

    name, files = f"catalog_{uuid.uuid4().hex}", catalog_files(spark, sf)
    catalog.bootstrap(files, name)
    # The second use finds the table that the first has made.
    counts = cut(catalog.bootstrap(files, name).groupBy("project").agg(F.count("*").alias("n"), F.sum("size").alias("bytes")), "by-project")
    spark.sql(f"DROP TABLE {name}")
    return counts


@query("chunk_files", FILES + """, ch as (select distinct ds_id, chunk, concat(y, '-01-01T00:00:00') as s, concat(y + 1, '-12-31T23:59:59') as e from dataset_files, (values (0, 1995), (1, 1997), (2, 1999), (3, 2001), (4, 2003)) v(chunk, y))
select ch.ds_id, chunk, path from ch left join dataset_files f on f.ds_id = ch.ds_id and fend >= s and fstart <= e""")
def chunk_files(spark, sf):
    files = dataset_files(spark, sf)
    years = F.array(*[F.struct(F.lit(k).alias("chunk"), F.lit(1995 + 2 * k).alias("y")) for k in range(5)])
    ch = files.select("ds_id").distinct().select("ds_id", F.explode(years).alias("c")).select("ds_id", "c.chunk", F.concat(F.col("c.y"), F.lit("-01-01T00:00:00")).alias("start"), F.concat(F.col("c.y") + 1, F.lit("-12-31T23:59:59")).alias("end"))
    return chunks.files_of(ch, files)


@query("compact_plan", CAT.rstrip().replace("with ", "with recursive ", 1) + """, f as (select ds_id, path, greatest(1, size) as size, row_number() over (partition by ds_id order by path) as k from catalog_files),
w(ds_id, path, size, k, g, t) as (select ds_id, path, size, k, 0, size from f where k = 1 union all select f.ds_id, f.path, f.size, f.k, case when t + f.size <= 500000 then g else g + 1 end, case when t + f.size <= 500000 then t + f.size else f.size end from w join f on f.ds_id = w.ds_id and f.k = w.k + 1)
select ds_id, path, size, cast(g as int) as group_no from w""")
def compact_plan(spark, sf):
    return manifest.compaction(catalog_files(spark, sf), 500_000)


def _folder(spark) -> str:
    import uuid

    return f"{shared_folder(spark)}/gridloom/{uuid.uuid4().hex}"


@query("write_by_year", GRID + "select cast(year(time) as int) as year, count(*) as n, round(sum(value), 6) as total from grid_cells group by 1")
def write_by_year(spark, sf):
    out = _folder(spark)
    manifest.write_by_year(grid_cells(spark, sf), out)
    return spark.read.parquet(out).groupBy("year").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))


@query("compact_write", "select cast(year(o_orderdate) as int) as year, count(*) as n, round(sum(o_totalprice), 2) as total from orders group by 1")
def compact_write(spark, sf):
    out, year = _folder(spark), F.year("o_orderdate").alias("year")
    orders = table(spark, sf, "orders").withColumn("year", year)
    orders.repartition(4, "o_orderkey").write.partitionBy("year").parquet(f"{out}/parts")
    # The written files are listed, grouped by size within each year, and each group is merged in order of time.
    files = manifest.files_of(spark.read.parquet(f"{out}/parts"), "year")
    plan = manifest.compaction(files, 64_000, key="year")
    merged = manifest.compact(spark, f"{out}/parts", plan, f"{out}/merged", "year", "o_orderdate", 256_000)
    return merged.groupBy("year").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("write_by_month", GRID + "select cast(year(time) as int) as year, cast(month(time) as int) as month, count(*) as n, round(sum(value), 6) as total from grid_cells group by 1, 2")
def write_by_month(spark, sf):
    out = _folder(spark)
    manifest.write_by_period(grid_cells(spark, sf), out, "month", 512_000)
    return spark.read.parquet(out).groupBy("year", "month").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))


@query("written_names", GRID.rstrip() + ", named as (select concat('tas_day_MODEL', regexp_extract(dataset_id, 'MODEL(\\d+)', 1), '_hindcast_s1994-r', regexp_extract(dataset_id, '-r(\\d+)i', 1), 'i1p1f1_gn_', strftime(min(time) over w, '%Y%m%d'), '-', strftime(max(time) over w, '%Y%m%d'), '_avg-x.nc') as output, value from grid_cells window w as (partition by dataset_id, year(time))) select output, count(*) as n, round(sum(value), 6) as total from named group by 1")
def written_names(spark, sf):
    """Outputs named by facets, period and what was done, as they are found on disk."""
    out = _folder(spark)
    manifest.write_named(grid_cells(spark, sf), out, averaged(["lon"]), "year", 512_000)
    return spark.read.parquet(out).groupBy("output").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))


@query("archive_years", "select cast(year(l_shipdate) as bigint) as year, count(*) as n, round(sum(l_quantity), 2) as total from lineitem where year(l_shipdate) between 1995 and 1996 group by 1")
def archive_years(spark, sf):
    """Two years of an archive whose files tell their years: Spark plans the files of these alone."""
    out = _folder(spark)
    rows = table(spark, sf, "lineitem").select(F.lit("tas.day").alias("dataset_id"), F.col("l_shipdate").alias("time"), F.year("l_shipdate").cast("long").alias("year"), F.col("l_quantity").cast("double").alias("value"))
    manifest.write_named(rows, out, most_bytes=1 << 20)
    spark.dataSource.register(Archive)
    with pushed_down(spark):
        found = spark.read.format("archive").load(out).filter("year >= 1995 and year < 1997")
        return cut(found.groupBy("year").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total")), "archive-years")


@query("published", "select cast(year(o_orderdate) as int) as year, count(*) as n, round(sum(o_totalprice), 2) as total, cast(2 as bigint) as version from orders group by 1")
def published(spark, sf):
    """A table's second version; the first holds one year less, and the second is published twice."""
    out, orders = _folder(spark), table(spark, sf, "orders").withColumn("year", F.year("o_orderdate"))
    publish.publish(orders.filter("year > 1992"), out, "first", base=0, partition_by=["year"])
    publish.publish(orders, out, "second", base=1, partition_by=["year"])
    version = publish.publish(orders, out, "second", partition_by=["year"])
    return publish.read(spark, out).groupBy("year").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total")).withColumn("version", F.lit(version).cast("long"))


@query("written_manifest", "select concat('y', cast(year(o_orderdate) as varchar)) as dataset_id, count(*) as n, true as sized from orders group by 1")
def written_manifest(spark, sf):
    """The manifest of files that were written: what each dataset's files hold, and that all have a size."""
    out = _folder(spark)
    table(spark, sf, "orders").select("o_orderkey", F.concat(F.lit("y"), F.year("o_orderdate")).alias("dataset_id")).write.partitionBy("dataset_id").parquet(out)
    files = manifest.files_of(spark.read.parquet(out), "dataset_id")
    listed = manifest.manifest(files)
    return listed.join(files.select("path", "rows"), "path").groupBy("dataset_id").agg(F.sum("rows").alias("n"), F.bool_and(F.col("size") > 0).alias("sized"))


@query("result_manifest", CAT + "select ds_id as dataset_id, path, case when size % 4 = 0 then 0 else size end as size from (select ds_id, case when size % 4 = 0 then concat('https://node.org/', path) when size % 4 = 1 then concat('http://node.org/', path) else path end as path, size from catalog) where size % 4 <> 1")
def result_manifest(spark, sf):
    k = F.col("size") % 4
    path = F.when(k == 0, F.concat(F.lit("https://node.org/"), "path")).when(k == 1, F.concat(F.lit("http://node.org/"), "path")).otherwise(F.col("path"))
    return manifest.manifest(catalog_files(spark, sf).select(F.col("ds_id").alias("dataset_id"), path.alias("path"), "size"))


#: Most files of one manifest.
BATCH = 1000


def _manifest_urls(files):
    """The URLs, read from manifests of at most ``BATCH`` files of a dataset."""
    entry = F.concat(F.lit("<file><metaurl mediatype='x'>file:///data/"), "path", F.lit("</metaurl></file>"))
    batch = F.floor(F.monotonically_increasing_id() / BATCH)
    xml = files.select("ds_id", batch.alias("batch"), entry.alias("entry")).groupBy("ds_id", "batch").agg(F.concat(F.lit("<metalink xmlns='urn:x'>"), F.concat_ws("", F.collect_list("entry")), F.lit("</metalink>")).alias("xml"))
    return manifest.manifest_urls(xml)


@query("manifest_urls", CAT + "select concat('/data/', path) as url from catalog where ds_id like 'p1.%'")
def manifest_urls(spark, sf):
    return _manifest_urls(catalog_files(spark, sf).filter("project = 'p1'"))


@query("manifest_urls_all", CAT + "select concat('/data/', path) as url from catalog")
def manifest_urls_all(spark, sf):
    return _manifest_urls(catalog_files(spark, sf))


@query("lineage_edges", """with s as (select o_orderkey as run, l_linenumber as step, l_returnflag as operator, concat('in', l_partkey) as i, concat('out', l_suppkey) as o, l_shipdate from lineitem join orders on l_orderkey = o_orderkey)
select run, step, 'used' as edge, operator as subject, i as object from s union all select run, step, 'generated', o, operator from s union all select run, step, 'parameters', operator, concat('dims=lat,lon;freq=', operator) from s""")
def lineage_edges(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_partkey", "l_suppkey")
    li = join_dealt(lines, table(spark, sf, "orders").select("o_orderkey"), "l_orderkey", "o_orderkey")
    params = F.create_map(F.lit("freq"), F.array("l_returnflag"), F.lit("dims"), F.array(F.lit("lat"), F.lit("lon")))
    steps = li.select(F.col("o_orderkey").alias("run"), F.col("l_linenumber").alias("step"), F.col("l_returnflag").alias("operator"), F.array(F.concat(F.lit("in"), "l_partkey"), F.lit("more")).alias("inputs"), F.array(F.concat(F.lit("out"), "l_suppkey")).alias("outputs"), params.alias("parameters"))
    return manifest.lineage(steps)


#: Orders of a customer are made one from the one before, and from a part; every tenth customer's first one from the last.
_DERIVED = """e as (select o_orderkey, o_custkey, lag(o_orderkey) over w as prev, first_value(o_orderkey) over w as first, last_value(o_orderkey) over (partition by o_custkey order by o_orderkey rows between unbounded preceding and unbounded following) as last from orders window w as (partition by o_custkey order by o_orderkey)),
derived as (select concat('o', o_orderkey) as entity, concat('o', case when prev is not null then prev when o_custkey % 10 = 0 and last <> o_orderkey then last end) as source from e where prev is not null or (o_custkey % 10 = 0 and last <> o_orderkey)
  union select concat('o', l_orderkey), concat('part', l_partkey % 50) from lineitem where l_linenumber = 1)"""


@query("lineage_upstream", f"""with recursive {_DERIVED},
up(entity, ancestor, distance, trail) as (select entity, source, 1, [entity, source] from derived
  union all select up.entity, d.source, distance + 1, list_append(trail, d.source) from up join derived d on d.entity = up.ancestor where not list_contains(trail, d.source))
select entity, ancestor, cast(min(distance) as bigint) as distance from up where entity <> ancestor group by 1, 2""")
def lineage_upstream(spark, sf):
    o = table(spark, sf, "orders")
    by = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    whole = by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    name = lambda c: F.concat(F.lit("o"), c)
    chain = o.select("o_orderkey", "o_custkey", F.lag("o_orderkey").over(by).alias("prev"), F.last("o_orderkey").over(whole).alias("last"))
    back = F.when((F.col("o_custkey") % 10 == 0) & (F.col("last") != F.col("o_orderkey")), F.col("last"))
    steps = chain.select(name("o_orderkey").alias("made"), name(F.coalesce("prev", back)).alias("used")).filter("used is not null")
    steps = steps.unionByName(table(spark, sf, "lineitem").filter("l_linenumber = 1").select(name("l_orderkey").alias("made"), F.concat(F.lit("part"), F.col("l_partkey") % 50).alias("used")))
    return manifest.upstream(manifest.derivations(steps.select(F.array("made").alias("outputs"), F.array("used").alias("inputs"))))


_RUNS = "(select o_orderkey as run, concat('wf', o_custkey % 7) as workflow, concat('user', o_custkey) as agent, o_orderdate as a, o_orderdate + interval 2 hour as b from orders)"


@query("lineage_runs", f"""with r as {_RUNS}
select run, 'associated' as edge, cast(run as varchar) as subject, 'gridloom 1' as object from r union all select run, 'on_behalf_of', 'gridloom 1', agent from r union all select run, 'used', cast(run as varchar), workflow from r
union all select run, 'started', cast(run as varchar), strftime(a, '%Y-%m-%d %H:%M:%S') from r union all select run, 'ended', cast(run as varchar), strftime(b, '%Y-%m-%d %H:%M:%S') from r""")
def lineage_runs(spark, sf):
    runs = table(spark, sf, "orders").select(F.col("o_orderkey").alias("run"), F.concat(F.lit("wf"), F.col("o_custkey") % 7).alias("workflow"), F.concat(F.lit("user"), "o_custkey").alias("agent"), F.col("o_orderdate").alias("start"), (F.col("o_orderdate") + F.expr("interval 2 hours")).alias("end"))
    return manifest.lineage_runs(runs, "gridloom", "1")
