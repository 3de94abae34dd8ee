"""Archive catalogs: which files hold what a request asks for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.params import FIRST_TIME, LAST_TIME


def format_of(path: Column) -> Column:
    """netcdf, zarr or kerchunk, by the path without its query."""
    p = F.lower(F.regexp_replace(path, "[?#].*$", ""))
    kerchunk = p.startswith("reference://") | p.rlike("\\.(json|zst|zstd|parquet)$")
    return F.when(p.rlike("\\.zarr/*$"), "zarr").when(kerchunk, "kerchunk").otherwise("netcdf")


def transport_of(path: Column) -> Column:
    scheme = F.lower(F.regexp_extract(path, "^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    return F.when(scheme.isin("", "file"), "filesystem").when(scheme.isin("http", "https"), "http").when(scheme == "s3", "s3").when(scheme == "reference", "reference").otherwise("other")


def sources(files: DataFrame) -> DataFrame:
    """One row per dataset: id, paths in order, format, transport and the fault that forbids using it."""
    paths = F.sort_array(F.collect_list("path"))
    out = files.filter("path is not null").groupBy(F.coalesce("ds_id", "path").alias("source")).agg(
        F.first("ds_id").alias("ds_id"),
        paths.alias("paths"),
        F.count_distinct(transport_of(F.col("path"))).alias("transports"),
        F.bool_or(format_of(F.col("path")) != "netcdf").alias("store"),
    )
    first = F.element_at("paths", 1)
    fault = F.when(F.col("transports") > 1, "mixed transports").when(F.col("store") & (F.size("paths") > 1), "several stores")
    return out.select("source", "ds_id", "paths", format_of(first).alias("format"), transport_of(first).alias("transport"), fault.alias("fault"))


def usable(files: DataFrame) -> DataFrame:
    """``sources`` that may be read: no file at all is an error, and so is a source with a fault, which is named."""
    found = sources(files)
    if not (one := found.orderBy(F.col("fault").isNull(), "source").first()):
        raise ValueError("a source needs at least one path")
    if one["fault"]:
        raise ValueError(f"{one['source']}: {one['fault']}")
    return found


def normalise(files: DataFrame) -> DataFrame:
    """Open or ``undefined`` times become the widest bounds."""
    bound = lambda c, v: F.coalesce(F.nullif(F.col(c), F.lit("undefined")), F.lit(v))
    return files.withColumn("start_time", bound("start_time", FIRST_TIME)).withColumn("end_time", bound("end_time", LAST_TIME))


def bootstrap(files: DataFrame, table: str) -> DataFrame:
    """The normalised catalog as a table partitioned by project, made on first use."""
    spark = files.sparkSession
    if not spark.catalog.tableExists(table):
        normalise(files).write.partitionBy("project").saveAsTable(table)
    return spark.table(table)


def overlap(start: Column, end: Column) -> Column:
    return (F.col("end_time") >= start) & (F.col("start_time") <= end)


def search(catalog: DataFrame, ids: list[str], start: str | None = None, end: str | None = None) -> DataFrame:
    """(ds_id, paths) of the files that overlap the interval, ISO texts compared as texts."""
    hit = catalog.filter(F.col("ds_id").isin(ids) & overlap(F.lit(start or FIRST_TIME), F.lit(end or LAST_TIME)))
    return hit.groupBy("ds_id").agg(F.sort_array(F.collect_list("path")).alias("paths"))


#: Months that a node of one level has of the level below, and levels, which reach over 10,000 years.
RADIX, LEVELS = 8, 6


def month(time: Column) -> Column:
    """Months since year 0 of an ISO text; rises with the text."""
    return F.substring(time, 1, 4).cast("int") * 12 + F.substring(time, 6, 2).cast("int") - 1


def nodes_over(first: Column, last: Column) -> Column:
    """The fewest nodes (struct of level and number) that make up the months from first to last, each of which is in
    exactly one of them: at each level those within the months whose parent is not."""
    low = [F.ceil(first / RADIX**k).cast("long") for k in range(LEVELS)]
    high = [F.floor((last + 1) / RADIX**k).cast("long") for k in range(LEVELS)]
    run = lambda a, b: F.when(a < b, F.sequence(a, b - 1)).otherwise(F.array().cast("array<bigint>"))
    named = lambda level, numbers: F.transform(numbers, lambda n: F.struct(F.lit(level).alias("level"), n.alias("number")))
    out = []
    for k in range(LEVELS):
        if k + 1 == LEVELS:
            numbers = run(low[k], high[k])
        else:
            above = low[k + 1] < high[k + 1]
            numbers = F.when(above, F.concat(run(low[k], low[k + 1] * RADIX), run(high[k + 1] * RADIX, high[k]))).otherwise(run(low[k], high[k]))
        out.append(named(k, numbers))
    return F.concat(*out)


def nodes_of(at: Column) -> Column:
    """The node of each level that a month is in."""
    return F.array(*[F.struct(F.lit(k).alias("level"), F.floor(at / RADIX**k).cast("long").alias("number")) for k in range(LEVELS)])


def search_many(catalog: DataFrame, requests: DataFrame) -> DataFrame:
    """The same for a table of requests (ds_id, start, end).

    Two intervals overlap if the file starts within the request, or the request starts within the file, but not with
    or before it; so each pair is found once, as a point in an interval.  Points and intervals meet by
    equality on id and node, an interval by the few nodes that make it up, a point by the node of each level; so an
    id with very many files and requests is dealt by time, and only pairs that share a month's node meet."""
    r = requests.select(F.col("ds_id").alias("r_id"), F.coalesce("start", F.lit(FIRST_TIME)).alias("start"), F.coalesce("end", F.lit(LAST_TIME)).alias("end")).distinct()
    own = ["ds_id", "start_time", "end_time", "path"]
    files = catalog.select(*own)
    asked = lambda nodes: r.withColumn("at", F.explode(nodes)).select("*", F.col("at.level").alias("r_level"), F.col("at.number").alias("r_number")).drop("at")
    held = lambda nodes: files.withColumn("at", F.explode(nodes)).select("*", "at.level", "at.number").drop("at")
    meet = (F.col("r_id") == F.col("ds_id")) & (F.col("r_level") == F.col("level")) & (F.col("r_number") == F.col("number")) & overlap(F.col("start"), F.col("end"))
    after = asked(nodes_over(month(F.col("start")), month(F.col("end")))).join(held(nodes_of(month(F.col("start_time")))), meet & (F.col("start_time") >= F.col("start")))
    before = asked(nodes_of(month(F.col("start")))).join(held(nodes_over(month(F.col("start_time")), month(F.col("end_time")))), meet & (F.col("start_time") < F.col("start")))
    return after.unionByName(before).select("ds_id", "start", "end", "path")


def status(catalog: DataFrame, requests: DataFrame) -> DataFrame:
    """ok, empty_range (known, but no file in the interval) or unknown, per distinct request."""
    r = requests.select("ds_id", "start", "end").distinct()
    known = catalog.select("ds_id", F.lit(True).alias("known")).distinct()
    found = search_many(catalog, r).select("ds_id", "start", "end", F.lit(True).alias("found")).distinct()
    word = F.when(F.col("found"), "ok").when(F.col("known"), "empty_range").otherwise("unknown")
    return r.join(known, "ds_id", "left").join(found, ["ds_id", "start", "end"], "left").select("ds_id", "start", "end", word.alias("status"))


def join_path(root: Column, path: Column) -> Column:
    return F.concat(F.rtrim(root, F.lit("/")), F.lit("/"), F.ltrim(path, F.lit("/")))


def resolve(files: DataFrame, project_s3: str = "s3_root", global_s3: str | None = None, base_dir: str = "base_dir", node: str = "data_node_root") -> DataFrame:
    """file (project S3 root, else the global one, else the base directory) and url of each path."""
    root = F.coalesce(F.col(project_s3), F.lit(global_s3), F.col(base_dir))
    return files.withColumn("file", join_path(root, F.col("path"))).withColumn("url", join_path(F.col(node), F.col("path")))


def name_years(path: Column) -> Column:
    """Years in a file name: from the last ``_`` part of the stem, four leading digits of each ``-`` part."""
    stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), "\\.[^.]*$", "")
    parts = F.split(F.element_at(F.split(stem, "_"), -1), "-")
    years = F.transform(F.filter(parts, lambda p: p.rlike("^[0-9]{4}")), lambda p: F.substring(p, 1, 4).cast("int"))
    return F.when(F.size(years) > 0, F.sequence(F.array_min(years), F.array_max(years)))


def files_in_range(files: DataFrame, start: int | None, end: int | None) -> DataFrame:
    y = name_years(F.col("path"))
    return files.filter((F.array_min(y) <= F.lit(end if end is not None else 10**6)) & (F.array_max(y) >= F.lit(start if start is not None else -(10**6))))


def files_in_series(files: DataFrame, years: list[int]) -> DataFrame:
    return files.filter(F.arrays_overlap(name_years(F.col("path")), F.array(*[F.lit(y) for y in years])))


def consolidate(files: DataFrame, catalog_projects: list[str], start: str, end: str) -> DataFrame:
    """Route of each file of a request: stores and object paths directly; projects with a catalog by its
    times; others by the years in the name.  Files outside the interval are left out."""
    direct = (format_of(F.col("path")) != "netcdf") | (transport_of(F.col("path")) == "s3")
    by_catalog = F.col("project").isin(catalog_projects)
    route = F.when(direct, "direct").when(by_catalog, "catalog").otherwise("lookup")
    y = name_years(F.col("path"))
    inside = (F.array_min(y) <= int(end[:4])) & (F.array_max(y) >= int(start[:4]))
    keep = F.when(direct, True).when(by_catalog, overlap(F.lit(start), F.lit(end))).otherwise(F.coalesce(inside, F.lit(True)))
    return normalise(files).filter(keep).select("project", "ds_id", "path", route.alias("route"))


def homogeneous(files: DataFrame) -> DataFrame:
    """Whether all paths of a dataset are URLs, or all are absolute."""
    return files.groupBy("ds_id").agg((F.bool_and(F.col("path").rlike("^https?://")) | F.bool_and(F.col("path").startswith("/"))).alias("homogeneous"))


def year_bounds(start: str | None, end: str | None, years: list[int] | None) -> tuple[str, str] | None:
    """Interval of consecutive whole years within the request; None where the years have gaps."""
    low, high = start or FIRST_TIME, end or LAST_TIME
    if years:
        want = sorted(set(years))
        if want[-1] - want[0] + 1 != len(want):
            return None
        low, high = max(low, f"{want[0]:04d}-01-01T00:00:00"), min(high, f"{want[-1]:04d}-12-31T23:59:59")
    return low, high


def aligned(files: DataFrame, start: str | None = None, end: str | None = None, years: list[int] | None = None) -> DataFrame:
    """Per dataset: whether the request equals whole files, and which.  files: ds_id, path, fstart, fend.
    The bounds are cut to the files that overlap; then a file must start at the one and a file must end at the other."""
    bounds = year_bounds(start, end, years)
    if bounds is None:
        return files.groupBy("ds_id").agg(F.lit(False).alias("aligned"), F.expr("cast(array() as array<string>)").alias("files"))
    low, high = F.lit(bounds[0]), F.lit(bounds[1])
    of = Window.partitionBy("ds_id")
    hit = (F.col("fend") >= low) & (F.col("fstart") <= high)
    span = files.withColumn("lo", F.min(F.when(hit, F.col("fstart"))).over(of)).withColumn("hi", F.max(F.when(hit, F.col("fend"))).over(of))
    got = span.groupBy("ds_id").agg(
        F.bool_or(hit & (F.col("fstart") == F.greatest(low, F.col("lo")))).alias("a"),
        F.bool_or(hit & (F.col("fend") == F.least(high, F.col("hi")))).alias("b"),
        F.sort_array(F.collect_list(F.when(hit, F.struct("fstart", "path")))).alias("f"),
    )
    ok = F.coalesce(F.col("a") & F.col("b"), F.lit(False))
    return got.select("ds_id", ok.alias("aligned"), F.when(ok, F.transform("f", lambda x: x["path"])).otherwise(F.expr("cast(array() as array<string>)")).alias("files"))


def decide(checked: DataFrame, request: Column, original: Column, processing: Column) -> DataFrame:
    """Per request: original_files where the project's policy or a flag says so, or where all of its
    datasets are whole files and nothing has to be computed; else run_operation."""
    got = checked.groupBy(request.alias("request")).agg(F.bool_and("aligned").alias("all"), F.bool_or(original).alias("o"), F.bool_or(processing).alias("p"), F.count("*").alias("datasets"))
    return got.select("request", "datasets", F.when(F.col("p"), "run_operation").when(F.col("o") | F.col("all"), "original_files").otherwise("run_operation").alias("decision"))
