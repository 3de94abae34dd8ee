"""Usage analytics over request records and parsed access logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FAILED, DONE = 5, 4
GIB = 1024.0**3


def ip_number(ip: Column) -> Column:
    """IPv4 as an integer, 0 where it isn't one."""
    octet = "(25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"
    value = F.aggregate(F.split(ip, "\\."), F.lit(0).cast("long"), lambda a, x: a * 256 + x.cast("long"))
    return F.when(ip.rlike(f"^{octet}(\\.{octet}){{3}}$"), value).otherwise(F.lit(0)).cast("long")


def collect(requests: DataFrame, start: str, end: str) -> DataFrame:
    """Executed requests that lie within the interval."""
    return requests.filter("operation = 'execute'").filter((F.col("time_start") >= F.lit(start).cast("timestamp_ntz")) & (F.col("time_end") <= F.lit(end).cast("timestamp_ntz")))


def finished(requests: DataFrame, identifier: str | None = None) -> DataFrame:
    """Failed and successful requests; those of one process where asked."""
    out = requests.filter(F.col("status").isin(DONE, FAILED))
    return out.filter((F.col("operation") == "execute") & (F.col("identifier") == identifier)) if identifier else out


def every_day(got: DataFrame, fill: int | None = 0, undated: bool = False) -> DataFrame:
    """Rows (day, ...), one a day, and between them a row for each missing day whose other columns are ``fill``;
    the row without a day goes, or stays where ``undated`` asks for it."""
    later = F.lead("day").over(Window.orderBy("day"))  # one row a day
    days = F.expr("sequence(day, coalesce(date_sub(_next, 1), day), interval 1 day)")
    each = (got if undated else got.filter("day is not null")).withColumn("_next", later).withColumn("_day", F.explode_outer(days))
    return each.select(F.col("_day").alias("day"), *[F.when(F.col("_day").eqNullSafe(F.col("day")), F.col(c)).otherwise(F.lit(fill)).alias(c) for c in got.columns if c != "day"])


def per_day(df: DataFrame, column: str, **counts: Column) -> DataFrame:
    return df.groupBy(F.to_date(column).alias("day")).agg(*[c.alias(n) for n, c in counts.items()])


def daily(df: DataFrame, column: str, **counts: Column) -> DataFrame:
    """Aggregates per day with zeros for days without rows, between the first and last day."""
    return every_day(per_day(df, column, **counts))


def requests_per_day(requests: DataFrame) -> DataFrame:
    failed = F.col("status") == FAILED
    return daily(requests, "time_start", success=F.count_if(~failed), failed=F.count_if(failed))


def requests_per_weekday(requests: DataFrame) -> DataFrame:
    return requests.groupBy(F.weekday("time_start").alias("weekday")).agg(F.count("*").alias("n"))


def requests_per_hour(requests: DataFrame) -> DataFrame:
    hours = requests.sparkSession.range(24).select(F.col("id").cast("int").alias("hour"))
    got = requests.groupBy(F.hour("time_start").alias("hour")).agg(F.count("*").alias("n"))
    return hours.join(F.broadcast(got), "hour", "left").fillna(0, ["n"])  # 24 rows


def pulse(requests: DataFrame) -> DataFrame:
    return requests.groupBy(F.weekday("time_start").alias("weekday"), F.hour("time_start").alias("hour")).agg(F.count("*").alias("n"))


def duration(true_seconds: bool = False) -> Column:
    """Seconds of a request; without whole days unless ``true_seconds``."""
    s = F.expr("timestampdiff(SECOND, time_start, time_end)")
    return s if true_seconds else F.pmod(s, F.lit(86400))


def duration_histogram(requests: DataFrame, bins: int = 60, cap: int = 60) -> DataFrame:
    """Density of capped durations over equal bins between their least and greatest value."""
    d = requests.select(F.least(F.lit(cap), duration()).cast("double").alias("d")).filter("d is not null").groupBy("d").agg(F.count("*").alias("c"))
    ends = d.agg(F.min("d").alias("a"), F.max("d").alias("b"), F.sum("c").alias("total"))
    ends = ends.select(F.expr("if(a = b, a - 0.5, a)").cast("double").alias("low"), F.expr("if(a = b, b + 0.5, b)").cast("double").alias("high"), "total")
    each = d.join(F.broadcast(ends), F.col("d") >= F.col("low"))  # capped values: at most cap + 1 rows
    width = (F.col("high") - F.col("low")) / bins
    k = F.least(F.lit(bins - 1), F.floor((F.col("d") - F.col("low")) / width)).cast("int")
    got = each.groupBy(k.alias("bin")).agg(F.sum("c").alias("c"))
    grid = requests.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    full = grid.join(F.broadcast(got), "bin", "left").join(F.broadcast(ends), F.col("low").isNotNull())
    return full.select("bin", (F.col("low") + F.col("bin") * width).alias("bin_start"), (F.coalesce("c", F.lit(0)) / (F.col("total") * width)).alias("density"))


def concurrency(requests: DataFrame) -> DataFrame:
    """Requests running after each start or end, where any are.  A start counts before an end at the
    same instant.  Each hour's running total is made by itself and lifted by the net count of the hours
    before, so no task holds more than an hour."""
    ends = F.array(F.struct(F.col("time_start").alias("time"), F.lit(1).alias("w")), F.struct(F.col("time_end").alias("time"), F.lit(-1).alias("w")))
    events = requests.select("uuid", F.explode(ends).alias("e")).select("e.time", "e.w", "uuid").filter("time is not null").withColumn("hour", F.date_trunc("hour", "time"))
    net = events.groupBy("hour").agg(F.sum("w").alias("net"))
    before = net.select(F.col("hour").alias("h"), (F.sum("net").over(Window.orderBy("hour")) - F.col("net")).alias("before"))  # one row an hour
    running = F.sum("w").over(Window.partitionBy("hour").orderBy("time", F.desc("w"), "uuid").rowsBetween(Window.unboundedPreceding, 0))
    lifted = events.withColumn("r", running).join(before, F.col("hour") == F.col("h"))
    return lifted.select("time", F.to_date("time").alias("day"), "w", (F.col("r") + F.col("before")).alias("running")).filter("running > 0")


def concurrency_per_day(requests: DataFrame) -> DataFrame:
    """Peak per day; a day without running requests is NULL."""
    return every_day(concurrency(requests).groupBy("day").agg(F.max("running").alias("peak")), None)


def downloads_per_day(downloads: DataFrame) -> DataFrame:
    return daily(downloads, "datetime", n=F.count("*"))


def transfer_per_day(downloads: DataFrame) -> DataFrame:
    return daily(downloads, "datetime", bytes=F.sum("size")).select("day", (F.col("bytes") / GIB).alias("gib"))


def error_table(requests: DataFrame) -> DataFrame:
    failed = requests.filter((F.col("status") == FAILED) & F.col("message").isNotNull())
    return failed.groupBy("message").agg(F.to_date(F.min("time_start")).alias("first"), F.to_date(F.max("time_start")).alias("last"), F.count("*").alias("n"))


def overview(requests: DataFrame, downloads: DataFrame) -> DataFrame:
    """(property, value) rows of totals and of minimum, maximum and median per day.  Requests and downloads
    are each counted once by day, and the totals are sums of these."""

    def spread(column: str, name: str, weight: str | None = None) -> list[Column]:
        value = F.col(column).cast("double")
        middle = F.percentile(value, 0.5, F.col(weight)) if weight else F.median(value)
        return [F.min(value).alias(f"min_{name}"), F.max(value).alias(f"max_{name}"), middle.alias(f"median_{name}")]

    def told(df: DataFrame) -> DataFrame:
        return df.unpivot([], df.columns, "property", "value")

    # Totals count rows without a day too.
    dated = F.col("day").isNotNull()
    asked = every_day(per_day(requests, "time_start", n=F.count("*"), failed=F.count_if(F.col("status") == FAILED)), undated=True).withColumn("dated", F.when(dated, F.col("n")))
    asked = asked.agg(F.sum("n").cast("double").alias("total"), F.sum("failed").cast("double").alias("failed"), *spread("dated", "requests_per_day"))
    moved = every_day(per_day(downloads, "datetime", n=F.count("*"), bytes=F.sum("size")), undated=True).withColumn("dated", F.when(dated, F.col("n"))).withColumn("gib", F.when(dated, F.col("bytes") / GIB))
    moved = moved.agg((F.sum("bytes") / GIB).alias("total_gib"), *spread("dated", "downloads_per_day"), *spread("gib", "gib_per_day"))
    took = requests.groupBy(duration().alias("s")).agg(F.count("*").alias("c")).filter("s > 0").agg(*spread("s", "duration", "c"))
    peaks = concurrency_per_day(requests).agg(*spread("peak", "concurrency"))
    one = asked.join(F.broadcast(moved), F.lit(True))  # one row each
    one = one.withColumn("gib_per_request", F.col("total_gib") / F.nullif(F.col("total") - F.col("failed"), F.lit(0)))
    return told(one).unionByName(told(took)).unionByName(told(peaks))
