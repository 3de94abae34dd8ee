"""Access logs in the combined format, as a batch or a stream of lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators.usage import ip_number

LEAST_TOKENS = 12


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of all files under a path or glob; compressed files are read as they are."""
    return spark.read.text(path).withColumnRenamed("value", "line")


def parse(lines: DataFrame) -> DataFrame:
    """Download records of the lines that are whole: at least 12 tokens, an IPv4 address, a timestamp
    and a whole-number status.  The zone is kept as text and not applied; size ``-`` is 0."""
    # The generator keeps the optimizer from copying the split into every token and into the filter.
    t = lines.select(F.explode(F.array(F.split(F.trim("line"), "\\s+"))).alias("t")).filter((F.size("t") >= LEAST_TOKENS) & F.get("t", F.lit(8)).rlike("^[+-]?[0-9]+$"))
    token = lambda k: F.get("t", F.lit(k))
    bare = lambda c: F.regexp_replace(c, '^"|"$', "")
    out = t.select(
        token(0).alias("remote_host_ip"),
        ip_number(token(0)).alias("ip_number"),
        F.expr("try_to_timestamp(substring(t[3], 2), 'dd/MMM/yyyy:HH:mm:ss')").cast("timestamp_ntz").alias("datetime"),
        F.regexp_replace(token(4), "\\]$", "").alias("timezone"),
        bare(token(5)).alias("request_type"),
        token(6).alias("request"),
        bare(token(7)).alias("protocol"),
        token(8).try_cast("int").alias("status_code"),
        F.when(token(9) == "-", F.lit(0)).otherwise(token(9).try_cast("long")).cast("long").alias("size"),
        bare(token(10)).alias("referer"),
        bare(token(11)).alias("user_agent"),
    )
    return out.filter("ip_number > 0 and datetime is not null and status_code is not null and size is not null")


def downloads(lines: DataFrame, output: str = "/outputs", start: str | None = None, end: str | None = None, required: bool = False) -> DataFrame:
    """Parsed downloads of ``.nc`` files below ``output``; other lines go before they are parsed.  If they are
    ``required``, a log without any such download is an error, whatever the interval; a stream can't tell."""
    wanted = lines.filter(F.col("line").rlike(f'"GET {output}/.*/.*\\.nc[ "?]'))
    out = parse(wanted)
    if required and not out.limit(1).count():
        raise ValueError(f"no downloads below {output} in the log")
    if start:
        out = out.filter(F.col("datetime") >= F.lit(start).cast("timestamp_ntz"))
    return out.filter(F.col("datetime") <= F.lit(end).cast("timestamp_ntz")) if end else out


def combine(sites: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Union of per-site tables with the site's name and address."""
    out = None
    for site, (df, url) in sites.items():
        one = df.withColumn("site", F.lit(site)).withColumn("url", F.lit(url))
        out = one if out is None else out.unionByName(one)
    return out
