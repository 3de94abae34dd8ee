"""Means over dimensions, periods and members; profiles of datasets.

Spark's two-step hash aggregation sums before it shuffles, so only one row per group and task
travels.  Missing cells are NULL and do not count; a group without any is NULL.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIMENSIONS = ("time", "level", "lat", "lon", "realization")
ALIASES = {"latitude": "lat", "longitude": "lon"}
KEYS = ("dataset_id", "variable")


def dims_of(df: DataFrame) -> list[str]:
    return [c for c in (*KEYS, *DIMENSIONS) if c in df.columns]


def average(cells: DataFrame, dims: Sequence[str], ignore_undetected_dims: bool = False) -> DataFrame:
    """Plain mean over ``dims``; all other dimensions stay."""
    wanted = [ALIASES.get(d, d) for d in dims]
    if unknown := [d for d in wanted if d not in DIMENSIONS or d not in cells.columns]:
        if not ignore_undetected_dims:
            raise ValueError(f"unknown dimensions: {', '.join(unknown)}")
        wanted = [d for d in wanted if d not in unknown]
    return cells.groupBy(*[c for c in dims_of(cells) if c not in wanted]).agg(F.avg("value").alias("value"))


def average_time(cells: DataFrame, freq: str = "year", fill_gaps: bool = False) -> DataFrame:
    """Mean per year, month or day; ``time`` becomes the period's start.  Periods without rows are
    absent unless ``fill_gaps``."""
    if freq not in ("year", "month", "day"):
        raise ValueError(f"unknown frequency {freq}")
    period = F.date_trunc(freq, "time").cast("timestamp_ntz")
    others = [c for c in dims_of(cells) if c != "time"]
    out = cells.groupBy(*others, period.alias("time")).agg(F.avg("value").alias("value"))
    if fill_gaps:
        span = out.groupBy(*others).agg(F.min("time").alias("a"), F.max("time").alias("b"))
        full = span.select(*others, F.explode(F.expr(f"sequence(a, b, interval 1 {freq})")).alias("time"))
        out = full.join(out, [*others, "time"], "left")
    return out


def weighted_average(cells: DataFrame) -> DataFrame:
    """Mean over lat and lon, weighted by the cosine of latitude; missing cells have no weight."""
    w = F.cos(F.radians("lat"))
    others = [c for c in dims_of(cells) if c not in ("lat", "lon")]
    mean = F.sum(w * F.col("value")) / F.sum(F.when(F.col("value").isNotNull(), w))
    return cells.groupBy(*others).agg(mean.alias("value"))


def ensemble_mean(cells: DataFrame) -> DataFrame:
    """Mean over members; the id of a single member means nothing afterwards and goes."""
    return average(cells.drop("dataset_id"), ["realization"])


YEAR_DAYS = {"360_day": 360.0, "noleap": 365.0, "365_day": 365.0, "all_leap": 366.0, "366_day": 366.0}


def cadence(cells: DataFrame, calendar: str = "standard") -> DataFrame:
    """Timesteps a year per dataset, at least 1: from the mean step, or the fullest year where there is one time."""
    seconds = YEAR_DAYS.get(calendar, 365.2425) * 86400
    axis = cells.select("dataset_id", "time").distinct()
    a = axis.groupBy("dataset_id").agg(F.count("*").alias("n"), F.min("time").alias("t0"), F.max("time").alias("t1"))
    span = F.expr("timestampdiff(SECOND, t0, t1)")
    steps = F.when(span > 0, F.floor((F.col("n") - 1) * seconds / span + 0.5)).otherwise(F.col("n"))
    return a.select("dataset_id", "n", F.greatest(F.lit(1), steps).cast("long").alias("steps_per_year"))


def profile(cells: DataFrame) -> DataFrame:
    """Size of every dimension and number of cells per dataset."""
    size = lambda c: F.count_distinct(c).alias(f"n_{c}")
    return cells.groupBy("dataset_id").agg(*[size(c) for c in DIMENSIONS if c in cells.columns], F.count("*").alias("cells"), F.count("value").alias("present"))


def payload_per_step(cells: DataFrame) -> DataFrame:
    """Bytes of values per timestep, rounded up; cells without a time are static and ignored."""
    timed = cells.filter(F.col("time").isNotNull())
    return timed.groupBy("dataset_id").agg(F.ceil(F.count("value") * 8 / F.count_distinct("time")).cast("long").alias("bytes_per_step"))
