"""Time chunks: by a number of timesteps, by calendar years, or chosen from the cadence.

All of them run on the distinct time axis of a dataset, of which a very long one is dealt to several tasks;
cells meet their chunk by a join on the axis.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions.scratch import cut
from gridloom.operators.aggregate import cadence
from gridloom.operators.ranks import numbered


def second():
    return F.expr("interval 1 second")


def by_steps(cells: DataFrame, steps: int) -> DataFrame:
    """(dataset_id, chunk, start, end, n): every ``steps`` distinct times; a chunk ends a second before the
    next one starts, the last at the last time."""
    axis = numbered(cells.select("dataset_id", "time").distinct(), ["dataset_id"], ["time"], "step")
    got = axis.withColumn("chunk", F.floor(F.col("step") / steps).cast("int")).groupBy("dataset_id", "chunk").agg(F.min("time").alias("start"), F.max("time").alias("last"), F.count("*").alias("n"))
    got = cut(got, "chunks")  # read twice: a chunk meets the one after it by its number
    following = got.select(F.col("dataset_id").alias("d"), (F.col("chunk") - 1).alias("c"), F.col("start").alias("following"))
    met = got.join(following, (F.col("dataset_id") == F.col("d")) & (F.col("chunk") == F.col("c")), "left")
    return met.select("dataset_id", "chunk", "start", F.coalesce(F.col("following") - second(), F.col("last")).alias("end"), "n")


def chunk_years(steps_per_year, target: int, least: int = 1, most: int = 50):
    """Years in a chunk: the target number of timesteps by the cadence, within limits."""
    return F.greatest(F.lit(least), F.least(F.lit(most), F.floor(F.lit(target) / steps_per_year))).cast("int")


def by_years(spans: DataFrame, years: str = "years") -> DataFrame:
    """spans: dataset_id, start, end, and a column of whole years.  Consecutive inclusive intervals; month
    ends and 29 February are moved back where the later year lacks them."""
    count = F.ceil(F.months_between(F.col("end").cast("timestamp"), F.col("start").cast("timestamp")) / (12 * F.col(years))).cast("int")
    each = spans.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), count))))
    day = F.to_date("start")
    clock = F.expr("timestampdiff(SECOND, date_trunc('day', start), start)")
    at = lambda k: (F.add_months(day, k * 12 * F.col(years)).cast("timestamp_ntz") + F.make_dt_interval(secs=clock.cast("decimal(18,6)")))
    out = each.withColumn("a", at(F.col("chunk"))).withColumn("b", at(F.col("chunk") + 1) - second())
    return out.filter("a <= end").select("dataset_id", "chunk", F.col("a").alias("start"), F.least("b", "end").alias("end"))


def plan(cells: DataFrame, target: int = 2000, least: int = 1, most: int = 50) -> DataFrame:
    """How each dataset is cut: whole where it has fewer times than the target, by years where the target
    is a year or more of timesteps, else by steps."""
    rate = cadence(cells)
    years = chunk_years(F.col("steps_per_year"), target, least, most)
    kind = F.when(F.col("n") <= target, "whole").when(F.col("steps_per_year") > target, "steps").otherwise("years")
    return rate.select("dataset_id", "n", "steps_per_year", kind.alias("kind"), F.when(kind == "years", years).alias("years"), F.when(kind == "steps", F.lit(target)).alias("steps"))


def with_year_in(batches: DataFrame, years: list[int]) -> DataFrame:
    """Batches in whose interval one of the years lies."""
    return batches.filter(F.exists(F.array(*[F.lit(y) for y in years]), lambda y: (y >= F.year("start")) & (y <= F.year("end"))))


def chunked(cells: DataFrame, chunks: DataFrame) -> DataFrame:
    """Cells with the chunk they lie in, by the axis: one row per dataset and time is matched by range,
    the cells by equality."""
    axis = cells.select("dataset_id", "time").distinct()
    c = chunks.select(F.col("dataset_id").alias("d"), "chunk", "start", "end")
    at = axis.join(c, (F.col("dataset_id") == F.col("d")) & (F.col("time") >= F.col("start")) & (F.col("time") <= F.col("end"))).select("dataset_id", "time", "chunk")
    return cells.join(at, ["dataset_id", "time"])


def files_of(chunks: DataFrame, files: DataFrame) -> DataFrame:
    """Files that overlap each chunk; a chunk without any has a NULL path.  chunks: key, chunk, start, end;
    files: key, path, fstart, fend."""
    f = files.select(F.col("ds_id").alias("f_id"), "path", "fstart", "fend")
    return chunks.join(f, (F.col("ds_id") == F.col("f_id")) & (F.col("fend") >= F.col("start")) & (F.col("fstart") <= F.col("end")), "left").select("ds_id", "chunk", "path")
