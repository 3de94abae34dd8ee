"""Ensembles: members stacked along ``realization``."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions.scratch import cut, small
from gridloom.operators.aggregate import ensemble_mean
from gridloom.operators.select import subset


def stack(members: Sequence[DataFrame], dims: str = "realization") -> DataFrame:
    """Members one after the other, numbered from 1 where they carry no number; a column that some
    members lack is NULL there, and bounds are dropped."""
    if dims != "realization":
        raise ValueError(f"members can only be stacked along realization, not {dims}")
    numbered = [(m if "realization" in m.columns else m.withColumn("realization", F.lit(k))).withColumn("realization", F.col("realization").cast("int")) for k, m in enumerate(members, 1)]
    plain = [m.drop(*[c for c in m.columns if c.endswith("_bnds")]) for m in numbered]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), plain)


def concat(members: Sequence[DataFrame], time=None, time_components=None, area=None, apply_average: bool = False, frame: int | None = None) -> DataFrame:
    """Stack, select and, where asked, average over members.  The selection is written once, above the
    stack; Spark moves it into every member's scan."""
    out = subset(stack(members), time, time_components, area, frame=frame)
    return ensemble_mean(out) if apply_average else out


def signatures(files: DataFrame, coordinates: Sequence[str]) -> DataFrame:
    """(dataset_id, file, coordinate, n, sign, mixed): a signature of the set of values that each file has of each
    coordinate, in any order: their number, the sum of one 64-bit hash and the exclusive-or of another."""
    each = F.array(*[F.struct(F.lit(c).alias("coordinate"), F.col(c).cast("double").alias("at")) for c in coordinates])
    values = files.select("dataset_id", "file", *coordinates).distinct().select("dataset_id", "file", F.explode(each).alias("c")).select("dataset_id", "file", "c.*").distinct()
    one, two = F.xxhash64("at").cast("decimal(38,0)"), F.xxhash64(F.lit("second"), "at")
    return values.groupBy("dataset_id", "file", "coordinate").agg(F.count("*").alias("n"), F.sum(one).alias("sign"), F.bit_xor(two).alias("mixed"))


def concat_faults(files: DataFrame, coordinates: Sequence[str] = ("lat", "lon", "level")) -> DataFrame:
    """(dataset_id, file, coordinate): where a file's coordinate differs from that of the dataset's first file."""
    signed = cut(signatures(files, coordinates), "signatures")
    told = lambda df: df.select("dataset_id", "coordinate", F.struct("n", "sign", "mixed").alias("own"))
    first = signed.groupBy("dataset_id").agg(F.min("file").alias("first"))
    of_first = told(signed.join(first.withColumnRenamed("first", "file"), ["dataset_id", "file"])).withColumnRenamed("own", "wanted")
    met = signed.select("dataset_id", "file", "coordinate", F.struct("n", "sign", "mixed").alias("own")).join(of_first, ["dataset_id", "coordinate"])
    return met.filter("own <> wanted").select("dataset_id", "file", "coordinate")


def concat_time_exact(files: DataFrame) -> DataFrame:
    """Per dataset of (dataset_id, file, lat, lon, level, ...): whether all its files have the same
    cells, compared by 128-bit signatures of each file's set of them."""
    cells = files.select("dataset_id", "file", "lat", "lon", "level").distinct()
    one, two = F.xxhash64("lat", "lon", "level").cast("decimal(38,0)"), F.xxhash64(F.lit("second"), "level", "lon", "lat")
    sign = cells.groupBy("dataset_id", "file").agg(F.sum(one).alias("sign"), F.bit_xor(two).alias("mixed"), F.count("*").alias("n"))
    same = F.count_distinct(F.struct("sign", "mixed", "n")) == 1
    return sign.groupBy("dataset_id").agg(F.count("*").alias("files"), same.alias("aligned"))


def concat_time(files: DataFrame, coordinates: Sequence[str] = ("lat", "lon", "level"), static: Sequence[str] = (), strict: bool = True) -> DataFrame:
    """Files of each dataset stacked along time, if all other coordinates are the same in each: rows without ``file``,
    where the ``static`` columns (of a position, not of a time) have the values of the dataset's first file.
    A dataset with a mismatch is an error, which names file and coordinate; unless ``strict``, it is left out."""
    faults = cut(concat_faults(files, coordinates), "faults")
    if strict and (bad := faults.orderBy("dataset_id", "file", "coordinate").first()):
        raise ValueError(f"{bad['dataset_id']}: {bad['file']} has another {bad['coordinate']} than the first file")
    rows = files.join(small(faults.select("dataset_id").distinct()), "dataset_id", "left_anti")
    if static:
        place = ["dataset_id", *coordinates]
        first = rows.groupBy("dataset_id").agg(F.min("file").alias("file"))
        of_first = rows.join(first, ["dataset_id", "file"]).groupBy(*place).agg(*[F.min(c).alias(c) for c in static])
        rows = rows.drop(*static).join(of_first, place, "left")
    return rows.select(*[c for c in files.columns if c != "file"])


def align(cells: DataFrame) -> DataFrame:
    """Every member on the union of all members' cells; what a member lacks is NULL.  A cell's members are put in one
    map, so that cells are moved once and the grid of cells by members, which is much larger, never is.  As keys
    that are NULL equal none, a cell with such a one has no values."""
    where = ["variable", "time", "level", "lat", "lon"]
    means = cells.groupBy(*where, "realization").agg(F.avg("value").alias("value"))
    pair = F.when(F.col("realization").isNotNull(), F.struct("realization", "value"))
    held = cut(means.groupBy(*where).agg(F.map_from_entries(F.collect_list(pair)).alias("own")), "aligned")
    listed = held.select(F.explode(F.map_keys("own")).alias("realization")).distinct().agg(F.sort_array(F.collect_list("realization")).alias("all"))  # one row: the members
    axis = held.join(F.broadcast(listed), F.lit(True)).select(*where, "own", F.explode("all").alias("realization"))
    known = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in where])
    return axis.select(*where, "realization", F.when(known, F.try_element_at("own", F.col("realization"))).alias("value"))


def static_join(cells: DataFrame, grid: DataFrame, key: str) -> DataFrame:
    """Cells with their static variables, which stay one row per grid cell."""
    return cells.join(grid, key)
