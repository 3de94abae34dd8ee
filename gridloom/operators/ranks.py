"""Positions of rows within a key, and running values along them, with no task that holds a whole key."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.scratch import cut, partitions

#: Rows of one key that a window of ``running`` reads at a time.
SPAN = 1024
#: Rows of a key that a task may always read in order, however few rows there are in all.
FEW = 50_000


def hot_keys(df: DataFrame, key: Sequence[str]) -> DataFrame | None:
    """Keys (with ``_n`` rows, nulls too) that have more than ``FEW`` rows and more than a quarter of what a task
    reads on average: fewer than four a task.  None where there are none."""
    counts = cut(df.groupBy(*key).agg(F.count("*").alias("_n")), "key-counts")
    total = counts.agg(F.sum("_n")).first()[0] or 0
    found = counts.filter(F.col("_n") > max(FEW, total // (4 * partitions(df.sparkSession))))
    return found if found.limit(1).count() else None


def same(a: str, b: str, key: Sequence[str]) -> list[Column]:
    """Equality of two aliased tables on a key, nulls too."""
    return [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in key]


def parted(df: DataFrame, key: Sequence[str], hot: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of the hot keys, and all others."""
    return tuple(df.alias("d").join(F.broadcast(hot).alias("h"), same("d", "h", key), how) for how in ("left_semi", "left_anti"))


def numbered(df: DataFrame, key: Sequence[str], order: Sequence[str], name: str = "position") -> DataFrame:
    """``df`` with the position (long, from 0) of each row within its key, by ``order`` (nulls first).

    Rows of a hot key are dealt by ranges of (key, order), so that they lie in many tasks.  Positions are counted
    within a range and lifted by what the earlier ranges hold of the same key."""
    local = lambda rows, *by: (F.row_number().over(Window.partitionBy(*by, *key).orderBy(*order)) - 1).cast("long")
    hot = hot_keys(df, key)
    if hot is None:
        return df.withColumn(name, local(df))
    large, others = parted(df, key, hot)
    part, lift = f"_{name}_range", f"_{name}_lift"
    dealt = cut(large.repartitionByRange(*key, *order).withColumn(part, F.spark_partition_id()), "ranges")
    counts = dealt.groupBy(*key, part).agg(F.count("*").alias("_n"))  # fewer than two a range and hot key
    before = F.sum("_n").over(Window.partitionBy(*key).orderBy(part).rowsBetween(Window.unboundedPreceding, -1))
    lifts = F.broadcast(counts.select(*key, part, F.coalesce(before, F.lit(0)).alias(lift)))
    met = dealt.withColumn(name, local(dealt, part)).alias("d").join(lifts.alias("l"), [*same("d", "l", key), F.col(f"d.{part}") == F.col(f"l.{part}")])
    lifted = met.select(*[F.col(f"d.{c}").alias(c) for c in df.columns], (F.col(f"d.{name}") + F.col(lift)).alias(name))
    return lifted.unionByName(others.withColumn(name, local(others)))


def running(df: DataFrame, key: Sequence[str], at: str, values: dict[str, tuple[str, Callable[[Column], Column], Callable[[Column, Column], Column]]]) -> DataFrame:
    """``df`` with, per row, each value over the rows of its key before it (null where there are none).

    ``at``: a long from 0, once a key at most.  values: new column -> (column, aggregate, how two aggregates are
    put together).  Windows reach over ``SPAN`` positions; what the earlier spans of a key come to is
    aggregated first, and is a SPAN-th of the rows."""
    rows = df.withColumn("_span", F.floor(F.col(at) / SPAN).cast("long"))
    earlier = Window.partitionBy(*key).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    spans = rows.groupBy(*key, "_span").agg(*[make(F.col(c)).alias(f"_all_{new}") for new, (c, make, _) in values.items()])
    spans = spans.select(*key, "_span", *[make(F.col(f"_all_{new}")).over(earlier).alias(f"_pre_{new}") for new, (_, make, _) in values.items()]).filter("_span > 0")
    within = Window.partitionBy(*key, "_span").orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.select("*", *[make(F.col(c)).over(within).alias(f"_in_{new}") for new, (c, make, _) in values.items()])
    rows = rows.join(spans, [*key, "_span"], "left")
    both = lambda a, b, put: F.when(a.isNull(), b).when(b.isNull(), a).otherwise(put(a, b))
    return rows.select(*df.columns, *[both(F.col(f"_pre_{new}"), F.col(f"_in_{new}"), put).alias(new) for new, (_, _, put) in values.items()])
