"""Shared helpers: reading tables, word classes; and those of the library for lineage and sizes."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.scratch import BROADCAST_ROWS, cut, discard, join_split, partitions, scratch, shared_folder, small  # noqa: F401  for the operators

#: Java / RE2 character class of the six ASCII white-space characters.
WHITE = "[\\x20\\x09-\\x0D]"
WHITE_CHARS = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextmanager
def arrow_batches(spark: SparkSession, most: int):
    """Within, batches between Spark and Python hold about ``most`` bytes; the session's own setting comes back."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(most))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def lower_ascii(text):
    """Lower-case A-Z only; every other character stays."""
    return F.translate(text, UPPER, LOWER)


def pinned(column):
    """``column``, computed once where it stands: the always-true test of a row number keeps the optimizer
    from copying a costly array expression into filters and lambdas that use it."""
    return F.when(F.monotonically_increasing_id() >= 0, column)
