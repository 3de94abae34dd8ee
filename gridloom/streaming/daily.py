"""Access-log totals as a stream: the same daily tables as the batch, kept up by event time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.sources.accesslog import downloads


def read_log(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.text(folder).withColumnRenamed("value", "line")


def daily_transfer(lines: DataFrame, late: str = "1 day") -> DataFrame:
    """Downloads and bytes per day; lines more than ``late`` behind the newest are left out."""
    rows = downloads(lines).withColumn("at", F.col("datetime").cast("timestamp")).withWatermark("at", late)
    return rows.groupBy(F.window("at", "1 day").alias("w")).agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).select(F.to_date("w.start").alias("day"), "n", "bytes")
