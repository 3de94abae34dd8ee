"""Running requests as a stream against the batch, with late and open requests, over hours and days."""

from __future__ import annotations

import datetime
import random

from pyspark.sql import functions as F

from gridloom.operators import usage
from gridloom.streaming import running


def test_stream_equals_batch(spark, tmp_path):
    r = random.Random(3)
    zero = datetime.datetime(2024, 3, 1)
    rows = []
    for k in range(400):
        start = zero + datetime.timedelta(seconds=r.randrange(5 * 86400) if k % 20 else 3600 * r.randrange(100))
        rows.append((f"u{k}", start, start + datetime.timedelta(seconds=r.choice([0, 60, 3600, 7200, 40_000]))))
    rows.append(("last", zero + datetime.timedelta(days=40), zero + datetime.timedelta(days=40)))  # moves the watermark on
    rows.sort(key=lambda x: x[1])
    df = spark.createDataFrame(rows, "uuid string, time_start timestamp_ntz, time_end timestamp_ntz")
    schema = df.schema
    for k in range(6):
        spark.createDataFrame(rows[k * 70 : (k + 1) * 70], schema).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    query = running.hourly(stream, "1 day").writeStream.format("parquet").option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/check").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(240)
    assert query.exception() is None
    hours = spark.read.parquet(f"file://{tmp_path}/out")
    got = {x["day"]: x["peak"] for x in running.peaks(hours).collect()}
    want = {x["day"]: x["peak"] for x in usage.concurrency_per_day(df.filter("uuid <> 'last'")).collect()}
    assert got == want and max(v for v in want.values() if v) > 5
    assert hours.groupBy("hour").count().filter("count > 1").count() == 0
