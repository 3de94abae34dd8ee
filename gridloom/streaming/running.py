"""Running requests as a stream: what each hour adds is known once the watermark has passed it; peaks of days are put
together from the hours, with what is still running carried from hour to hour."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from gridloom.operators.usage import every_day

HOUR = 3_600_000_000


def hourly(requests: DataFrame, late: str = "2 hours") -> DataFrame:
    """(hour, net, peak) of a stream of requests with time_start and time_end: how many more started than ended, and the
    most that were running at once above what ran at its beginning (null: it never rose).

    An hour's state counts starts and ends of each instant.  Its timer goes off when the watermark is past its
    end; then it is added up in order of time, starts first, given out once, and dropped."""
    ends = F.array(F.struct(F.col("time_start").alias("time"), F.lit(1).alias("w")), F.struct(F.col("time_end").alias("time"), F.lit(-1).alias("w")))
    events = requests.select(F.explode(ends).alias("e")).select(F.col("e.time").cast("timestamp").alias("time"), "e.w").filter("time is not null")
    events = events.withWatermark("time", late).withColumn("hour", F.timestamp_micros(F.floor(F.unix_micros("time") / HOUR).cast("long") * HOUR))

    def add(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            running, peak = 0, None
            rows = sorted(zip(*state.get, strict=True))
            for _, starts, stops in rows:
                running += starts
                # Only what follows an event counts: after the starts, and after the ends of an instant.
                peak = max([x for x in (peak, running if starts else None, running - 1 if stops else None) if x is not None])
                running -= stops
            state.remove()
            yield pd.DataFrame({"hour": [key[0]], "net": [running], "peak": [peak]})
            return
        starts, stops = Counter(), Counter()
        if state.exists:
            for at, a, b in zip(*state.get, strict=True):
                starts[at], stops[at] = a, b
        for frame in frames:
            at = pd.to_datetime(frame["time"]).to_numpy().astype("datetime64[us]").astype("int64")
            for t, w in zip(at.tolist(), frame["w"].tolist(), strict=True):
                (starts if w > 0 else stops)[t] += 1
        times = sorted(starts.keys() | stops.keys())
        state.update((times, [starts[t] for t in times], [stops[t] for t in times]))
        over = (times[0] // HOUR + 1) * HOUR // 1000
        state.setTimeoutTimestamp(max(over, state.getCurrentWatermarkMs() + 1))

    return events.groupBy("hour").applyInPandasWithState(add, "hour timestamp, net long, peak long", "times array<long>, starts array<long>, stops array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def peaks(hours: DataFrame) -> DataFrame:
    """(day, peak) from the hours that a stream has given out: what runs at the beginning of an hour is what all hours
    before it have left; a day without running requests is NULL."""
    before = F.coalesce(F.sum("net").over(Window.orderBy("hour").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row an hour
    most = hours.withColumn("most", before + F.col("peak")).filter("most > 0")
    return every_day(most.groupBy(F.to_date("hour").alias("day")).agg(F.max("most").alias("peak")), None)
