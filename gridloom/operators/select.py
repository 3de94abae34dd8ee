"""Selections on cells.  All of them are one filter, so a scan sees every predicate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions.params import Selection


def require(df: DataFrame, *columns: str) -> None:
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing column {', '.join(missing)}; it may have been averaged away")


def longitude_frame(cells: DataFrame) -> int:
    """360 where longitudes run 0..360, 180 where they run -180..180; from the data's range."""
    low, high = cells.agg(F.min("lon"), F.max("lon")).first()
    return 180 if low is not None and low < 0 else 360


def subset(cells: DataFrame, time=None, time_components=None, area=None, level=None, frame: int | None = None) -> DataFrame:
    """Cells in the time interval or at its points, with the calendar components, in the box and on
    the levels.  ``frame`` says how longitudes run and saves the look at the data.  Longitudes come
    back in the frame of the box."""
    asked = Selection.parse(time, time_components, area, level)
    keep = F.lit(True)
    if time or asked.components.year or asked.components.month or asked.components.day or asked.components.hour:
        require(cells, "time")
        keep = keep & asked.components.narrow(asked.time).where() & asked.components.where()
    if level:
        require(cells, "level")
        keep = keep & asked.level.where()
    if asked.area is None:
        return cells.filter(keep)
    require(cells, "lat", "lon")
    frame = longitude_frame(cells) if frame is None else frame
    return cells.filter(keep & asked.area.where(frame)).withColumn("lon", asked.area.longitude())
