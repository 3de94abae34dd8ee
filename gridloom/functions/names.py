"""Names of outputs: the dataset's facets, the period and what was done."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Project -> places, in the dataset id, of variable, table or frequency, model, experiment, member and grid (fixed values).
FACETS = {
    "c3s-cmip5": (9, 5, 3, 4, 8),
    "cmip5": (9, 5, 3, 4, 8),
    "c3s-cmip6": (7, 6, 3, 4, 5, 8),
    "cmip6": (8, 7, 4, 5, 6, 9),
    "c3s-cmip6-decadal": (7, 6, 3, 4, 5, 8),
    "c3s-cordex": (10, 2, 4, 5, 6, 7, 8, 9),
}


def facets(dataset_id: Column) -> Column:
    """Facets of an id, joined by ``_``; an id of an unknown project, or with too few parts, stays whole."""
    parts = F.split(dataset_id, "\\.")
    out = F.regexp_replace(dataset_id, "[./]", "_")
    for project, places in FACETS.items():
        known = (F.lower(F.get(parts, F.lit(0))) == project) & (F.size(parts) > max(places))
        out = F.when(known, F.concat_ws("_", *[F.get(parts, F.lit(p)) for p in places])).otherwise(out)
    return out


def averaged(dims: Sequence[str] = (), freq: str | None = None) -> str:
    """What an average adds to a name: its frequency, or the first letters of its dimensions."""
    if freq:
        return f"avg-{freq}"
    first = {"realization": "r", "latitude": "y", "lat": "y", "longitude": "x", "lon": "x", "level": "z", "time": "t"}
    return "avg-" + "".join(sorted({first.get(d, d[:1]) for d in dims}))


def output_name(dataset_id: Column, start: Column | None = None, end: Column | None = None, done: str | None = None, suffix: str = ".nc") -> Column:
    """``<facets>_<yyyymmdd>-<yyyymmdd>_<done>.nc``; without a period, or without an addition, that part is left out."""
    day = lambda c: F.date_format(c, "yyyyMMdd")
    period = F.when(start.isNotNull() & end.isNotNull(), F.concat_ws("-", day(start), day(end))) if start is not None and end is not None else F.lit(None).cast("string")
    return F.concat(F.concat_ws("_", facets(dataset_id), period, F.lit(done)), F.lit(suffix))
