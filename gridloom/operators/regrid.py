"""Remapping to a regular grid.

Weights are separable, so they are made per axis from the distinct source and target positions
(hundreds of numbers), and cells meet them by equality on lat, then on lon, with a sum after each;
cells are never paired with all targets.  Axes may be unevenly spaced: sources around a target are found by
bisection, and a cell reaches half-way to its neighbours.

Where positions are pairs (a curvilinear grid, or stations), the nearest one on the sphere is looked for in
boxes of the unit sphere, see ``nearest_positions``.
"""

from __future__ import annotations

import bisect
import itertools
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.params import Grid
from gridloom.functions.scratch import cut
from gridloom.operators.aggregate import dims_of

METHODS = ("nearest_s2d", "bilinear", "conservative")
#: Most positions on an axis; weights per axis are made on the driver.
MOST_POSITIONS = 100_000


def positions(cells: DataFrame, axis: str) -> list[float]:
    found = [r[0] for r in cells.select(axis).distinct().limit(MOST_POSITIONS + 1).collect()]
    if len(found) > MOST_POSITIONS:
        raise ValueError(f"more than {MOST_POSITIONS} positions on {axis}")
    return sorted(x for x in found if x is not None)


def step_of(source: Sequence[float]) -> float:
    """The least spacing: the resolution that grid ``auto`` takes."""
    return min((b - a for a, b in zip(source, source[1:], strict=False)), default=1.0)


def is_round(source: Sequence[float]) -> bool:
    """Whether longitudes go all the way round: the gap from the last to the first is no wider than any other."""
    gaps = [b - a for a, b in zip(source, source[1:], strict=False)]
    return bool(gaps) and source[0] + 360 - source[-1] <= max(gaps) + 1e-6


def extended(source: Sequence[float], wraps: bool) -> list[tuple[float, float]]:
    """(place, position) in rising order of place; longitudes that go all the way round are repeated a turn to
    either side."""
    if not (wraps and is_round(source)):
        return [(s, s) for s in source]
    return [(s + turn, s) for turn in (-360.0, 0.0, 360.0) for s in source]


def within_turn(t: float, source: Sequence[float], wraps: bool) -> float:
    """The target on the same turn as the positions, where there is one within their extent, else the nearest."""
    if not wraps:
        return t
    middle = (source[0] + source[-1]) / 2
    return t - 360.0 * math.floor((t - middle) / 360.0 + 0.5)


def near(source: Sequence[float], targets: Sequence[float], wraps: bool) -> list[tuple[float, float, float]]:
    """(source, target, weight): the nearest source; a tie goes to the lower place."""
    at = extended(source, wraps)
    places = [p for p, _ in at]
    out = []
    for t in targets:
        x = within_turn(t, source, wraps)
        k = bisect.bisect_left(places, x)
        some = [i for i in (k - 1, k) if 0 <= i < len(at)]
        best = min(some, key=lambda i: (round(abs(places[i] - x), 9), i))
        out.append((at[best][1], t, 1.0))
    return out


def linear(source: Sequence[float], targets: Sequence[float], wraps: bool) -> list[tuple[float, float, float]]:
    """The two sources around a target, by nearness; beyond the first or last source that one alone."""
    at = extended(source, wraps)
    places = [p for p, _ in at]
    out = []
    for t in targets:
        x = min(max(within_turn(t, source, wraps), places[0]), places[-1])
        k = min(max(bisect.bisect_right(places, x), 1), len(at) - 1)
        share = (x - places[k - 1]) / (places[k] - places[k - 1]) if len(at) > 1 else 0.0
        for i, w in ((k - 1, 1 - share), (k, share)) if len(at) > 1 else ((0, 1.0),):
            if w > 1e-12:
                out.append((at[i][1], t, w))
    return out


def bounds_of(source: Sequence[float], wraps: bool) -> list[tuple[float, float]]:
    """Lower and upper bound of each position's cell: half-way to its neighbours; the outer ones as far outward as
    inward, latitudes to the poles at most."""
    if len(source) < 2:
        return [(s - 0.5, s + 0.5) for s in source]
    edges = [(a + b) / 2 for a, b in zip(source, source[1:], strict=False)]
    seam = (source[0] + 360 - source[-1]) / 2
    first, last = (seam, seam) if wraps and is_round(source) else (edges[0] - source[0], source[-1] - edges[-1])
    edges = [source[0] - first, *edges, source[-1] + last]
    if not wraps:
        edges = [min(90.0, max(-90.0, e)) for e in edges]
    return list(zip(edges, edges[1:], strict=False))


def overlaps(source: Sequence[float], targets: Sequence[float], step: float, wraps: bool) -> list[tuple[float, float, float]]:
    """Shared extent of source and target cells: in degrees of longitude, or the sine's difference in latitude.  Both
    lists of cells are in order, so a target starts where the first source cell ends that reaches into it."""
    turns = (-360.0, 0.0, 360.0) if wraps else (0.0,)
    cells = [(low + turn, high + turn, s) for turn in turns for s, (low, high) in zip(source, bounds_of(source, wraps), strict=True)]
    cells.sort()
    ends = list(itertools.accumulate((high for _, high, _ in cells), max))
    out = []
    for t in targets:
        low, high = t - step / 2, t + step / 2
        if not wraps:
            low, high = max(-90.0, low), min(90.0, high)
        shared: dict[float, float] = {}
        for a, b, s in itertools.islice(cells, bisect.bisect_right(ends, low), None):
            if a >= high:
                break
            x, y = max(a, low), min(b, high)
            if y - x > 1e-12:
                shared[s] = shared.get(s, 0.0) + (y - x if wraps else math.sin(math.radians(y)) - math.sin(math.radians(x)))
        out += [(s, t, w) for s, w in shared.items()]
    return out


def regrid(cells: DataFrame, grid: str | Sequence[float] | Grid = "auto", method: str = "nearest_s2d", adaptive_masking_threshold: float | None = 0.5) -> DataFrame:
    """Cells on the target grid.  A target is missing where more than the threshold of its weight falls
    on missing sources (nearest: where its source is missing), else the rest is scaled up."""
    method = {"nn": "nearest_s2d"}.get(method, method)
    if method not in METHODS:
        raise ValueError(f"unknown method {method}")
    lats, lons = positions(cells, "lat"), positions(cells, "lon")
    if not lats or not lons:
        return cells
    if not isinstance(grid, Grid):
        grid = Grid.parse(grid, own=(step_of(lons), step_of(lats)))
    make = {"nearest_s2d": lambda s, t, step, w: near(s, t, w), "bilinear": lambda s, t, step, w: linear(s, t, w), "conservative": overlaps}[method]
    spark = cells.sparkSession
    table = lambda rows, axis: F.broadcast(spark.createDataFrame(rows, f"{axis} double, t_{axis} double, w_{axis} double"))  # noqa: E731  a few rows per position
    wlat = table(make(lats, grid.lats(), grid.dlat, False), "lat")
    wlon = table(make(lons, grid.lons(), grid.dlon, True), "lon")
    others = [c for c in dims_of(cells) if c not in ("lat", "lon")]
    there = F.col("value").isNotNull()
    # One axis after the other: sums along lat per source longitude, then along lon.
    half = cells.join(wlat, "lat").groupBy(*others, "lon", "t_lat").agg(F.sum(F.col("w_lat") * F.col("value")).alias("v"), F.sum(F.when(there, F.col("w_lat"))).alias("g"), F.sum("w_lat").alias("w"))
    whole = half.join(wlon, "lon").groupBy(*others, F.col("t_lat").alias("lat"), F.col("t_lon").alias("lon")).agg(F.sum(F.col("w_lon") * F.col("v")).alias("v"), F.sum(F.col("w_lon") * F.col("g")).alias("g"), F.sum(F.col("w_lon") * F.col("w")).alias("w"))
    value = F.col("v") / F.col("g")
    if adaptive_masking_threshold is not None:
        value = F.when(F.col("g") / F.col("w") >= 1 - adaptive_masking_threshold - 1e-9, value)
    return whole.select(*others, "lat", "lon", value.alias("value"))


def target_cells(cells: DataFrame, grid: Grid) -> DataFrame:
    """Cells with the row and column of the target cell they fall into."""
    row = F.floor((F.col("lat") - (grid.lat0 - grid.dlat / 2)) / grid.dlat).cast("int")
    shifted = F.pmod(F.col("lon") - (grid.lon0 - grid.dlon / 2), F.lit(360.0))
    column = F.floor(shifted / grid.dlon).cast("int")
    return cells.withColumn("row", row).withColumn("col", column).filter((F.col("row") >= 0) & (F.col("row") < grid.nlat) & (F.col("col") < grid.nlon))


# ---- positions that are no axes ----------------------------------------------------------


def on_sphere(lat: str, lon: str, prefix: str) -> list[Column]:
    phi, theta = F.radians(lat), F.radians(lon)
    return [(F.cos(phi) * F.cos(theta)).alias(f"{prefix}x"), (F.cos(phi) * F.sin(theta)).alias(f"{prefix}y"), F.sin(phi).alias(f"{prefix}z")]


def nearest_positions(sources: DataFrame, targets: DataFrame) -> DataFrame:
    """(t_lat, t_lon, lat, lon, chord) of the source position nearest to each target on the sphere; ties (to 12
    digits of the chord) go to the lower lat and then lon.  sources: (lat, lon); targets: (t_lat, t_lon).

    The unit sphere lies in boxes whose side fits a few sources at first.  A target meets the sources of its own
    box and of those around it, which hold all that is within a side's length; if the nearest of these is no
    farther than that, it is the nearest of all.  The other targets, in places without sources, go on with boxes of
    four times the side, until none is left."""
    s = cut(sources.select("lat", "lon").dropna().distinct().select("lat", "lon", *on_sphere("lat", "lon", "s")), "sources")
    left = cut(targets.select("t_lat", "t_lon").dropna().distinct().select("t_lat", "t_lon", *on_sphere("t_lat", "t_lon", "t")), "targets")
    n = s.count()
    side, found = min(4.0, 2 * math.sqrt(4 * math.pi / max(1, n))), None
    axes = ("x", "y", "z")
    around = F.explode(F.array(*[F.struct(*[F.lit(d).alias(a) for a, d in zip(axes, step, strict=True)]) for step in itertools.product((-1, 0, 1), repeat=3)])).alias("d")
    while n and left.limit(1).count():
        boxed = s.select("*", *[F.floor(F.col(f"s{a}") / side).alias(f"b{a}") for a in axes])
        asked = left.select("*", around).select("*", *[(F.floor(F.col(f"t{a}") / side) + F.col(f"d.{a}")).alias(f"q{a}") for a in axes])
        square = sum(((F.col(f"s{a}") - F.col(f"t{a}")) * (F.col(f"s{a}") - F.col(f"t{a}")) for a in axes[1:]), (F.col("sx") - F.col("tx")) * (F.col("sx") - F.col("tx")))
        met = asked.join(boxed, [F.col(f"q{a}") == F.col(f"b{a}") for a in axes]).select("t_lat", "t_lon", F.struct(F.round(F.sqrt(square), 12).alias("chord"), "lat", "lon").alias("hit"))
        best = met.groupBy("t_lat", "t_lon").agg(F.min("hit").alias("hit")).filter(F.col("hit.chord") <= side)
        best = cut(best.select("t_lat", "t_lon", "hit.lat", "hit.lon", "hit.chord"), "nearest")
        found = best if found is None else found.unionByName(best)
        left, side = cut(left.join(best, ["t_lat", "t_lon"], "left_anti"), "targets"), 4 * side
    if found is None:
        return left.select("t_lat", "t_lon", F.lit(None).cast("double").alias("lat"), F.lit(None).cast("double").alias("lon"), F.lit(None).cast("double").alias("chord")).limit(0)
    return found


def regrid_scattered(cells: DataFrame, grid: str | Sequence[float] | Grid) -> DataFrame:
    """Cells whose positions are no axes (a curvilinear grid, stations) on a regular grid, by the nearest position."""
    grid = grid if isinstance(grid, Grid) else Grid.parse(grid)
    spark = cells.sparkSession
    lats = spark.createDataFrame([(x,) for x in grid.lats()], "t_lat double")
    targets = lats.withColumn("t_lon", F.explode(F.array(*[F.lit(x) for x in grid.lons()])))
    pairs = nearest_positions(cells.select("lat", "lon"), targets)
    counts = pairs.groupBy("lat", "lon").agg(F.collect_list(F.struct("t_lat", "t_lon")).alias("t"))  # of one position: a part of the grid, which has a bound
    others = [c for c in dims_of(cells) if c not in ("lat", "lon")]
    met = cells.join(counts, ["lat", "lon"]).withColumn("t", F.explode("t"))
    return met.select(*others, F.col("t.t_lat").alias("lat"), F.col("t.t_lon").alias("lon"), "value")
