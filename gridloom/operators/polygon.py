"""Means over polygons: of the cells whose centres are inside, weighted by the cosine of latitude; or of all
that a polygon touches, weighted by the area that it has of each."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.functions.params import Grid
from gridloom.functions.scratch import cut
from gridloom.operators import regrid
from gridloom.operators.aggregate import dims_of


Ring = list[tuple[float, float]]


def edges(spark: SparkSession, shapes: dict[str, Ring | list[Ring]]) -> DataFrame:
    """(geom, x1, y1, x2, y2) of the closed rings, given as (lon, lat), of each shape: one ring or several (parts
    and holes)."""
    rows = []
    for name, rings in shapes.items():
        for ring in [rings] if isinstance(rings[0][0], (int, float)) else rings:
            ring = ring if ring[0] == ring[-1] else [*ring, ring[0]]
            rows += [(name, float(a), float(b), float(c), float(d)) for (a, b), (c, d) in zip(ring, ring[1:], strict=False)]
    return spark.createDataFrame(rows, "geom string, x1 double, y1 double, x2 double, y2 double")


def from_geojson(text: str) -> dict[str, Ring | list[Ring]]:
    """The polygons of a GeoJSON object, by name or number.  A shape with holes or several parts is one shape, and
    has all its rings; one with a single ring has that."""
    data = json.loads(text)
    out = {}
    for k, f in enumerate(data.get("features") or [data]):
        shape = f.get("geometry", f)
        polygons = [shape["coordinates"]] if shape["type"] == "Polygon" else shape["coordinates"]
        rings = [[tuple(p[:2]) for p in ring] for polygon in polygons for ring in polygon]
        out[str((f.get("properties") or {}).get("name", k))] = rings[0] if len(rings) == 1 else rings
    return out


def inside(cells: DataFrame, shapes: DataFrame) -> DataFrame:
    """(lat, lon, geom) of the distinct positions inside: an odd number of all edges of the shape lies to the
    east, so holes are outside.  Positions and edges meet in bands of a degree of latitude.  Positions
    in the 0..360 frame are tested in -180..180 too."""
    at = cells.select("lat", "lon").distinct().withColumn("band", F.floor("lat"))
    x = F.when(F.col("lon") > 180, F.col("lon") - 360).otherwise(F.col("lon"))
    banded = shapes.withColumn("band", F.explode(F.sequence(F.floor(F.least("y1", "y2")), F.floor(F.greatest("y1", "y2")))))
    crosses = ((F.col("y1") > F.col("lat")) != (F.col("y2") > F.col("lat"))) & (x < (F.col("x2") - F.col("x1")) * (F.col("lat") - F.col("y1")) / (F.col("y2") - F.col("y1")) + F.col("x1"))
    hits = at.join(banded, "band").filter(crosses)
    return hits.groupBy("lat", "lon", "geom").agg(F.count("*").alias("n")).filter("n % 2 = 1").drop("n")


def average_shape(cells: DataFrame, shapes: DataFrame) -> DataFrame:
    """One weighted mean per shape and remaining dimensions."""
    w = F.cos(F.radians("lat"))
    others = [c for c in dims_of(cells) if c not in ("lat", "lon")]
    met = cells.join(inside(cells, shapes), ["lat", "lon"])
    return met.groupBy("geom", *others).agg((F.sum(w * F.col("value")) / F.sum(F.when(F.col("value").isNotNull(), w))).alias("value"))


# ---- exact areas ---------------------------------------------------------------------------


def _cells_of(axis: str, source: list[float], wraps: bool, spark: SparkSession) -> DataFrame:
    """(axis, low, high, number) of the cells of an axis; longitudes on each turn that shapes may lie on."""
    turns = (-360.0, 0.0, 360.0) if wraps else (0.0,)
    cells = sorted((low + turn, high + turn, x) for turn in turns for x, (low, high) in zip(source, regrid.bounds_of(source, wraps), strict=True))
    return F.broadcast(spark.createDataFrame([(x, low, high, k) for k, (low, high, x) in enumerate(cells)], f"{axis} double, low double, high double, number long"))  # a few rows a position


def _bands(low: Column, high: Column) -> Column:
    return F.explode(F.sequence(F.floor(low).cast("long"), F.floor(high).cast("long")))


def oriented(spark: SparkSession, shapes: dict[str, Ring | list[Ring]]) -> DataFrame:
    """Edges as ``edges`` gives them, with rings turned so that each outer one has its area on the left and each hole on
    the right: a ring is a hole if an odd number of the shape's other rings lie around it."""
    turned: dict[str, list[Ring]] = {}
    for name, rings in shapes.items():
        rings = [list(map(tuple, r)) for r in ([rings] if isinstance(rings[0][0], (int, float)) else rings)]
        rings = [r if r[0] == r[-1] else [*r, r[0]] for r in rings]
        turned[name] = []
        for ring in rings:
            (x, y), (x2, y2) = ring[0], ring[1]
            x, y = (x + x2) / 2, (y + y2) / 2
            around = sum(sum((b > y) != (d > y) and x < (c - a) * (y - b) / (d - b) + a for (a, b), (c, d) in zip(r, r[1:], strict=False)) % 2 for r in rings if r is not ring)
            left = sum((c - a) * (b + d) for (a, b), (c, d) in zip(ring, ring[1:], strict=False)) < 0
            turned[name].append(ring if left == (around % 2 == 0) else ring[::-1])
    return edges(spark, turned)


def areas(spark: SparkSession, lats: list[float], lons: list[float], shapes: DataFrame) -> DataFrame:
    """(geom, lat, lon, area): what each shape has of each cell, on the unit sphere; straight edges in (lon, lat).
    shapes: as ``oriented`` gives them.

    An edge bounds, of each column of cells that it passes, what lies below it.  In the rows that it passes, this
    is an integral of the sine of latitude along the edge, within the row; in all rows farther south, it is the
    whole height.  The former are pieces of (edge, column, row); the latter are summed up along the column
    from north to south.  So inner cells need no edge, and the work follows the length of the border and the
    cells inside.  Edges meet columns and rows in bands of a degree."""
    columns, rows = _cells_of("lon", lons, True, spark), _cells_of("lat", lats, False, spark)
    banded = lambda df: df.withColumn("band", _bands(F.col("low"), F.col("high")))
    left, right = F.least("x1", "x2"), F.greatest("x1", "x2")
    cut_to = shapes.filter("x1 <> x2").withColumn("band", _bands(left, right)).join(banded(columns), "band").filter((left < F.col("high")) & (right > F.col("low")))
    cut_to = cut_to.dropDuplicates(["geom", "x1", "y1", "x2", "y2", "number"])
    slope = (F.col("y2") - F.col("y1")) / (F.col("x2") - F.col("x1"))
    pieces = cut_to.withColumn("a", F.greatest(left, "low")).withColumn("b", F.least(right, "high"))
    at = lambda x: F.col("y1") + slope * (F.col(x) - F.col("x1"))
    # Leftward edges of a ring with its area on the left have it below them.
    pieces = pieces.select("geom", "lon", F.col("number").alias("column"), "a", "b", at("a").alias("ya"), at("b").alias("yb"), F.when(F.col("x2") < F.col("x1"), 1.0).otherwise(-1.0).alias("sign"))
    pieces = pieces.withColumn("piece", F.struct("geom", "column", "a", "b", "ya", "yb", "sign"))
    low, high = F.least("ya", "yb"), F.greatest("ya", "yb")
    met = pieces.withColumn("band", _bands(low, high)).join(banded(rows), "band").filter((low < F.col("high")) & (high >= F.col("low")))
    met = met.dropDuplicates(["piece", "number"])
    sine = lambda c: F.sin(F.radians(c))
    # Along the piece from a to b latitude goes from ya to yb; within the row it is held to [low, high].
    rise = F.col("yb") - F.col("ya")
    share = lambda y: F.when(rise == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col(y) - F.col("ya")) / rise)))
    first, last = F.least(share("low"), share("high")), F.greatest(share("low"), share("high"))
    inside = F.when(rise == 0, sine("ya")).otherwise((F.cos(F.radians(F.col("ya") + rise * first)) - F.cos(F.radians(F.col("ya") + rise * last))) / F.radians(rise) / F.when(last > first, last - first))
    width = F.radians(F.col("b") - F.col("a"))
    above = F.when(rise == 0, F.lit(0.0)).when(rise > 0, 1 - last).otherwise(first)
    within = F.when(rise == 0, F.lit(1.0)).otherwise(last - first)
    own = F.col("sign") * width * (F.coalesce(within * (inside - sine("low")), F.lit(0.0)) + above * (sine("high") - sine("low")))
    # The southernmost row that a piece passes; all rows below it have the piece's whole width.
    by_piece = met.groupBy("piece").agg(F.min("number").alias("row"))
    passed = met.select("geom", "lon", "column", F.col("number").alias("row"), own.alias("own"), F.lit(0.0).alias("width"))
    bottoms = pieces.join(by_piece, "piece", "left").filter("row is not null").select("geom", "lon", "column", (F.col("row") - 1).alias("row"), F.lit(0.0).alias("own"), (F.col("sign") * F.radians(F.col("b") - F.col("a"))).alias("width"))
    # Pieces north of all rows bound all of them.
    north = pieces.join(by_piece, "piece", "left_anti").filter(low >= max(h for _, h in regrid.bounds_of(lats, False))).select("geom", "lon", "column", F.lit(len(lats) - 1).cast("long").alias("row"), F.lit(0.0).alias("own"), (F.col("sign") * F.radians(F.col("b") - F.col("a"))).alias("width"))
    sums = passed.unionByName(bottoms).unionByName(north).groupBy("geom", "lon", "column", "row").agg(F.sum("own").alias("own"), F.sum("width").alias("width"))
    spans = sums.groupBy("geom", "lon", "column").agg(F.max("row").alias("top"))
    dense = spans.filter("top >= 0").select("geom", "lon", "column", F.explode(F.sequence(F.lit(0).cast("long"), "top")).alias("row")).join(sums, ["geom", "lon", "column", "row"], "left")
    down = Window.partitionBy("geom", "column").orderBy(F.col("row").desc())  # one column of cells
    run = dense.withColumn("open", F.sum(F.coalesce("width", F.lit(0.0))).over(down)).join(rows, F.col("row") == F.col("number"))
    area = F.coalesce("own", F.lit(0.0)) + F.col("open") * (sine("high") - sine("low"))
    return run.groupBy("geom", "lat", "lon").agg(F.sum(area).alias("area")).filter("area > 1e-12")


def average_shape_exact(cells: DataFrame, shapes: DataFrame) -> DataFrame:
    """One mean per shape and remaining dimensions, each cell weighted by what the shape has of it."""
    spark = cells.sparkSession
    found = areas(spark, regrid.positions(cells, "lat"), regrid.positions(cells, "lon"), shapes)
    others = [c for c in dims_of(cells) if c not in ("lat", "lon")]
    met = cells.join(found, ["lat", "lon"])
    w = F.col("area")
    return met.groupBy("geom", *others).agg((F.sum(w * F.col("value")) / F.sum(F.when(F.col("value").isNotNull(), w))).alias("value"), F.sum(w).alias("area"))


def cell_edges(corners: DataFrame) -> DataFrame:
    """Edges, with the area on the left, of cells given by rows (lat, lon, corners: array of (lat, lon) structs in turn);
    ``geom`` is the cell's position.  Corners may be on any turn; they are brought next to the first one."""
    near = lambda x, first: x - 360 * F.round((x - first) / 360)
    first = F.get("corners", F.lit(0))["lon"]
    ring = F.transform("corners", lambda c: F.struct(near(c["lon"], first).cast("double").alias("x"), c["lat"].cast("double").alias("y")))
    rows = corners.select(F.struct("lat", "lon").alias("geom"), ring.alias("r")).filter("size(r) > 2")
    following = lambda k: F.get("r", F.pmod(k + 1, F.size("r")))
    pairs = F.transform("r", lambda p, k: F.struct(p["x"].alias("x1"), p["y"].alias("y1"), following(k)["x"].alias("x2"), following(k)["y"].alias("y2")))
    turned = F.aggregate(pairs, F.lit(0.0), lambda a, e: a + (e["x2"] - e["x1"]) * (e["y1"] + e["y2"]))
    each = rows.select("geom", turned.alias("turned"), F.explode(pairs).alias("e")).select("geom", "turned", "e.*")
    way = lambda a, b: F.when(F.col("turned") < 0, F.col(a)).otherwise(F.col(b))
    return each.select("geom", *[way(a, b).alias(a) for a, b in (("x1", "x2"), ("y1", "y2"), ("x2", "x1"), ("y2", "y1"))])


def regrid_cells(cells: DataFrame, corners: DataFrame, grid: Grid | str, adaptive_masking_threshold: float | None = 0.5) -> DataFrame:
    """Conservative remapping from cells of any shape: each target has its sources by the area that they share on the
    sphere.  corners: (lat, lon, corners) of each source cell, as ``cell_edges`` takes them.  A target is missing where
    more than the threshold of what its sources cover of it is missing."""
    grid = grid if isinstance(grid, Grid) else Grid.parse(grid)
    borders = cut(cell_edges(corners), "cell-edges")  # areas reads them several times
    shared = areas(cells.sparkSession, grid.lats(), grid.lons(), borders).select(F.col("geom.lat").alias("lat"), F.col("geom.lon").alias("lon"), F.col("lat").alias("t_lat"), F.col("lon").alias("t_lon"), "area")
    others = [c for c in dims_of(cells) if c not in ("lat", "lon")]
    w, there = F.col("area"), F.col("value").isNotNull()
    got = cells.join(shared, ["lat", "lon"]).groupBy(*others, F.col("t_lat").alias("lat"), F.col("t_lon").alias("lon")).agg(F.sum(w * F.col("value")).alias("v"), F.sum(F.when(there, w)).alias("g"), F.sum(w).alias("w"))
    value = F.col("v") / F.col("g")
    if adaptive_masking_threshold is not None:
        value = F.when(F.col("g") / F.col("w") >= 1 - adaptive_masking_threshold - 1e-9, value)
    return got.select(*others, "lat", "lon", value.alias("value"))
