"""Areas that shapes have of cells, against the areas of the whole rings and of rings cut by each cell."""

from __future__ import annotations

import math

import pytest

from gridloom.operators import polygon, regrid

SHAPES = {
    "triangle": [(1.3, 2.2), (33.1, -7.7), (20.2, 41.9)],
    "box on cell borders": [(-20, -10), (20, -10), (20, 15), (-20, 15)],
    "hole": [[(10, -40), (60, -40), (60, 40), (10, 40)], [(20, -20), (40, -20), (40, 20), (20, 20)]],
    "island in a hole": [[(100, 0), (160, 0), (160, 50), (100, 50)], [(150, 10), (110, 10), (110, 40), (150, 40)], [(120, 20), (130, 20), (130, 30)]],
    "two parts": [[(-100, 0), (-90, 0), (-95, 9)], [(-70, 0), (-60, 0), (-65, 9)]],
    "cap": [(-30, 80), (50, 80), (20, 90), (-10, 90)],
    "within a cell": [(1.1, 1.1), (1.3, 1.2), (1.2, 1.4)],
    "star": [(100, -80), (110, -50), (130, -70), (115, -85), (140, -89), (105, -88)],
}


def ring_area(ring):
    total = 0.0
    for (x1, y1), (x2, y2) in zip(ring, [*ring[1:], ring[0]], strict=True):
        a, b = math.radians(y1), math.radians(y2)
        total -= math.radians(x2 - x1) * (math.sin(a) if abs(b - a) < 1e-15 else (math.cos(a) - math.cos(b)) / (b - a))
    return total


def clipped(ring, axis, bound, keep):
    """A ring cut by a half-plane."""
    out = []
    for p, q in zip(ring, [*ring[1:], *ring[:1]], strict=True):
        if keep(p[axis], bound):
            out.append(p)
        if keep(p[axis], bound) != keep(q[axis], bound):
            t = (bound - p[axis]) / (q[axis] - p[axis])
            out.append(tuple(a + t * (b - a) for a, b in zip(p, q, strict=True)))
    return out


SIGNS = {"hole": [1, -1], "island in a hole": [1, -1, 1]}


def shape_area(name, cut=lambda ring: ring):
    rings = SHAPES[name] if isinstance(SHAPES[name][0], list) else [SHAPES[name]]
    return sum(s * abs(ring_area(r)) for s, ring in zip(SIGNS.get(name, [1] * len(rings)), rings, strict=True) if len(r := cut(ring)) > 2)


@pytest.mark.parametrize(("lats", "lons"), [([-87.5 + 5 * k for k in range(36)], [2.5 + 5 * k for k in range(72)]), ([-85.0, -60.0, -30.0, -5.0, 0.0, 11.0, 45.0, 80.0], [-170.0 + 20 * k for k in range(18)])])
def test_pieces(spark, lats, lons):
    got = {(r["geom"], r["lat"], r["lon"]): r["area"] for r in polygon.areas(spark, lats, lons, polygon.oriented(spark, SHAPES)).collect()}
    at, across = regrid.bounds_of(lats, False), regrid.bounds_of(lons, True)
    for name in SHAPES:
        if at[0][0] == -90 and at[-1][1] == 90:
            assert abs(sum(a for (n, _, _), a in got.items() if n == name) - shape_area(name)) < 1e-9
        for lat, (c, d) in zip(lats, at, strict=True):
            for lon, (a, b) in zip(lons, across, strict=True):
                want = 0.0
                for turn in (-360, 0, 360):
                    cut = lambda ring: clipped(clipped(clipped(clipped(ring, 0, a + turn, lambda p, q: p >= q), 0, b + turn, lambda p, q: p <= q), 1, c, lambda p, q: p >= q), 1, d, lambda p, q: p <= q)  # noqa: B023, E731
                    want += shape_area(name, cut)
                assert abs(got.get((name, lat, lon), 0.0) - want) < 1e-9


def test_mean(spark):
    """A field that is 1 north and 3 south of the equator, and is missing in places."""
    rows = [("d", "v", lat, lon, None if lon == 2.5 else 1.0 if lat > 0 else 3.0) for lat in (-7.5, -2.5, 2.5, 7.5) for lon in (2.5, 7.5, 12.5)]
    cells = spark.createDataFrame(rows, "dataset_id string, variable string, lat double, lon double, value double")
    got = polygon.average_shape_exact(cells, polygon.oriented(spark, {"x": [(1.0, -5.0), (9.0, -5.0), (9.0, 10.0), (1.0, 10.0)]})).first()
    s = lambda x: math.sin(math.radians(x))
    assert abs(got["value"] - (s(10) + 3 * s(5)) / (s(10) + s(5))) < 1e-9
    assert abs(got["area"] - math.radians(8) * (s(10) + s(5))) < 1e-9
