"""Weights on uneven axes, and the nearest position on the sphere, against plain loops."""

from __future__ import annotations

import math
import random

import pytest

from gridloom.operators import regrid


def test_weights_on_uneven_axes():
    assert regrid.near([0, 1, 3, 7], [4, 5, 5.1, -9, 99, 2], False) == [(3, 4, 1.0), (3, 5, 1.0), (7, 5.1, 1.0), (0, -9, 1.0), (7, 99, 1.0), (1, 2, 1.0)]
    assert regrid.linear([0, 1, 3, 7], [2, 5, -1, 9], False) == [(1, 2, 0.5), (3, 2, 0.5), (3, 5, 0.5), (7, 5, 0.5), (0, -1, 1.0), (7, 9, 1.0)]
    assert regrid.bounds_of([-80.0, -10.0, 0.0, 40.0], False) == [(-90.0, -45.0), (-45.0, -5.0), (-5.0, 20.0), (20.0, 60.0)]
    assert regrid.bounds_of([0.0, 90.0, 200.0, 300.0], True) == [(-30.0, 45.0), (45.0, 145.0), (145.0, 250.0), (250.0, 330.0)]
    assert regrid.near([5.0], [300.0], True) == [(5.0, 300.0, 1.0)] and regrid.linear([5.0], [9.0], False) == [(5.0, 9.0, 1.0)]


def test_longitudes_in_another_frame():
    """A sector around the meridian, asked for in the 0..360 frame."""
    sector = [-10.0, 0.0, 10.0, 40.0]
    assert regrid.near(sector, [352.0, 359.0, 35.0, 200.0], True) == [(-10.0, 352.0, 1.0), (0.0, 359.0, 1.0), (40.0, 35.0, 1.0), (-10.0, 200.0, 1.0)]
    assert regrid.linear(sector, [355.0], True) == [(-10.0, 355.0, 0.5), (0.0, 355.0, 0.5)]
    assert {(s, w) for s, _, w in regrid.overlaps(sector, [350.0], 10.0, True)} == {(-10.0, 10.0)}


@pytest.mark.parametrize("seed", range(5))
def test_shared_extents_add_up(seed):
    """Against every pair; and a whole sphere's cells share all of each target."""
    r = random.Random(seed)
    lons = sorted(r.sample(range(0, 360), 25))
    lats = sorted(r.sample(range(-89, 90), 17))
    for source, targets, step, wraps in ((lons, [-174.0 + 12 * k for k in range(30)], 12.0, True), (lats, [-84.0 + 12 * k for k in range(15)], 12.0, False)):
        got = {(s, t): w for s, t, w in regrid.overlaps(source, targets, step, wraps)}
        want = {}
        for s, (a, b) in zip(source, regrid.bounds_of(source, wraps), strict=True):
            for t in targets:
                for turn in (-360, 0, 360) if wraps else (0,):
                    low, high = max(a + turn, t - step / 2), min(b + turn, t + step / 2)
                    if high - low > 1e-12:
                        size = high - low if wraps else math.sin(math.radians(high)) - math.sin(math.radians(low))
                        want[s, t] = want.get((s, t), 0) + size
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
        if wraps:
            assert all(abs(sum(w for (_, u), w in got.items() if u == t) - step) < 1e-9 for t in targets)


@pytest.mark.parametrize(("seed", "n"), [(1, 3), (2, 300), (3, 4000)])
def test_nearest_on_the_sphere(spark, seed, n):
    """Sources that are dense in one place and absent elsewhere."""
    r = random.Random(seed)
    near = [(round(50 + r.gauss(0, 3), 6), round(8 + r.gauss(0, 4), 6)) for _ in range(n)] + [(0.0, 0.0), (0.0, 90.0), (90.0, 5.0), (90.0, 200.0)]
    asks = [(-90.0, 0.0), (0.0, 45.0), (89.9, 10.0), (-10.0, 359.0)] + [(r.uniform(-90, 90), r.uniform(-180, 360)) for _ in range(120)]

    def place(lat, lon):
        a, b = math.radians(lat), math.radians(lon)
        return math.cos(a) * math.cos(b), math.cos(a) * math.sin(b), math.sin(a)

    got = {(x["t_lat"], x["t_lon"]): x for x in regrid.nearest_positions(spark.createDataFrame([*near, (None, 1.0)], "lat double, lon double"), spark.createDataFrame(asks, "t_lat double, t_lon double")).collect()}
    assert len(got) == len(asks)
    for ask in asks:
        best = min(math.dist(place(*ask), place(*s)) for s in near)
        assert abs(got[ask]["chord"] - best) < 1e-9 and abs(math.dist(place(*ask), place(got[ask]["lat"], got[ask]["lon"])) - best) < 1e-9
    none = spark.createDataFrame([], "lat double, lon double")
    assert regrid.nearest_positions(none, spark.createDataFrame(asks, "t_lat double, t_lon double")).count() == 0
