"""Request parameters: text or lists in, predicates on cell columns out.

A predicate is written so that Parquet statistics can use it: plain comparisons of columns with
literals, also where a calendar component or another longitude frame is asked for.
"""

from __future__ import annotations

import calendar
import re
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bounds used where one side of a time search is open.
FIRST_TIME, LAST_TIME = "0001-01-01T00:00:00", "9999-12-30T00:00:00"
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")


def stamp(text: str) -> Column:
    return F.lit(text.replace("T", " ")).cast("timestamp_ntz")


def widen(text: str, upper: bool) -> str:
    """A partial ISO date as the first or last second it stands for."""
    day, _, clock = text.strip().replace(" ", "T").partition("T")
    parts = [int(p) for p in day.split("-")]
    year = parts[0]
    month = parts[1] if len(parts) > 1 else (12 if upper else 1)
    date = parts[2] if len(parts) > 2 else (calendar.monthrange(year, month)[1] if upper else 1)
    given = clock.split(":") if clock else []
    rest = ["23", "59", "59"] if upper else ["00", "00", "00"]
    return f"{year:04d}-{month:02d}-{date:02d}T" + ":".join([*given, *rest[len(given) :]])


@dataclass(frozen=True)
class Time:
    """An interval (either side may be open), or a list of points, or everything."""

    start: str | None = None
    end: str | None = None
    points: tuple[str, ...] = ()

    @classmethod
    def parse(cls, value: str | Sequence[str] | None) -> Time:
        if not value:
            return cls()
        if isinstance(value, str) and "/" in value:
            low, _, high = value.partition("/")
            return cls(widen(low, False) if low.strip() else None, widen(high, True) if high.strip() else None)
        points = value.split(",") if isinstance(value, str) else list(value)
        return cls(points=tuple(widen(p, False) for p in points))

    def where(self, column: str = "time") -> Column:
        c = F.col(column)
        if self.points:
            return c.isin([stamp(p) for p in self.points])
        tests = [c >= stamp(self.start)] * bool(self.start) + [c <= stamp(self.end)] * bool(self.end)
        return reduce(Column.__and__, tests, F.lit(True))


@dataclass(frozen=True)
class Components:
    """Values asked for per calendar component; all components must hold."""

    year: tuple[int, ...] = ()
    month: tuple[int, ...] = ()
    day: tuple[int, ...] = ()
    hour: tuple[int, ...] = ()

    @classmethod
    def parse(cls, value: str | dict | None) -> Components:
        if not value:
            return cls()
        if isinstance(value, str):
            pairs = [re.split(r"[:=]", part, maxsplit=1) for part in value.split("|") if part.strip()]
            value = {k.strip(): v.split(",") for k, v in pairs}
        number = lambda v: MONTHS.index(str(v).strip().lower()[:3]) + 1 if str(v).strip()[:1].isalpha() else int(v)
        return cls(**{k: tuple(sorted({number(v) for v in vs})) for k, vs in value.items()})

    def needed(self, time: Time) -> Components:
        """Without components that say nothing: all months, all days, or years that cover the interval."""
        month = () if set(self.month) >= set(range(1, 13)) else self.month
        day = () if set(self.day) >= set(range(1, 32)) else self.day
        year = self.year
        if year and time.start and time.end and set(year) >= set(range(int(time.start[:4]), int(time.end[:4]) + 1)):
            year = ()
        return Components(year, month, day, self.hour)

    def narrow(self, time: Time) -> Time:
        """The interval cut to the span of the years asked for; unchanged where they don't meet."""
        if not self.year or time.points:
            return time
        low, high = f"{min(self.year):04d}-01-01T00:00:00", f"{max(self.year):04d}-12-31T23:59:59"
        low, high = max(low, time.start or low), min(high, time.end or high)
        return Time(low, high) if low <= high else time

    def where(self, column: str = "time") -> Column:
        """The components, plus the range of the years, which a scan can use."""
        c, tests = F.col(column), []
        for name, of in (("year", F.year), ("month", F.month), ("day", F.dayofmonth), ("hour", F.hour)):
            if wanted := getattr(self, name):
                tests.append(of(c).isin(list(wanted)))
        if self.year:
            tests += [c >= stamp(f"{min(self.year):04d}-01-01T00:00:00"), c < stamp(f"{max(self.year) + 1:04d}-01-01T00:00:00")]
        return reduce(Column.__and__, tests, F.lit(True))


@dataclass(frozen=True)
class Area:
    """lon0, lat0, lon1, lat1, inclusive; lon0 > lon1, or bounds outside the data's frame, wrap."""

    lon0: float
    lat0: float
    lon1: float
    lat1: float

    @classmethod
    def parse(cls, value: str | Sequence[float] | None) -> Area | None:
        if not value:
            return None
        a, b, c, d = (float(x) for x in (value.split(",") if isinstance(value, str) else value))
        return cls(a, max(-90.0, min(b, d)), c, min(90.0, max(b, d)))

    def ranges(self, frame: int) -> list[tuple[float, float]]:
        """Longitude ranges in the data's frame (360: 0..360, 180: -180..180)."""
        low = 0.0 if frame == 360 else -180.0
        width = self.lon1 - self.lon0 if self.lon1 >= self.lon0 else self.lon1 - self.lon0 + 360
        if width >= 360:
            return [(low, low + 360)]
        a = (self.lon0 - low) % 360 + low
        b = a + width
        return [(a, b)] if b < low + 360 else [(a, low + 360), (low, b - 360)]

    def where(self, frame: int = 360, lat: str = "lat", lon: str = "lon") -> Column:
        spans = [(F.col(lon) >= a) & (F.col(lon) <= b) for a, b in self.ranges(frame)]
        return (F.col(lat) >= self.lat0) & (F.col(lat) <= self.lat1) & reduce(Column.__or__, spans)

    def longitude(self, lon: str = "lon") -> Column:
        """Longitude in the frame that was asked for."""
        c = F.col(lon)
        low = self.lon0 if self.lon0 <= self.lon1 else self.lon0 - 360
        return F.when(c > self.lon1, c - 360).when(c < low, c + 360).otherwise(c)


@dataclass(frozen=True)
class Levels:
    low: float | None = None
    high: float | None = None
    values: tuple[float, ...] = ()

    @classmethod
    def parse(cls, value: str | Iterable[float] | None) -> Levels:
        if not value:
            return cls()
        if isinstance(value, str) and "/" in value:
            a, b = (float(x) for x in value.split("/"))
            return cls(min(a, b), max(a, b))
        return cls(values=tuple(float(x) for x in (value.split(",") if isinstance(value, str) else value)))

    def where(self, column: str = "level") -> Column:
        if self.values:
            return F.col(column).isin(list(self.values))
        return F.col(column).between(self.low, self.high) if self.low is not None else F.lit(True)


#: Step in degrees (lon, lat) of the named grids (fixed values).
NAMED_GRIDS = {
    "0pt25deg": (0.25, 0.25),
    "0pt25deg_era5": (0.25, 0.25),
    "0pt5deg_lsm": (0.5, 0.5),
    "0pt625x0pt5deg": (0.625, 0.5),
    "0pt75deg": (0.75, 0.75),
    "1deg": (1.0, 1.0),
    "1pt25deg": (1.25, 1.25),
    "2pt5deg": (2.5, 2.5),
}


@dataclass(frozen=True)
class Grid:
    """A regular target grid of cell centres: first centre, step and count per axis."""

    lon0: float
    dlon: float
    nlon: int
    lat0: float
    dlat: float
    nlat: int

    @classmethod
    def parse(cls, value: str | Sequence[float], own: tuple[float, float] | None = None) -> Grid:
        """Numbers: d | dlon dlat | lo hi d | lon0 lon1 dlon lat0 lat1 dlat; or a name; ``auto`` takes ``own``."""
        if isinstance(value, str) and value in NAMED_GRIDS:
            value = NAMED_GRIDS[value]
        elif value == "auto":
            if own is None:
                raise ValueError("grid auto needs the source's own resolution")
            value = own
        numbers = [float(x) for x in (re.split(r"[,\s]+", value.strip()) if isinstance(value, str) else value)]
        if len(numbers) == 1:
            numbers = [-180, 180, numbers[0], -90, 90, numbers[0]]
        elif len(numbers) == 2:
            numbers = [-180, 180, numbers[0], -90, 90, numbers[1]]
        elif len(numbers) == 3:
            numbers = numbers * 2
        elif len(numbers) != 6:
            raise ValueError(f"a grid takes 1, 2, 3 or 6 numbers, not {len(numbers)}")
        a, b, dx, c, d, dy = numbers
        if dx <= 0 or dy <= 0 or b <= a or d <= c:
            raise ValueError("a grid needs rising bounds and positive steps")
        return cls(a + dx / 2, dx, round((b - a) / dx), max(-90.0, c) + dy / 2, dy, round((min(90.0, d) - max(-90.0, c)) / dy))

    def lats(self) -> list[float]:
        return [self.lat0 + k * self.dlat for k in range(self.nlat)]

    def lons(self) -> list[float]:
        return [self.lon0 + k * self.dlon for k in range(self.nlon)]


@dataclass(frozen=True)
class Selection:
    """Everything a subset may ask for."""

    time: Time = field(default_factory=Time)
    components: Components = field(default_factory=Components)
    area: Area | None = None
    level: Levels = field(default_factory=Levels)

    @classmethod
    def parse(cls, time=None, time_components=None, area=None, level=None) -> Selection:
        t = Time.parse(time)
        return cls(t, Components.parse(time_components).needed(t), Area.parse(area), Levels.parse(level))
