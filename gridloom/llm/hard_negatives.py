"""Hard negatives by exact inner products, with a filter of segment summaries.

A vector is cut into segments of its components, and of each the mean and the deviation are kept.  For two
segments of w components the inner product lies within w * (mean * mean +- deviation * deviation), so the
sums over segments bound the whole.  Segments are refined from one to four to sixteen; a pair goes on to the
next level, and at last to the exact product, only while its bounds leave it a place among an anchor's best
(for positives), or within reach of some positive's window (for negatives).  Two rounds: each anchor's nearest
rows of its own label, then the nearest rows of other labels below each of these.

Edge cases: rows with a null id, label or vector, or a component that is null or not finite, take no part.
Rows that share an id count once, as the least by label and vector; so repeated rows change nothing.  Equal
scores are ordered by id.  Vectors of different lengths meet as if the shorter ended in zeros; an empty one has
product 0 with all.  Products are exact integers; beyond 64 bits they are held to the largest long.  An anchor
without positives, or a positive without negatives in reach, gives no row.  A positive of negative score has no
window.  Empty tables give empty results; texts are not read; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm._cells import alike, best, met, usable
from gridloom.llm._common import cut

SCALE, POSITIVES, NEGATIVES, REACH = 256, 5, 5, (80, 100)
#: Segments of a level; those with less than two components a segment are left out.
LEVELS = (1, 4, 16)
#: What rounding may add to a bound, as a part of the product of the norms.
ROUNDING = 1e-6
#: Anchors that are scored together.
TILE = 128
_MOST = 2**63 - 1


def scaled(v: np.ndarray, scale: int = SCALE) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.floor(np.clip(scale * v, -(2.0**62), 2.0**62))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows of whole numbers, as exact longs."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if most < 2**53:
        return (a @ b.T).astype(np.int64)
    if most < 2**62:
        return a.astype(np.int64) @ b.astype(np.int64).T
    whole = lambda x: np.array([[int(y) for y in row] for row in x], object).reshape(x.shape)
    return np.clip(whole(a) @ whole(b).T, -_MOST, _MOST).astype(np.int64)


class Summary:
    """Per level, means and deviations of the segments, each times the root of its number of components."""

    def __init__(self, x: np.ndarray):
        self.levels = []
        for count in (c for c in LEVELS if 2 * c <= x.shape[1]):
            starts = np.arange(count) * x.shape[1] // count
            size = np.diff(np.append(starts, x.shape[1]))
            mean = np.add.reduceat(x, starts, 1) / size
            square = np.add.reduceat(x * x, starts, 1) / size
            self.levels.append((mean * np.sqrt(size), np.sqrt(np.maximum(square - mean * mean, 0)) * np.sqrt(size)))
        self.norm = np.sqrt((x * x).sum(1))

    def bounds(self, rows: np.ndarray, other: Summary, cols: np.ndarray):
        """Of each level, (lower, upper) bounds of the products of ``rows`` with the other's ``cols``, which the
        caller narrows between levels."""
        for (m, d), (n, e) in zip(self.levels, other.levels, strict=True):
            middle, wide = m[rows] @ n[cols].T, d[rows] @ e[cols].T
            wide += ROUNDING * (self.norm[rows][:, None] * other.norm[cols][None, :] + 1)
            cols = yield middle - wide, middle + wide


def survivors(asks: Summary, tile: np.ndarray, rows: Summary, ok: np.ndarray, low: np.ndarray, high: np.ndarray | None):
    """(columns, mask) of the pairs of tile x rows whose bounds reach [low, high]; ok is the mask to start from."""
    cols = np.flatnonzero(ok.any(0))
    ok = ok[:, cols]
    levels = asks.bounds(tile, rows, cols)
    bounds = next(levels, None)
    while bounds is not None and len(cols):
        lower, upper = bounds
        ok &= upper >= low[:, None]
        if high is not None:
            ok &= lower <= high[:, None]
        keep = ok.any(0)
        cols, ok = cols[keep], ok[:, keep]
        try:
            bounds = levels.send(cols)
        except StopIteration:
            break
    return cols, ok


class Nearest:
    """Each anchor's first rows of its own label."""

    def __init__(self, ids, tags, vectors, extras, k: int, scale: int):
        self.ids, self.tags, self.k, self.scale = ids, tags, k, scale
        self.x = scaled(vectors, scale)
        self.found = [(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in ids]

    def least(self) -> np.ndarray:
        """The score that a row must reach, per anchor."""
        return np.array([s[-1] if len(s) == self.k else -np.inf for s, _ in self.found], float)

    def take(self, ids, tags, vectors) -> None:
        x, y = alike(self.x, scaled(vectors, self.scale))
        mine, theirs = Summary(x), Summary(y)
        low = self.least()
        for at in range(0, len(self.ids), TILE):
            tile = np.arange(at, min(at + TILE, len(self.ids)))
            ok = (self.tags[tile][:, None] == tags[None, :]) & (self.ids[tile][:, None] != ids[None, :])
            cols, ok = survivors(mine, tile, theirs, ok, low[tile], None)
            scores = products(x[tile], y[cols])
            for k, a in enumerate(tile):
                if (some := np.flatnonzero(ok[k] & (scores[k] >= low[a]))).size:
                    self.found[a] = best(*self.found[a], scores[k][some], ids[cols[some]], self.k)

    def result(self):
        sizes = [len(s) for s, _ in self.found]
        flat = lambda p: pa.array(np.concatenate([f[p] for f in self.found]), pa.int64())
        return [pa.array(np.repeat(self.ids, sizes), pa.int64()), flat(0), flat(1)]


class Windowed:
    """Each anchor's first rows of other labels at or below each of its positives' scores (in ``extras``)."""

    def __init__(self, ids, tags, vectors, extras, k: int, scale: int, reach: tuple[int, int]):
        self.ids, self.tags, self.k, self.scale = ids, tags, k, scale
        self.x = scaled(vectors, scale)
        self.low, self.high = reach
        self.caps = [sorted(c for c in caps if c >= 0) for caps in extras]
        self.found = [[(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in caps] for caps in self.caps]

    def take(self, ids, tags, vectors) -> None:
        x, y = alike(self.x, scaled(vectors, self.scale))
        mine, theirs = Summary(x), Summary(y)
        least = lambda cap, f: max(self.low * cap / self.high, float(f[0][-1]) if len(f[0]) == self.k else -np.inf)
        low = np.array([min((least(c, f) for c, f in zip(caps, found, strict=True)), default=np.inf) for caps, found in zip(self.caps, self.found, strict=True)])
        high = np.array([float(caps[-1]) if caps else -np.inf for caps in self.caps])
        for at in range(0, len(self.ids), TILE):
            tile = np.arange(at, min(at + TILE, len(self.ids)))
            cols, ok = survivors(mine, tile, theirs, self.tags[tile][:, None] != tags[None, :], low[tile] * (1 - 1e-12) - 1, high[tile] * (1 + 1e-12) + 1)
            scores = products(x[tile], y[cols])
            for k, a in enumerate(tile):
                some = np.flatnonzero(ok[k] & (scores[k] >= low[a] * (1 - 1e-12) - 1) & (scores[k] <= high[a] * (1 + 1e-12) + 1))
                if not some.size:
                    continue
                own, own_ids = scores[k][some], ids[cols[some]]
                for c, cap in enumerate(self.caps[a]):
                    # low * cap <= high * score, without leaving 64 bits: the least such score.
                    fits = (own <= cap) & (own >= -(-self.low * cap // self.high))
                    if fits.any():
                        self.found[a][c] = best(*self.found[a][c], own[fits], own_ids[fits], self.k)

    def result(self):
        flat = [(i, cap, s, v) for i, caps, found in zip(self.ids, self.caps, self.found, strict=True) for cap, f in zip(caps, found, strict=True) for s, v in zip(*f, strict=True)]
        return [pa.array([int(r[p]) for r in flat], pa.int64()) for p in range(4)]


def first(df: DataFrame, of: list[str], by: str, k: int) -> DataFrame:
    """Rank (from 1) of each row among those of ``of``, by descending score and then ``by``; ranks to k."""
    order = Window.partitionBy(*of).orderBy(F.col("score").desc(), by)
    return df.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def mine(rows: DataFrame, is_anchor: Column, label: Column, id_col: str = "vec_id", vector_col: str = "embedding", positives: int = POSITIVES, negatives: int = NEGATIVES, scale: int = SCALE, reach: tuple[int, int] = REACH) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each row that ``is_anchor`` (of
    the id, as column ``id``) and each of its first positives the first rows of another label whose score is between
    reach[0] / reach[1] of the positive's and the positive's."""
    rows = usable(rows, id_col, vector_col, label)
    anchors = rows.filter(is_anchor)
    near = met(rows, anchors.withColumn("extra", F.lit(None).cast("array<bigint>")), lambda *a: Nearest(*a, positives, scale), "anchor long, score long, id long")
    near = cut(first(near, ["anchor"], "id", positives).select("anchor", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    caps = near.groupBy("anchor").agg(F.collect_set("positive_score").alias("extra"))  # as many as positives at most
    asking = anchors.join(caps, anchors["id"] == caps["anchor"]).select("id", "tag", "v", "extra")
    far = met(rows, asking, lambda *a: Windowed(*a, negatives, scale, reach), "anchor long, cap long, score long, id long")
    far = first(far, ["anchor", "cap"], "id", negatives)
    both = near.join(far.withColumnRenamed("anchor", "a"), (F.col("anchor") == F.col("a")) & (F.col("positive_score") == F.col("cap")))
    return both.select(F.col("anchor").alias("anchor_id"), "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
