"""Approximate nearest neighbours by cosine: a forest of sorted hash strings, read by longest prefixes.

A tree gives each vector a string of ``BITS`` signs of its products with seeded random vectors, and holds the
strings of a slice of rows as a sorted array.  A query goes down every tree to the rows that share the longest
prefix with it, which differs from tree to tree, and then goes up in all trees at once: at each step one bit
fewer has to match, and what is new is scored exactly on the original vectors.  Two vectors at angle a agree in a
bit with probability p = 1 - a / pi, so in none of T trees on x bits with (1 - p ** x) ** T.  The ascent ends
as soon as this, for a row as near as the k-th found so far, is at most ``MISS``; in the last step it goes up
tree by tree.  So near neighbours are found at long prefixes with few candidates, and where all are far the ascent
ends at short ones, or at the root, where every row is a candidate.  No bucket has a cap.

Rows are indexed in slices of a group (see ``_cells``), each with all trees, so that a query's candidates are met
where their vectors are; the k best go from slice to slice within a group, and groups are put together last.

Edge cases: rows with a null id or vector, a null or non-finite component, or a zero or empty vector take no
part, neither as queries nor as candidates.  Rows that share an id count once, as the least by vector.  Equal
cosines are ordered by id; equal vectors have equal strings and are all met.  Vectors of different
lengths meet as if the shorter ended in zeros.  A query without other rows gives no row.  Empty tables give
empty results; texts are not read; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm._cells import alike, best, met, usable
from gridloom.llm.hard_negatives import first

TREES, BITS, MISS, SEED = 64, 32, 0.05, 3
NEAREST = 5
#: Candidates, over all trees, at which the ascent of a query that has found nothing yet begins.
BEGIN = 64
#: Trees whose strings are made together.
TOGETHER = 8


def planes(width: int, tree: int) -> np.ndarray:
    """width x (TOGETHER * BITS) random numbers; a component's do not depend on the width."""
    return np.stack([np.random.default_rng((SEED, tree, k)).standard_normal(TOGETHER * BITS) for k in range(width)]) if width else np.zeros((0, TOGETHER * BITS))


def units(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors and their norms; vectors whose squares leave the range of doubles are scaled first."""
    with np.errstate(over="ignore"):
        norm = np.sqrt((v * v).sum(1))
    far = ~(norm < 1e150) | (norm < 1e-150)
    if far.any():
        v = v.copy()
        v[far] /= np.abs(v[far]).max(1, keepdims=True)
        norm = np.sqrt((v * v).sum(1))
    return v, norm


class Hasher:
    def __init__(self):
        self.made: dict[tuple[int, int], np.ndarray] = {}

    def strings(self, v: np.ndarray) -> np.ndarray:
        """TREES x rows: each row's string in each tree, the first bit highest."""
        out = np.empty((TREES, len(v)), np.uint64)
        weights = np.uint64(1) << np.arange(BITS - 1, -1, -1, dtype=np.uint64)
        for t in range(0, TREES, TOGETHER):
            if (v.shape[1], t) not in self.made:
                self.made[v.shape[1], t] = planes(v.shape[1], t)
            bits = (v @ self.made[v.shape[1], t] > 0).reshape(len(v), TOGETHER, BITS)
            out[t : t + TOGETHER] = (bits * weights).sum(2, dtype=np.uint64).T
        return out


def step(bits: int, trees: int) -> int:
    """How far up a query is: ``trees`` trees are read at ``bits`` bits and the others at one more."""
    return (BITS - 1 - bits) * TREES + trees


TOP = step(0, TREES)


def reach(cosine: float) -> int:
    """The step at which the ascent may end, if the k-th row so far has this cosine."""
    p = 1 - np.arccos(np.clip(cosine, -1.0, 1.0)) / np.pi
    if p >= 1:
        return step(BITS - 1, 0)
    miss = lambda x: np.log1p(-(p**x))  # noqa: E731  of one tree, as a logarithm
    x = BITS
    while x and TREES * miss(x) > np.log(MISS):
        x -= 1
    if not x:
        return step(0, 1)  # one tree at no bits reads all
    if x == BITS:
        return step(BITS - 1, 0)
    return step(x, int(np.ceil((np.log(MISS) - TREES * miss(x + 1)) / (miss(x) - miss(x + 1)))))


class Forest:
    """The sorted strings of a slice of rows."""

    def __init__(self, strings: np.ndarray):
        self.order = np.argsort(strings, axis=1, kind="stable")
        self.sorted = np.take_along_axis(strings, self.order, 1)

    def ranges(self, strings: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """TREES x queries: where the rows begin and end that share the first ``bits`` bits."""
        shift = np.uint64(BITS - bits)
        low = (strings >> shift) << shift
        high = low + (np.uint64(1) << shift)
        find = lambda x: np.stack([np.searchsorted(s, y, "left") for s, y in zip(self.sorted, x, strict=True)])
        return find(low), find(high)


class Search:
    """The nearest rows of the queries of a block."""

    def __init__(self, ids, tags, vectors, extras, k: int):
        self.ids, self.k = ids, k
        self.v, self.norm = units(vectors)
        self.hasher = Hasher()
        self.found = [(np.empty(0), np.empty(0, np.int64)) for _ in ids]

    def take(self, ids, tags, vectors) -> None:
        rows, norms = units(vectors)
        x, y = alike(self.v, rows)
        mine, forest = self.hasher.strings(x), Forest(self.hasher.strings(y))
        ranges: dict[int, tuple[np.ndarray, np.ndarray]] = {}

        def at(bits: int):
            if bits not in ranges:
                ranges[bits] = forest.ranges(mine, bits)
            return ranges[bits]

        # Down: the longest prefixes at which a query that has too few yet meets some candidates.
        begin = np.zeros(len(self.ids), int)
        open_ = np.array([len(s) < self.k for s, _ in self.found])
        for bits in range(BITS - 1, 0, -1):
            if not open_.any():
                break
            low, high = at(bits)
            ready = open_ & ((high - low).sum(0) >= BEGIN)
            begin[ready] = bits
            open_ &= ~ready
        for q in range(len(self.ids)):
            scores, found = self.found[q]
            seen = np.zeros(len(ids), bool)
            up = reach(scores[-1]) if len(scores) == self.k else step(int(begin[q]), TREES)
            while True:
                bits, trees = BITS - 1 - max(0, up - 1) // TREES, up - max(0, up - 1) // TREES * TREES
                new = np.zeros(len(ids), bool)
                for own, (low, high) in ((slice(trees), at(bits)), (slice(trees, TREES), at(bits + 1))):
                    some = [o[a:b] for o, a, b in zip(forest.order[own], low[own, q].tolist(), high[own, q].tolist(), strict=True) if a < b]
                    if some:
                        new[np.concatenate(some)] = True
                new &= ~seen & (ids != self.ids[q])
                seen |= new
                if (n := np.flatnonzero(new)).size:
                    cosine = (y[n] * x[q]).sum(1) / (norms[n] * self.norm[q])
                    hit = cosine >= (scores[-1] if len(scores) == self.k else -np.inf)
                    scores, found = best(scores, found, cosine[hit], ids[n[hit]], self.k)
                need = reach(scores[-1]) if len(scores) == self.k else TOP
                if up >= need:
                    break
                up = min(need, up + TREES)  # up, in all trees at once
            self.found[q] = scores, found

    def result(self):
        sizes = [len(s) for s, _ in self.found]
        flat = lambda p: np.concatenate([f[p] for f in self.found])
        return [pa.array(np.repeat(self.ids, sizes), pa.int64()), pa.array(flat(0), pa.float64()), pa.array(flat(1), pa.int64())]


def search(rows: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", nearest: int = NEAREST) -> DataFrame:
    """query_id, rank, vec_id, score: the nearest other rows found for each row that ``is_query`` (of the id, as
    column ``id``)."""
    rows = usable(rows, id_col, vector_col, F.lit(0)).filter((F.size("v") > 0) & ((F.array_max("v") != 0) | (F.array_min("v") != 0)))
    asks = rows.filter(is_query).withColumn("extra", F.lit(None).cast("array<bigint>"))
    found = met(rows, asks, lambda *a: Search(*a, nearest), "query long, score double, id long")
    return first(found, ["query"], "id", nearest).select(F.col("query").alias("query_id"), F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "score")
