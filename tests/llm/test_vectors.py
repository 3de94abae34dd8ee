"""Hard negatives and the hash forest against plain loops, on awkward vectors."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm import _cells, hard_negatives, hash_forest

from ..conftest import DATA

SCHEMA = "vec_id long, embedding array<double>, label int, id long, tag string, extra array<long>, rank int, score string"


def awkward(seed: int, n: int, hot: int) -> list[tuple[int | None, list | None, int | None]]:
    r = random.Random(seed)
    make = lambda: [r.gauss(0, 0.15) for _ in range(24)]
    common = make()
    rows = [(k, make(), r.randrange(3)) for k in range(n)]
    rows += [(n + k, list(common), k % 3) for k in range(hot)]  # equal vectors, also at 0, 50 and 100 of the ids
    rows += [(2 * n + k, [x + r.gauss(0, 0.01) for x in common], 1) for k in range(20)]
    nan, inf = float("nan"), float("inf")
    rows += [(-100, make(), 0), (-7, make(), 0), (None, make(), 1), (9000, None, 1), (9100, make(), None), (9200, [0.1, None, 0.2], 1), (9300, [nan] * 24, 1), (9400, [0.1, -inf], 1)]
    rows += [(9500, [0.0] * 24, 0), (9600, [], 0), (9700, [0.5, -0.5], 1), (9800, [0.5, -0.5] + [0.0] * 22, 1)]
    rows += [rows[0], rows[0], (50, make(), 0)]  # a repeated row, and an id with another vector
    return rows


def taking_part(rows, zero: bool):
    """One row an id, the least by label and vector where the operator reads labels."""
    good = [(i, lab, v) for i, v, lab in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and (zero or lab is not None) and (zero is False or any(v))]
    out = {}
    for i, lab, v in good:
        key = ((lab,) if not zero else ()) + tuple(v)
        if i not in out or key < out[i][0]:
            out[i] = (key, lab, v)
    return {i: (lab, v) for i, (_, lab, v) in out.items()}


def plain_negatives(rows, changed):
    rows = {i: (changed(i, lab), [math.floor(256 * x) for x in v]) for i, (lab, v) in taking_part(rows, False).items()}
    out = []
    for a, (lab, v) in rows.items():
        if a % 100:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w, strict=False)), i) for i, (_, w) in rows.items() if i != a)
        for s, i in [(s, i) for s, i in scored if rows[i][0] == lab][:5]:
            fits = [(t, j) for t, j in scored if rows[j][0] != lab and 80 * -s <= 100 * -t <= 100 * -s][:5]
            out += [(a, i, k, j, -s, -t) for k, (t, j) in enumerate(fits, 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def frame(spark):
    def make(rows):
        return spark.createDataFrame([(i, v, lab, 1, "t", [1], 2, "s") for i, v, lab in rows], SCHEMA).repartition(3)

    return make


@pytest.mark.parametrize(("seed", "n", "hot"), [(1, 130, 0), (2, 60, 120)])
def test_hard_negatives(frame, seed, n, hot):
    rows = awkward(seed, n, hot)
    changed = lambda i, lab: int(math.fmod(lab + 1, 10)) if i % 7 == 0 else lab
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    # Rows that share an id: the changed label counts, as in the operator.
    got = hard_negatives.mine(frame(rows), F.col("id") % 100 == 0, label).collect()
    assert sorted(map(tuple, got)) == plain_negatives(rows, changed)
    assert got[0].asDict().keys() == {"anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"}


def test_hard_negatives_in_many_cells(frame, monkeypatch):
    """Small blocks, groups, slices and tiles give the same rows."""
    rows = awkward(3, 300, 100)
    label = F.col("label")
    whole = sorted(map(tuple, hard_negatives.mine(frame(rows), F.col("id") % 20 == 0, label).collect()))
    for name, value in (("BLOCK", 7), ("LEAST", 20), ("SLICE", 16)):
        monkeypatch.setattr(_cells, name, value)
    assert sorted(map(tuple, hard_negatives.mine(frame(rows), F.col("id") % 20 == 0, label).collect())) == whole


def test_bounds_hold():
    """Every level's bounds hold the exact product, and the last ones are narrower than the first."""
    r = np.random.default_rng(4)
    a, b = (hard_negatives.scaled(r.normal(0.1, 0.3, (40, 64)) * r.uniform(0, 2, (40, 1))) for _ in "ab")
    a[0], b[0] = 0, 5
    exact = hard_negatives.products(a, b)
    cols, widths = np.arange(40), []
    levels = hard_negatives.Summary(a).bounds(np.arange(40), hard_negatives.Summary(b), cols)
    bounds = next(levels)
    while bounds is not None:
        lower, upper = bounds
        assert (lower <= exact).all() and (exact <= upper).all()
        widths.append((upper - lower).mean())
        try:
            bounds = levels.send(cols)
        except StopIteration:
            bounds = None
    assert len(widths) == 3 and widths == sorted(widths, reverse=True)


def test_products_beyond_doubles():
    a, b = np.array([[2.0**30, 3.0, -1.0]]), np.array([[2.0**29 + 1, 1.0, 1.0], [2.0**40, 0.0, 0.0], [2.0**62, 0.0, 0.0]])
    assert hard_negatives.products(a, b[:1]).tolist() == [[2**59 + 2**30 + 2]]
    assert hard_negatives.products(a, b).tolist() == [[2**59 + 2**30 + 2, 2**63 - 1, 2**63 - 1]]


def test_no_vectors(frame):
    empty = frame(awkward(1, 3, 0)).limit(0)
    assert hard_negatives.mine(empty, F.col("id") % 100 == 0, F.col("label")).count() == 0
    assert hash_forest.search(empty, F.col("id") % 50 == 0).count() == 0
    one = frame([(0, [1.0, 2.0], 1)])
    assert hard_negatives.mine(one, F.col("id") == 0, F.col("label")).count() == 0
    assert hash_forest.search(one, F.col("id") == 0).count() == 0
    assert hash_forest.search(one, F.col("id") == 5).count() == 0


def plain_nearest(rows, of):
    rows = taking_part(rows, True)
    ids = sorted(rows)
    width = max(len(v) for _, v in rows.values())
    x = np.array([list(v) + [0.0] * (width - len(v)) for _, v in (rows[i] for i in ids)])
    norm = np.sqrt((x * x).sum(1))
    out = {}
    for k, i in enumerate(ids):
        if i % of == 0:
            scores = (x * x[k]).sum(1) / (norm * norm[k])
            out[i] = sorted((-s, j) for s, j in zip(scores.tolist(), ids, strict=True) if j != i)[:5]
    return out


def recall(got, want):
    found = {(r["query_id"], r["vec_id"]) for r in got}
    pairs = [(q, j) for q, near in want.items() for _, j in near]
    return sum(p in found for p in pairs) / len(pairs)


@pytest.mark.parametrize(("seed", "n", "hot"), [(1, 400, 0), (2, 100, 150)])
def test_hash_forest(frame, seed, n, hot):
    rows = awkward(seed, n, hot)
    got = hash_forest.search(frame(rows), F.col("id") % 10 == 0).collect()
    want = plain_nearest(rows, 10)
    assert recall(got, want) >= 0.9
    vectors = {i: np.array(v) for i, (_, v) in taking_part(rows, True).items()}
    for q in want:
        own = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(1, 6))
        assert [(-r["score"], r["vec_id"]) for r in own] == sorted((-r["score"], r["vec_id"]) for r in own)
        for r in own:
            a, b = vectors[q], vectors[r["vec_id"]]
            k = min(len(a), len(b))
            assert abs(r["score"] - (a[:k] @ b[:k]) / math.sqrt((a @ a) * (b @ b))) < 1e-12
            assert r["vec_id"] != q


def test_hash_forest_far_numbers(frame):
    """Squares that leave the range of doubles."""
    rows = [(k, [x * 10.0 ** (200 if k % 2 else -200) for x in (1.0, k, 3.0)], 0) for k in range(12)]
    got = hash_forest.search(frame(rows), F.col("id") == 0).collect()
    assert [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"])] == [1, 2, 3, 4, 5]
    assert all(0 < r["score"] <= 1 + 1e-12 for r in got)


def test_hash_forest_in_small_cells(frame, monkeypatch):
    rows = awkward(5, 500, 60)
    for name, value in (("BLOCK", 9), ("LEAST", 100), ("SLICE", 64)):
        monkeypatch.setattr(_cells, name, value)
    assert recall(hash_forest.search(frame(rows), F.col("id") % 10 == 0).collect(), plain_nearest(rows, 10)) >= 0.9


def test_hash_forest_recall_on_given_vectors(spark):
    """Vectors without any structure, the hardest case."""
    df = spark.read.parquet(f"{DATA}/sf0.1/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"], 0) for r in df.collect()]
    assert recall(hash_forest.search(df, F.col("id") % 50 == 0).collect(), plain_nearest(rows, 50)) >= 0.93


def test_ascent_ends_as_stated():
    """The step of ``reach`` is the first at which a row of that cosine is missed with probability MISS at most."""
    def missed(cosine, up):
        bits, trees = hash_forest.BITS - 1 - max(0, up - 1) // hash_forest.TREES, up - max(0, up - 1) // hash_forest.TREES * hash_forest.TREES
        p = 1 - math.acos(cosine) / math.pi
        return (1 - p**bits) ** trees * (1 - p ** (bits + 1)) ** (hash_forest.TREES - trees)

    for cosine in (-0.9, 0.0, 0.3, 0.5, 0.8, 0.95, 0.99):
        up = hash_forest.reach(cosine)
        assert missed(cosine, up) <= hash_forest.MISS + 1e-9
        assert up <= 1 or missed(cosine, up - 1) > hash_forest.MISS - 1e-9
