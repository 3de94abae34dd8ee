"""The pipeline against its stages' brute-force decisions, on the smallest tables."""

from __future__ import annotations

from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from gridloom.llm import mixing, queries

from ..conftest import DATA
from ..test_queries import rows
from .test_operators import counts, groups, hits

FOLDER = f"{DATA}/sf0.001"


def test_pipeline(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    stages = dict(corpus_pipeline.STAGES)
    every = docs.collect()
    good = stages["quality_rules"](spark, docs, FOLDER)
    assert good.columns == docs.columns
    base = {r["doc_id"] for r in every if (c := counts(r["text"]))[0] >= 50 and 2 * c[4] <= c[0]}
    ids = {r["doc_id"] for r in good.collect()}
    assert ids <= base and len(base - ids) <= 0.1 * len(base)
    label = groups([(r["doc_id"], r["text"], None) for r in good.collect()])
    single = stages["near_copies"](spark, good, FOLDER)
    assert {r["doc_id"] for r in single.collect()} == {i for i in label if label[i] == i}
    clean = stages["decontamination"](spark, single, FOLDER)
    want = {r["doc_id"] for r in single.collect() if not (h := hits(r["text"], items))[1] or 20 * h[1] < h[0]}
    assert {r["doc_id"] for r in clean.collect()} == want
    mixed = stages["mixing"](spark, clean, FOLDER).cache()
    sizes = Counter()
    for r in clean.collect():
        sizes[r["source"]] += counts(r["text"])[0]
    taken = Counter()
    for r in mixed.collect():
        taken[r["source"]] += counts(r["text"])[0]
    most = max(counts(r["text"])[0] for r in clean.collect())
    assert all(abs(taken[s] - t) <= most for s, t in mixing.targets(dict(sizes)).items())
    out = stages["sharding"](spark, mixed, FOLDER)
    assert Counter(r["doc_id"] for r in out.collect()) == Counter(r["doc_id"] for r in mixed.collect())
    assert corpus_pipeline.run(spark, FOLDER).count() == out.count()


EXTRA = ("bad_id", "row", "count", "size", "shard", "slot", "label", "h1", "x", "votes", "kept", "copies", "target")


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stage_edges(spark, texts, name):
    """Each stage by itself: nulls in any column, empty and very long texts, ties, repeated rows, further columns with
    clashing names, and an empty table."""
    stage = dict(corpus_pipeline.STAGES)[name]
    some = [*texts, (None, None, None), (50, None, "s0"), *texts[-3:]]
    wide = ", ".join(f"{c} string" for c in EXTRA)
    docs = spark.createDataFrame([(i, t, None, s, None, *["z"] * len(EXTRA)) for i, t, s in some], f"doc_id long, text string, lang string, source string, n_chars long, {wide}").repartition(3)
    out = stage(spark, docs, FOLDER)
    assert set(out.columns) >= set(docs.columns)
    assert out.columns == docs.columns or name == corpus_pipeline.STAGES[-1][0]
    got = Counter((r["doc_id"], r["text"]) for r in out.collect())
    have = Counter((i, t) for i, t, _ in some)
    assert set(got) <= set(have)
    if name == "quality_rules":
        assert got == Counter({k: n for k, n in have.items() if k in got}) and (51, next(t for i, t, _ in texts if i == 51)) in got
    elif name == "near_copies":
        label = groups([(i, t, None) for i, t in have])
        assert Counter(i for i, _ in got.elements()) == Counter([i for i in label if label[i] == i] + [i for i, _ in have.elements() if i is None])
    elif name == "decontamination":
        assert got == have
    elif name == "mixing":
        assert all(n <= 2 * have[k] for k, n in got.items()) and not any(k[1] is None for k in got)
    else:
        assert got == have
    assert stage(spark, docs.limit(0), FOLDER).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings", "conversations"):
        con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    assert rows(entry.queries()[name](spark, FOLDER).toPandas()) == rows(con.execute(queries.ORACLE_SQL[name]).df())


def test_held_out_quality(spark):
    folder = f"{DATA}/sf0.1"
    got = entry.queries()["op4_pu_quality"](spark, folder).filter("held_out").join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").toPandas()
    good, bad = got[got.quality == 1].score.values, got[got.quality == 0].score.values
    assert (good[:, None] > bad[None]).mean() > 0.95
    assert (got.predicted == got.quality).mean() > 0.98
    assert (got[got.quality == 0].predicted == 0).mean() > 0.9
