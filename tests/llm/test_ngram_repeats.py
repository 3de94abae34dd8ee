"""Repeated rows in large groups, through the refined index of the n-gram join."""

from __future__ import annotations

from gridloom.llm import ngram_join

from .conftest import passage


def test_refined_counts_a_set_once(spark):
    shared = passage(1, 60)
    rows = [(k, shared + " " + passage(1000 + k // 2, 40) + f" extra{k}") for k in range(12)]
    rows += [(50, rows[0][1].upper())]  # another text, the same set
    once = spark.createDataFrame(rows[:12], "doc_id long, text string")
    often = spark.createDataFrame([r for r in rows for _ in range(30)], "doc_id long, text string").repartition(4)
    of = lambda df: [tuple(r) for r in ngram_join.refined(ngram_join.set_hashes(df)).select("sig", "of", "h1", "left", "small").collect()]
    wanted, got = of(once), of(often)
    assert len(got) == len(set(got)) and set(got) == set(wanted)
    assert len({r[2] for r in wanted}) == 12
