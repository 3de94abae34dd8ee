"""Benchmark items without an id still contaminate."""

from __future__ import annotations

from gridloom.llm import decontaminate

from .conftest import passage


def test_items_without_an_id_count(spark):
    both, one = passage(2001, 20), passage(2002, 20)
    bench = spark.createDataFrame([(None, both), (4, both), (None, one)], "item_id long, text string")
    texts = [(1, passage(2003, 50) + " " + one), (2, passage(2004, 50) + " " + both), (3, passage(2005, 50))]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], list(r["items"])) for r in decontaminate.find(docs, bench).collect()}
    assert got == {1: (70, 20, []), 2: (70, 20, ["4"]), 3: (50, 0, [])}
    assert [r["doc_id"] for r in decontaminate.keep_clean(docs, bench).collect()] == [3]
