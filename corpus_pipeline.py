"""From a raw corpus to training shards: five stages, each written as Parquet and read again.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of ``docs``.

Edge cases, for every stage: an empty table gives an empty one; further columns pass through (``sharded``
replaces size, shard and slot).  Null texts count as empty.  Rows without an id are judged by their text
alone and are never near copies; where rows share an id, ``near_copies`` leaves one of them.  Repeated
rows have one verdict, and ties fall to the smallest id.  Very long texts are handled whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gridloom.llm._common import cut, discard, scratch, table
from gridloom.llm.decontaminate import keep_clean
from gridloom.llm.mixing import taken_docs
from gridloom.llm.ngram_join import keep_one
from gridloom.llm.quality_rules import keep_good
from gridloom.llm.sharding import sharded_docs


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules' posterior or the base rule rejects go."""
    return keep_good(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that with the smallest id."""
    return keep_one(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth or more lies in benchmark windows go."""
    return keep_clean(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources reach their target words; a document that is taken twice gives two rows."""
    return taken_docs(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Forty shards of near-equal bytes, with a gapless slot in each."""
    return sharded_docs(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality),
    ("near_copies", near_copies),
    ("decontamination", decontaminated),
    ("mixing", mixed),
    ("sharding", sharded),
]

#: The rules' posterior and the seeded mix can't be put in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        kept: list[DataFrame] = []
        with scratch(kept):  # what a stage wrote for itself goes when its result is written
            kept.append(cut(stage(spark, docs, sf_dir), name))
        discard(docs)
        docs = kept[0]
    return STAGES[-1][1](spark, docs, sf_dir)
