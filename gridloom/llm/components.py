"""Connected components by alternating large-star and small-star steps.

Every step is a partial-aggregated minimum and a join, so no neighbour list is ever
gathered; the edge set stays distributed and lineage is cut after each pass.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm._common import cut, discard


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges: (u, v) with u > v.  Large star links each larger neighbour of a node to the
    smallest of the node and its neighbours; small star does so for the smaller ones."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = both.join(least, "u")
    if large:
        out = joined.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.filter("u > v").distinct()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, label) for every node on an edge; label is the smallest node reachable.
    Nodes without an edge are absent.  Nulls and self loops are ignored."""
    now = cut(edges.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v")).filter(f"{a} is not null and {b} is not null and {a} <> {b}").distinct(), "edges")
    before = None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark[0] == 0 or mark == before:
            break
        before, old = mark, now
        now = cut(_star(_star(old, True), False), "edges")
        discard(old)
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("label"))).distinct()
