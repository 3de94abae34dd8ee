"""Vectors against a stated set of asking vectors, in cells of numpy blocks.

The asking vectors are dealt to blocks and the rows to groups; a cell is a block and a group.  A task reads
the cells it has one after the other: first the block, which it holds, then the group's rows in slices.  So
memory has a fixed bound whatever the tables, any number of equal vectors is dealt evenly, and no pair is
ever a row: a cell gives each asking vector's best few.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm._common import cut, partitions, small

#: Asking vectors of a block at most (about), least rows of a group, and rows of a slice.
BLOCK, LEAST, SLICE = 16_384, 512, 8192
SEED = 11


def usable(df: DataFrame, id_col: str, vector_col: str, tag: Column) -> DataFrame:
    """(id, tag, v): rows with an id, a tag and a vector whose components are all finite.  Rows that share an id
    count once, as the least by tag and vector."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), tag.cast("long").alias("tag"), F.col(vector_col).alias("v"))
    whole = F.size(F.array_compact("v")) == F.size("v")
    finite = (F.size("v") == 0) | ((F.array_max("v") < float("inf")) & (F.array_min("v") > float("-inf")))
    rows = rows.filter("id is not null and tag is not null and v is not null").filter(whole & finite)
    twice = cut(rows.groupBy("id").count().filter("count > 1").select("id"), "twice")
    if not twice.limit(1).count():
        return rows
    twice = small(twice)
    least = rows.join(twice, "id", "left_semi").groupBy("id").agg(F.min(F.struct("tag", "v")).alias("r")).select("id", "r.tag", "r.v")
    return rows.join(twice, "id", "left_anti").unionByName(least)


def matrix(column: pa.Array) -> np.ndarray:
    """Lists of numbers as the rows of a matrix of doubles; shorter ones end in zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    width = int(sizes.max(initial=0))
    if (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width))
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def stacked(parts: list[np.ndarray]) -> np.ndarray:
    width = max(x.shape[1] for x in parts)
    return np.concatenate([x if x.shape[1] == width else np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in parts])


def alike(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both with the same number of columns."""
    width = max(a.shape[1], b.shape[1])
    return tuple(x if x.shape[1] == width else np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (a, b))


def met(rows: DataFrame, asks: DataFrame, open_cell: Callable, schema: str) -> DataFrame:
    """rows: (id, tag, v).  asks: (id, tag, v, extra array<long>).  ``open_cell(ids, tags, vectors, extras)`` gives an
    object with ``take(ids, tags, vectors)``, called for each slice, and ``result()``, a record batch of ``schema``."""
    spark = rows.sparkSession
    n, m = rows.count(), asks.count()
    if not n or not m:
        return spark.createDataFrame([], schema)
    blocks = -(-m // BLOCK)
    groups = max(1, min(-(-2 * partitions(spark) // blocks), n // LEAST))
    deal = lambda seed, k: F.pmod(F.xxhash64(F.lit(SEED + seed), "id"), F.lit(k)).cast("int")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    a = asks.withColumn("block", deal(0, blocks)).withColumn("group", every(groups)).select("block", "group", F.lit(0).alias("kind"), "id", "tag", "v", "extra")
    r = rows.withColumn("group", deal(1, groups)).withColumn("block", every(blocks)).select("block", "group", F.lit(1).alias("kind"), "id", "tag", "v", F.lit(None).cast("array<bigint>").alias("extra"))
    cells = a.unionByName(r).withColumn("cell", F.col("block") * groups + F.col("group")).drop("block", "group")
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        at, held, cell, waiting, count = None, [], None, [], 0

        def parts(pieces):
            return np.concatenate([p.column("id").to_numpy() for p in pieces]), np.concatenate([p.column("tag").to_numpy() for p in pieces]), stacked([matrix(p.column("v")) for p in pieces])

        def flush():
            nonlocal waiting, count
            if waiting:
                cell.take(*parts(waiting))
            waiting, count = [], 0

        def close():
            nonlocal held, cell
            if cell is not None:
                flush()
                yield pa.RecordBatch.from_arrays(cell.result(), names)
            held, cell = [], None

        for batch in batches:
            batch = pa.RecordBatch.from_arrays(batch.columns, batch.schema.names)
            where = batch.column("cell").to_numpy() * 2 + batch.column("kind").to_numpy()
            starts = np.flatnonzero(np.append(True, where[1:] != where[:-1])).tolist() if len(where) else []
            for i, j in zip(starts, [*starts[1:], len(where)], strict=True):
                if where[i] // 2 != at:
                    yield from close()
                    at = where[i] // 2
                if where[i] % 2 == 0:
                    held.append(batch.slice(i, j - i))
                elif held or cell is not None:
                    if cell is None:
                        cell = open_cell(*parts(held), [x for p in held for x in p.column("extra").to_pylist()])
                        held = []
                    while i < j:
                        some = batch.slice(i, min(j - i, SLICE - count))
                        waiting.append(some)
                        count += len(some)
                        i += len(some)
                        if count == SLICE:
                            flush()
        yield from close()

    dealt = cells.repartition(max(partitions(spark), min(blocks * groups, 4 * partitions(spark))), "cell").sortWithinPartitions("cell", "kind", F.xxhash64("id"))
    return dealt.select("cell", "kind", "id", "tag", "v", "extra").mapInArrow(run, schema)


def best(scores: np.ndarray, ids: np.ndarray, more: np.ndarray, more_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The first k by score, the highest first, ties by id."""
    s, i = np.append(scores, more), np.append(ids, more_ids)
    order = np.lexsort((i, -s))[:k]
    return s[order], i[order]
