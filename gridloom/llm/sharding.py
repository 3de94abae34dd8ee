"""Sharding by sampled splitters: a size-weighted sample of keys gives quantile boundaries,
records are range-partitioned by them, and ranges that hold a shard boundary are subdivided
exactly, so shards get near-equal bytes (law ``bytes``).

The key is (hash of the text, id): equal texts lie side by side.  Groups of more than
``PART`` of a shard, of which there are less than ``shards / PART``, are dealt first, the largest first to
the emptiest shard.  A group stays whole where that shard then holds ``FULL`` of the mean at most; one that would
lift it above that is subdivided, by id, like all other records, which fill what room is left, in the order of the
keys.  So the law holds however many groups there are of a size near a shard's.

Edge cases: null text has 0 bytes; null ids sort first; equal rows tie, and any order of them
gives the same result rows.  A very long text is one record, which no law divides.  Empty tables give
empty results; columns named like the result's are replaced, others are carried where asked.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm._common import cut

SHARDS, OVERHEAD, SEED = 40, 16, 29
#: Ranges per shard at least, bytes of a range at most, and expected sample keys per range.
FINE, RANGE_BYTES, SAMPLE = 24, 1 << 30, 40
#: Groups of equal texts above this part of a shard are placed one by one.
PART = 0.01
#: What a shard may hold, in parts of the mean, for a group to stay whole in it.
FULL = 1.02
#: Sample keys in all, beyond which a range has fewer; but never fewer than ``LEAST``.
DRAWN, LEAST = 400_000, 8


def size_of(text: str) -> Column:
    return (F.coalesce(F.octet_length(F.col(text).cast("string")), F.lit(0)) + OVERHEAD).cast("long")


#: Keys are hashes, so their top bits deal them evenly: splitters are looked up by these bits.
TOP_BITS = 12


def _lookup(spark, cuts: list[tuple[int, int]]) -> DataFrame:
    """(_top, _base, _cuts): the number of splitters below each value of the top bits, and those in it."""
    inside: dict[int, list[tuple[int, int]]] = {}
    for h, i in cuts:
        inside.setdefault(h >> (64 - TOP_BITS), []).append((h, i))
    rows, base = [], 0
    for top in range(-(1 << (TOP_BITS - 1)), 1 << (TOP_BITS - 1)):
        own = inside.get(top, [])
        rows.append((top, base, own))
        base += len(own)
    return F.broadcast(spark.createDataFrame(rows, "_top long, _base int, _cuts array<struct<h:bigint,i:bigint>>"))  # 2 ** TOP_BITS rows


def _ranged(df: DataFrame, lookup: DataFrame) -> DataFrame:
    """Column _r: the number of splitters at or below the key (_h, _i)."""
    below = lambda c: (c["h"] < F.col("_h")) | ((c["h"] == F.col("_h")) & (c["i"] <= F.col("_i")))
    joined = df.join(lookup, F.shiftright("_h", 64 - TOP_BITS) == F.col("_top"))
    return joined.withColumn("_r", F.col("_base") + F.size(F.filter("_cuts", below))).drop("_top", "_base", "_cuts")


def splitters(keys: DataFrame, total: int, count: int, heavy: set[int]) -> list[tuple[int, int]]:
    """keys: (_h, _i, _n).  Up to ``count - 1`` boundaries between ranges of near-equal size, from a
    sample in which a record's chance follows its size: each distinct key once, so about ``count * SAMPLE``
    of them reach the driver, or ``DRAWN``, or ``count * LEAST``, one range being a GB or more then.  Boundaries lie between different hashes, except within one that is heavy."""
    if not total:
        return []
    step = total / (count * max(LEAST, min(SAMPLE, DRAWN // count)))
    same = keys.groupBy("_h", "_i").agg(F.sum("_n").alias("_n"))
    chance = F.pmod(F.xxhash64(F.lit(SEED), "_h", "_i"), F.lit(1 << 40)) / F.lit(1 << 40)
    drawn = same.filter(chance < F.col("_n") / step).select("_h", "_i", F.greatest(F.col("_n").cast("double"), F.lit(step)).alias("w")).collect()
    sample = sorted((r["_h"], r["_i"], r["w"]) for r in drawn)
    weight, at, out = sum(w for *_, w in sample), 0.0, []
    for h, i, w in sample:
        at += w
        if at >= weight * (len(out) + 1) / count:
            out += [(h, i)] * (int(at * count / weight) - len(out))
    return sorted({(h, i if h in heavy else -(2**63)) for h, i in out[: count - 1]})


def dealt(groups: list[tuple[int, int]], shards: int, each: float) -> tuple[dict[int, int], list[int]]:
    """(hash, bytes) of groups -> the shards of those that stay whole, and what each shard holds of them: the
    largest first, each to the emptiest shard, unless that would hold more than ``FULL`` of the mean."""
    heap, home, load = [(0, s) for s in range(shards)], {}, [0] * shards
    for h, b in sorted(groups, key=lambda g: (-g[1], g[0])):
        held, s = heap[0]
        if held + b <= FULL * each:
            home[h], load[s] = s, held + b
            heapq.heapreplace(heap, (load[s], s))
    return home, load


def bounds_of(load: list[int], each: float, rest: int) -> list[float]:
    """Where, along the bytes of all other records in order, each shard but the last ends."""
    room = [max(0.0, each - x) for x in load]
    scale, at, out = rest / max(1e-9, sum(room)), 0.0, []
    for x in room[:-1]:
        at += x * scale
        out.append(at)
    return out


def _rows(spark, rows: list[tuple], schema: str) -> DataFrame:
    return F.broadcast(spark.createDataFrame(rows, schema))


#: Marks a group that is subdivided.
SPLIT = -1


def assign(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns plus size, shard and slot (gapless from 0 within a shard)."""
    spark = docs.sparkSession
    cols = [F.col(c) for c in keep]
    full = docs.select(*cols, size_of(text_col).alias("_n"), F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("_h"), F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63) + 1)).alias("_i"))
    keys = cut(full.select("_n", "_h", "_i"), "shard-keys")
    total = keys.agg(F.sum("_n")).first()[0] or 0
    each = total / shards if total else 1.0
    # Fewer than shards / PART rows, since their bytes add up to the total at most.
    heavy = keys.groupBy("_h").agg(F.sum("_n").alias("b"), F.count("*").alias("c")).filter(F.col("b") > PART * each).collect()
    home, load = dealt([(r["_h"], r["b"]) for r in heavy], shards, each)
    homes = _rows(spark, [(r["_h"], home.get(r["_h"], SPLIT)) for r in heavy], "_g long, _home int")
    # The number of ranges follows the bytes, so that a range of whole records fits a task.
    cuts = splitters(keys, total, max(shards * FINE, -(-total // RANGE_BYTES)), {r["_h"] for r in heavy})
    lookup = _lookup(spark, cuts)
    ranged = lambda df: _ranged(df, lookup).join(homes, F.col("_h") == F.col("_g"), "left").drop("_g")
    free = F.coalesce(F.col("_home"), F.lit(SPLIT)) == SPLIT
    # One row a range, and one for each range that a group which stays whole has rows in.
    rows = ranged(keys).groupBy("_r", F.when(~free, F.col("_h")).alias("_g")).agg(F.sum("_n").alias("b"), F.count("*").alias("c")).collect()
    starts, at, count = [], 0, 0
    rest = {r["_r"]: r for r in rows if r["_g"] is None}
    for r in sorted({r["_r"] for r in rows}):
        starts.append((r, at, count))
        at, count = (at + rest[r]["b"], count + rest[r]["c"]) if r in rest else (at, count)
    offsets = _rows(spark, starts, "_k int, _b long, _c long")
    bounds = F.array(*[F.lit(x) for x in bounds_of(load, each, at)]).cast("array<double>")

    def placed(df: DataFrame) -> DataFrame:
        order = Window.partitionBy("_r").orderBy("_h", "_i", "_n")
        before = order.rowsBetween(Window.unboundedPreceding, -1)
        df = ranged(df).withColumn("_run", F.coalesce(F.sum(F.when(free, F.col("_n"))).over(before), F.lit(0))).withColumn("_row", F.coalesce(F.sum(F.when(free, 1)).over(before), F.lit(0)))
        group = Window.partitionBy("_r", "_h")
        df = df.withColumn("_first", F.min("_run").over(group)).withColumn("_all", F.sum("_n").over(group)).withColumn("_nth", F.row_number().over(group.orderBy("_i", "_n")) - 1)
        df = df.join(offsets, F.col("_r") == F.col("_k"))
        # The middle of a record, or of its group, decides; so a shard is off by less than one of these.
        middle = F.col("_b") + F.when(F.col("_home") == SPLIT, F.col("_run") + F.col("_n") / 2).otherwise(F.col("_first") + F.col("_all") / 2)
        return df.withColumn("shard", F.when(free, F.size(F.filter(bounds, lambda x: x <= middle))).otherwise(F.col("_home")).cast("int")).withColumn("_place", F.col("_c") + F.col("_row"))

    firsts = placed(keys).filter(free).groupBy("shard").agg(F.min("_place").alias("p"), F.count("*").alias("c")).collect()  # one row a shard
    found = _rows(spark, [(r["shard"], r["p"]) for r in firsts], "_s int, _start long")
    # Groups that stay whole come after the shard's other records, one after the other.
    have = {r["shard"]: r["c"] for r in firsts}
    groups = []
    for r in sorted((r for r in rows if r["_g"] is not None), key=lambda r: (r["_g"], r["_r"])):
        s = home[r["_g"]]
        groups.append((r["_r"], r["_g"], have.get(s, 0)))
        have[s] = have.get(s, 0) + r["c"]
    groups = _rows(spark, groups, "_r2 int, _g2 long, _from long")
    out = placed(full).join(found, F.col("shard") == F.col("_s"), "left").join(groups, (F.col("_r") == F.col("_r2")) & (F.col("_h") == F.col("_g2")), "left")
    slot = F.when(free, F.col("_place") - F.col("_start")).otherwise(F.col("_from") + F.col("_nth"))
    return out.select(*cols, F.col("_n").alias("size"), "shard", slot.cast("long").alias("slot"))


def sharded_docs(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``docs`` with shard and slot."""
    named = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "text")
    own = [F.col("row")[c].alias(c) for c in docs.columns if c not in ("size", "shard", "slot")]
    return assign(named, shards, keep=("row",)).select(*own, "size", "shard", "slot")
