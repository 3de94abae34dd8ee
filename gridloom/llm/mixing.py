"""Mixing overlapping sources to target weights by a min-cost flow.

Sources overlap where they hold the same item (an equal text).  Items with the same set of sources
form a membership pattern.  The driver sees one row per pattern and source (not per document), and
solves a flow from patterns to source quotas.  Its cost is convex in repetition, counted by item
whichever sources it is taken from: the first use of a word is free, a second costs one, and so
on, so a source takes rather what no other source has taken yet.  Documents are then taken in a seeded
order until the flow of their pattern and source is used; running totals are kept per slice of that
order, so a source with a third of all rows is spread over tasks.  What whole documents leave over
or short is made good in each source's largest pattern.

Edge cases: null text has size 0 and is never taken; a null source is a source of its own, last;
null ids are ordered like any value; equal rows tie and are taken as one after the other.  Very long
texts are taken whole or not, so a source may miss its target by half of one.  Empty tables give empty
results; other columns are carried where asked.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.llm._common import BROADCAST_ROWS, WHITE, cut, discard, pinned, small

SHARE, WEIGHTS, MOST = 1.5, (5, 2, 1), 2
#: Uses of an item that are told apart by cost; all further ones cost the same.
LEVELS = 5
SLICE_ROWS = 500
#: Patterns of several sources that the flow tells apart; a pattern takes about 200 bytes and 50 microseconds.
PATTERNS = 100_000


def size_of(text: str):
    return pinned(F.size(F.filter(F.split(F.coalesce(F.col(text).cast("string"), F.lit("")), WHITE + "+"), lambda w: w != "")).cast("long"))


def item_of(text: str):
    """What makes two texts the same item: 64 bits of the whole text."""
    return F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")))


def targets(sizes: dict[str | None, int], share: float = SHARE, weights: Sequence[float] = WEIGHTS, most: float = MOST) -> dict[str | None, float]:
    """Quota per source: ``share`` of all words by repeating weights over the sources in code point
    order (null last), none above ``most`` times its size; what is cut off is dealt again by weight."""
    order = sorted(sizes, key=lambda s: (s is None, "" if s is None else s))
    weight = {s: float(weights[k % len(weights)]) for k, s in enumerate(order)}
    out: dict[str | None, float] = {}
    open_, left = list(order), share * sum(sizes.values())
    while open_:
        unit = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if unit * weight[s] > most * sizes[s]]
        if not over:
            out |= {s: unit * weight[s] for s in open_}
            break
        for s in over:
            out[s] = float(most * sizes[s])
            left -= out[s]
        open_ = [s for s in open_ if s not in over]
    return {s: out[s] for s in order}


def flow(capacity: dict[int, float], limit: dict[tuple[int, int], float], quota: dict[int, float], levels: int = LEVELS) -> dict[tuple[int, int], float]:
    """Min-cost flow.  capacity: words of each pattern's items; limit: most words that
    a pattern can give a source; quota: words per source.  Use number c of a pattern's words costs
    c - 1 (from ``levels`` on the same), so repetition is spread as evenly as the overlaps allow.  Returns
    words per (pattern, source).

    Paths cost what their last word costs, so all paths of a level go before those of the next; within a level they
    are a maximum flow.  That is found by blocking flows: patterns and sources are put in layers by their distance
    from the sources that want more, and each edge is used up or given up once a phase.  A path visits a source once
    at most, so phases are as many as sources at most, and each reads the edges once: time is in
    proportion to the edges, whatever the number of patterns."""
    used = dict.fromkeys(limit, 0.0)
    want = dict(quota)
    spent = dict.fromkeys(capacity, 0.0)
    by_source: dict[int, list[int]] = {s: [] for s in quota}
    by_pattern: dict[int, list[int]] = {p: [] for p in capacity}
    for p, s in limit:
        by_source.setdefault(s, []).append(p)
        by_pattern.setdefault(p, []).append(s)
    tiny = 1e-6
    for level in range(1, levels + 1):
        room = {p: (capacity[p] * level if level < levels else float("inf")) - spent[p] for p in capacity}
        while True:
            # Layers: sources that want more, patterns that they may take from, sources that those give to, and so on.
            depth_s = {s: 0 for s in quota if want[s] > tiny}
            depth_p: dict[int, int] = {}
            layer, depth, reached = list(depth_s), 0, False
            while layer and not reached:
                patterns_ = []
                for s in layer:
                    for p in by_source[s]:
                        if p not in depth_p and limit[p, s] - used[p, s] > tiny:
                            depth_p[p] = depth
                            patterns_.append(p)
                            reached = reached or room[p] > tiny
                depth += 1
                layer = [] if reached else list(dict.fromkeys(s for p in patterns_ for s in by_pattern[p] if s not in depth_s and used[p, s] > tiny))
                depth_s |= dict.fromkeys(layer, depth)
            if not reached:
                break
            at_s, at_p = dict.fromkeys(depth_s, 0), dict.fromkeys(depth_p, 0)

            def push(s: int, amount: float) -> float:
                """Send up to ``amount`` from source s on to patterns with room; what was sent."""
                sent = 0.0
                own = by_source[s]
                while at_s[s] < len(own) and amount - sent > tiny:  # noqa: B023
                    p = own[at_s[s]]  # noqa: B023
                    free = min(amount - sent, limit[p, s] - used[p, s])
                    got = 0.0
                    if depth_p.get(p) == depth_s[s] and free > tiny:  # noqa: B023
                        got = min(free, max(0.0, room[p]))  # noqa: B023
                        room[p] -= got  # noqa: B023
                        spent[p] += got
                        givers = by_pattern[p]
                        while got < free - tiny and at_p[p] < len(givers):  # noqa: B023
                            t = givers[at_p[p]]  # noqa: B023
                            more = min(free - got, used[p, t])
                            moved = push(t, more) if depth_s.get(t) == depth_p[p] + 1 and more > tiny else 0.0  # noqa: B023
                            used[p, t] -= moved
                            got += moved
                            if moved < more - tiny or used[p, t] <= tiny:
                                at_p[p] += 1  # noqa: B023
                        used[p, s] += got
                        sent += got
                    if got < free - tiny or limit[p, s] - used[p, s] <= tiny or free <= tiny:
                        at_s[s] += 1  # noqa: B023
                return sent

            for s in [s for s, d in depth_s.items() if d == 0]:
                want[s] -= push(s, want[s])
    return used


def patterns(light: DataFrame, most: int) -> tuple[list, dict, DataFrame]:
    """light: (_mix_s, _mix_k, _mix_n).  Rows (pattern, source, words, rows), words of the items of each pattern, and the
    table (_mix_k, _mix_m) of the items that several sources hold.  A pattern is a sorted array of structs of a source,
    which may be null.  The ``most`` patterns of several sources that have most words are told apart; items of
    all others count with each of their sources for itself, so targets are met all the same and only the
    repetition across these sources goes uncounted."""
    held = light.groupBy("_mix_k", "_mix_s").agg(F.sum("_mix_n").alias("words"), F.count("*").alias("rows"), F.max("_mix_n").alias("unit"))
    held = cut(held, "mix-held")
    each = held.groupBy("_mix_k").agg(F.array_sort(F.collect_set(F.struct("_mix_s"))).alias("_mix_m"), F.max("unit").alias("unit"))
    several = cut(each.filter("size(_mix_m) > 1"), "mix-several")
    counted = several.groupBy("_mix_m").agg(F.sum("unit").alias("words"))
    if counted.count() > most:
        kept = cut(counted.orderBy(F.desc("words"), F.col("_mix_m").cast("string")).limit(most).select("_mix_m"), "mix-patterns")
        several = cut(several.join(small(kept), "_mix_m", "left_semi"), "mix-several")
    several = several.select("_mix_k", "_mix_m")
    known = held.join(small(several), "_mix_k", "left").withColumn("_mix_p", F.coalesce("_mix_m", F.array(F.struct("_mix_s"))))
    cells = known.groupBy("_mix_p", "_mix_s").agg(F.sum("words").alias("words"), F.sum("rows").alias("rows")).collect()  # ``most`` times the sources at most
    words = known.groupBy("_mix_p", "_mix_k").agg(F.max("unit").alias("unit")).groupBy("_mix_p").agg(F.sum("unit").alias("words")).collect()  # one row a pattern
    discard(held)
    return cells, {tuple(x["_mix_s"] for x in r["_mix_p"]): float(r["words"]) for r in words}, several


def mix(docs: DataFrame, source_col: str = "source", item_col: str = "item", size_col: str = "size", id_col: str = "doc_id", seed: int = 17, max_patterns: int = PATTERNS) -> DataFrame:
    """``docs`` (one row for each source that holds an item, with the item's size) plus source_size, target and
    copies (how often the whole document is taken, 0 to ``MOST``).  The flow runs on the driver, over
    ``max_patterns`` patterns of several sources at most (see ``patterns``).  Columns named ``_mix_...`` are its own."""
    spark = docs.sparkSession
    order = F.xxhash64(F.lit(seed), F.col(id_col).cast("string"), F.col(size_col))
    keyed = docs.withColumn("_mix_s", F.col(source_col)).withColumn("_mix_k", F.xxhash64(F.lit(seed), F.col(item_col))).withColumn("_mix_o", order).withColumn("_mix_n", F.col(size_col))
    light = cut(keyed.select("_mix_s", "_mix_k", "_mix_o", "_mix_n"), "mix-sizes")
    cells, item_words, several = patterns(light, max_patterns)
    place = lambda s: (s is None, "" if s is None else s)
    cells.sort(key=lambda r: (place(r["_mix_s"]), [place(x["_mix_s"]) for x in r["_mix_p"]]))
    of_source: dict[str | None, int] = {}
    for r in cells:
        of_source[r["_mix_s"]] = of_source.get(r["_mix_s"], 0) + r["words"]
    quota = targets(of_source) if of_source else {}
    number = {s: k for k, s in enumerate(quota)}
    names = list(item_words)
    at = {p: k for k, p in enumerate(names)}
    key = lambda r: (at[tuple(x["_mix_s"] for x in r["_mix_p"])], number[r["_mix_s"]])
    used = flow({k: item_words[p] for k, p in enumerate(names)}, {key(r): float(MOST * r["words"]) for r in cells}, {number[s]: q for s, q in quota.items()})
    kind = T.StructType([T.StructField("_mix_q", T.ArrayType(T.StructType([T.StructField("_mix_s", keyed.schema["_mix_s"].dataType)]))), T.StructField("_mix_s2", keyed.schema["_mix_s"].dataType), T.StructField("_mix_cell", T.LongType()), T.StructField("_mix_slices", T.LongType())])
    numbers = spark.createDataFrame([(r["_mix_p"], r["_mix_s"], c, max(1, -(-r["rows"] // SLICE_ROWS))) for c, r in enumerate(cells)], kind)
    numbers = F.broadcast(numbers) if len(cells) <= BROADCAST_ROWS else numbers
    slice_of = F.floor(F.pmod(F.col("_mix_o"), F.lit(1 << 40)) / F.lit(1 << 40) * F.col("_mix_slices"))
    several = small(several)

    def sliced(df: DataFrame) -> DataFrame:
        df = df.join(several, "_mix_k", "left").withColumn("_mix_p", F.coalesce("_mix_m", F.array(F.struct("_mix_s"))))
        df = df.join(numbers, F.col("_mix_p").eqNullSafe(F.col("_mix_q")) & F.col("_mix_s").eqNullSafe(F.col("_mix_s2")))
        return df.withColumn("_mix_slice", slice_of).drop("_mix_m", "_mix_p", "_mix_q", "_mix_s2", "_mix_k", "_mix_s")

    starts = sliced(light).groupBy("_mix_cell", "_mix_slice").agg(F.sum("_mix_n").alias("_mix_sum"))
    before = F.coalesce(F.sum("_mix_sum").over(Window.partitionBy("_mix_cell").orderBy("_mix_slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = small(cut(starts.withColumn("_mix_before", before).select("_mix_cell", "_mix_slice", "_mix_before"), "mix-slices"))

    def counted(df: DataFrame, amounts: list[float]) -> DataFrame:
        """df with copies, where each cell gives its amount of words."""
        # A flow of f words over a cell of w words: all documents f // w times, the first f % w once more.
        rounds = [min(MOST, int(f / max(1, r["words"]) + 1e-9)) for f, r in zip(amounts, cells, strict=True)]
        plan = spark.createDataFrame([(c, rounds[c], float(f - rounds[c] * r["words"]), of_source[r["_mix_s"]], float(quota[r["_mix_s"]])) for c, (f, r) in enumerate(zip(amounts, cells, strict=True))], "_mix_c long, _mix_rounds int, _mix_part double, _mix_size long, _mix_target double")
        plan = F.broadcast(plan) if len(cells) <= BROADCAST_ROWS else plan
        df = sliced(df).join(starts, ["_mix_cell", "_mix_slice"]).join(plan, F.col("_mix_cell") == F.col("_mix_c"))
        run = Window.partitionBy("_mix_cell", "_mix_slice").orderBy(F.pmod(F.col("_mix_o"), F.lit(1 << 40)), "_mix_o", "_mix_n").rowsBetween(Window.unboundedPreceding, -1)
        middle = F.col("_mix_before") + F.coalesce(F.sum("_mix_n").over(run), F.lit(0)) + F.col("_mix_n") / 2
        copies = F.least(F.lit(MOST), F.col("_mix_rounds") + F.when(middle < F.col("_mix_part"), 1).otherwise(0))
        return df.withColumn("_mix_copies", F.when(F.col("_mix_n") > 0, copies).otherwise(0).cast("int"))

    amounts = [used[key(r)] for r in cells]
    got = {r["_mix_cell"]: r["w"] for r in counted(light, amounts).groupBy("_mix_cell").agg(F.sum(F.col("_mix_n") * F.col("_mix_copies")).alias("w")).collect()}  # one row a cell
    cells_of: dict[str | None, list[int]] = {}
    for c, r in enumerate(cells):
        cells_of.setdefault(r["_mix_s"], []).append(c)
    for own in cells_of.values():
        main = max(own, key=lambda c: cells[c]["words"])
        amounts[main] += sum(amounts[c] - got.get(c, 0) for c in own if c != main)
        amounts[main] = min(max(0.0, amounts[main]), float(MOST * cells[main]["words"]))
    made = {"source_size": "_mix_size", "target": "_mix_target", "copies": "_mix_copies"}
    return counted(keyed, amounts).select(*[c for c in docs.columns if c not in made], *[F.col(c).alias(n) for n, c in made.items()])


def taken_docs(docs: DataFrame) -> DataFrame:
    """``docs`` as the mix takes them: a document that is taken twice has two rows."""
    sized = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "source", item_of("text").alias("item"), size_of("text").alias("size"))
    return mix(sized).filter("copies > 0").withColumn("_mix_c", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
