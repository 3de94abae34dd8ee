"""The trie of conversation prefixes, by Spark SQL's ROLLUP over positional columns of turn ids.

A conversation's turns are cut into blocks of ``WIDTH``.  A block is a row with a column of turn ids for each
position, and with the node at which the block before it ended (in the first block: the root).  Grouped by
``ROLLUP(prior, t1 .. t8)`` a block gives all its prefixes at once; ``grouping_id`` tells which positions a
row has.  Long conversations go on in further blocks, keyed by the prior block's node, so the rollup's rows
follow the number of turns, however long a conversation is.

A turn id is a digest of role and text, with the text's bytes.  A node's name is its depth and two exclusive-or
sums of 64-bit hashes of (turn id, position): such a name can be made for each block from sums that are running
along its conversation, so no task holds a conversation, and a parent's name follows from its child's.

Sums over subtrees need no walk: each node's own amount is booked with its smallest member, whose nodes are the
last ones of its path.  A second rollup adds up, at each node, all that is booked with its members;
what its smallest member booked above the node is taken off again.

Edge cases: null role or text is an empty one.  Rows with a null conv_id take no part.  A null turn comes
first; rows of one conversation and turn are ordered by the digest of role and text, and repeated rows are turns
of their own.  Very long texts enter by digest and length only.  A conversation that is left without turns is a member
of the root.  Equal conversations share all nodes; the smallest id names them.  An empty table gives no node, not even
the root; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm._common import cut, join_split
from gridloom.operators.ranks import numbered, running

#: Positions of a block, and conversations whose ids are put together in one row.
WIDTH, CHUNK_BITS = 8, 12
#: How conversations are rebuilt: those of ``FAMILY`` neighbours share up to ``SHARED - 1`` first turns.
FAMILY, SHARED = 5, 9
NODE = ("depth", "x1", "x2")
_XOR = (F.bit_xor, lambda a, b: a.bitwiseXOR(b))
_SUM = (F.sum, lambda a, b: a + b)


def turn_id(role: Column, text: Column) -> Column:
    """Digest of role and text, and the text's bytes behind a colon."""
    role, text = (F.coalesce(c.cast("string"), F.lit("")) for c in (role, text))
    return F.concat_ws(":", F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)), F.octet_length(text).cast("string"))


def bytes_of(turn: Column) -> Column:
    return F.substring_index(turn, ":", -1).cast("long")


def salted(turn: Column, depth: Column) -> tuple[Column, Column]:
    """Two hashes of a turn id at a depth."""
    return F.xxhash64(turn, depth), F.xxhash64(depth, F.lit("second"), turn)


def xor_over(turns: list[Column], depth: Column, start: tuple[Column, Column]) -> tuple[Column, Column]:
    """start and the hashes of all turns that are not null, of which the first is at ``depth`` + 1."""
    out = list(start)
    for i, t in enumerate(turns, 1):
        for k, h in enumerate(salted(t, depth + i)):
            out[k] = out[k].bitwiseXOR(F.when(t.isNotNull(), h).otherwise(F.lit(0).cast("long")))
    return out[0], out[1]


def rebuilt(turns: DataFrame, family: int = FAMILY, shared: int = SHARED) -> DataFrame:
    """turns: (conv_id, turn, t).  (conv_id, position, t): the first h turns of conversation c - c % family and
    then c's own after its first h, where h is crc32(c) % shared; one row without turn where nothing is left."""
    placed = cut(numbered(turns, ["conv_id"], ["turn", "t"]), "turns")
    head = F.sort_array(F.collect_list(F.when(F.col("position") < shared, F.struct("position", "t"))))
    convs = cut(placed.groupBy("conv_id").agg(F.count("*").alias("n"), head.alias("head")), "conversations")
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(shared)).cast("int")
    first = convs.select(F.col("conv_id").alias("first_id"), F.col("head").alias("first_head"))
    convs = convs.withColumn("h", h).withColumn("first_id", F.col("conv_id") - F.col("conv_id") % family).join(first, "first_id", "left")
    convs = convs.withColumn("taken", F.coalesce(F.slice("first_head", F.lit(1), F.col("h")), F.array().cast("array<struct<position:bigint,t:string>>")))
    convs = cut(convs.select(F.col("conv_id").alias("c"), "n", "h", F.size("taken").alias("m"), "taken"), "heads")
    own = join_split(placed, convs.select("c", "n", "h", "m"), F.col("conv_id"), F.col("c"), "n").filter("position >= h").select("conv_id", (F.col("position") - F.col("h") + F.col("m")).alias("position"), "t")
    lent = convs.select(F.col("c").alias("conv_id"), F.explode("taken").alias("x")).select("conv_id", "x.position", "x.t")
    empty = convs.filter("m = 0 and n <= h").select(F.col("c").alias("conv_id"), F.lit(0).cast("long").alias("position"), F.lit(None).cast("string").alias("t"))
    return own.unionByName(lent).unionByName(empty)


def blocks_of(turns: DataFrame) -> DataFrame:
    """turns: (conv_id, position, t).  (conv_id, block, t1 .. t8, x1, x2: those of the node before it)."""
    at = F.col("position")
    listed = F.sort_array(F.collect_list(F.when(F.col("t").isNotNull(), F.struct(F.pmod(at, F.lit(WIDTH)).alias("slot"), "t"))))  # WIDTH at most
    rows = turns.groupBy("conv_id", F.floor(at / WIDTH).cast("long").alias("block")).agg(listed.alias("a"))
    rows = rows.select("conv_id", "block", *[F.get("a", F.lit(i))["t"].alias(f"t{i + 1}") for i in range(WIDTH)])
    zero = F.lit(0).cast("long")
    own = xor_over([F.col(f"t{i + 1}") for i in range(WIDTH)], F.col("block") * WIDTH, (zero, zero))
    rows = cut(rows.withColumns({"y1": own[0], "y2": own[1]}), "blocks")
    rows = running(rows, ["conv_id"], "block", {"x1": ("y1", *_XOR), "x2": ("y2", *_XOR)})
    return cut(rows.withColumns({k: F.coalesce(k, zero) for k in ("x1", "x2")}).drop("y1", "y2"), "prior")


def rolled(blocks: DataFrame, sums: dict[str, str]) -> DataFrame:
    """(depth, x1, x2, its parent's p1 and p2, bytes of the last text, and ``sums``, new column -> SQL aggregate)
    of every node."""
    names = [f"t{i + 1}" for i in range(WIDTH)]
    told = ", ".join(f"{sql} AS {new}" for new, sql in sums.items())
    rows = blocks.sparkSession.sql(
        f"SELECT prior, {', '.join(names)}, grouping_id() AS g, {told} FROM {{blocks}} GROUP BY ROLLUP(prior, {', '.join(names)})",
        blocks=blocks.withColumn("prior", F.struct("block", "x1", "x2")),
    )
    # One bit of grouping_id a column that is rolled up; a node of level L has its first L turns.
    rows = rows.withColumn("level", WIDTH - F.bit_count("g")).filter("level >= 0")
    last = F.get(F.array(*names), F.col("level") - 1)
    rows = rows.withColumn("last", F.when(F.col("level") > 0, last)).filter("last is not null or (level = 0 and prior.block = 0)")
    start = F.col("prior.block") * WIDTH
    one, two = xor_over([F.when(F.col("level") >= i + 1, F.col(t)) for i, t in enumerate(names)], start, (F.col("prior.x1"), F.col("prior.x2")))
    rows = rows.select((start + F.col("level")).cast("long").alias("depth"), one.alias("x1"), two.alias("x2"), "last", *sums)
    back = [F.col(x).bitwiseXOR(F.when(F.col("depth") > 0, h)) for x, h in zip(("x1", "x2"), salted(F.col("last"), F.col("depth")), strict=True)]
    return rows.select(*NODE, back[0].alias("p1"), back[1].alias("p2"), F.when(F.col("depth") > 0, bytes_of(F.col("last"))).otherwise(0).alias("bytes"), *sums)


def digests(ends: DataFrame) -> DataFrame:
    """ends: (depth, x1, x2, conv_id).  The SHA-256 of each node's ids in order, comma-joined: ids are put together
    by ranges of at most ``2 ** CHUNK_BITS`` ids first, and the hash reads these rows one after the other."""
    chunk = F.shiftright("conv_id", CHUNK_BITS)
    rows = ends.groupBy(*NODE, chunk.alias("chunk")).agg(F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda i: i.cast("string")), ",").alias("ids"))

    def run(batches):
        at, state = None, None

        def out(done):
            return pa.RecordBatch.from_arrays([*(pa.array([d[k] for d in done], pa.int64()) for k in range(3)), pa.array([d[3] for d in done])], [*NODE, "sha"])

        for batch in batches:
            done = []
            for *key, ids in zip(*(batch.column(c).to_pylist() for c in (*NODE, "ids")), strict=True):
                if key != at:
                    if at is not None:
                        done.append((*at, state.hexdigest()))
                    at, state = key, hashlib.sha256()
                    state.update(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            if done:
                yield out(done)
        if at is not None:
            yield out([(*at, state.hexdigest())])

    return rows.repartition(*NODE).sortWithinPartitions(*NODE, "chunk").mapInArrow(run, "depth long, x1 long, x2 long, sha string")


def trie(conversations: DataFrame, family: int = FAMILY, shared: int = SHARED) -> DataFrame:
    """One row a node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens
    and ends_sha256."""
    turns = conversations.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), turn_id(F.col("role"), F.col("text")).alias("t"))
    blocks = blocks_of(rebuilt(turns, family, shared))
    nodes = cut(rolled(blocks, {"rep": "min(conv_id)", "n_convs": "count(*)"}), "nodes")
    node = lambda *c: F.struct(*[F.col(x).alias(n) for x, n in zip(c, NODE, strict=True)])
    children = nodes.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("x1"), F.col("p2").alias("x2")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children, [*NODE], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    nodes = nodes.withColumn("amount", (F.col("n_convs") - 1) * F.col("bytes")).withColumn("leaf", (F.col("n_children") == 0).cast("long"))
    nodes = cut(running(nodes, ["rep"], "depth", {"above": ("amount", *_SUM)}), "nodes-with-children")

    # What is booked with each conversation, met with its blocks: once a conversation, and again a block.
    booked = nodes.groupBy(F.col("rep").alias("c")).agg(F.sum("amount").alias("amount"), F.sum("leaf").alias("leaves"))
    here = xor_over([F.col(f"t{i + 1}") for i in range(WIDTH)], F.col("block") * WIDTH, (F.col("x1"), F.col("x2")))
    filled = sum((F.col(f"t{i + 1}").isNotNull().cast("long") for i in range(1, WIDTH)), F.col("t1").isNotNull().cast("long"))
    tip = F.max(F.struct("block", (F.col("block") * WIDTH + filled).alias("depth"), here[0].alias("x1"), here[1].alias("x2"))).alias("tip")
    convs = blocks.groupBy(F.col("conv_id").alias("c")).agg(F.count("*").alias("n"), tip).join(booked, "c", "left")
    convs = cut(convs.select("c", "n", "tip.depth", "tip.x1", "tip.x2", F.coalesce("amount", F.lit(0)).alias("amount"), F.coalesce("leaves", F.lit(0)).alias("leaves")), "booked")
    bound = join_split(blocks, convs.select("c", "n", "amount", "leaves"), F.col("conv_id"), F.col("c"), "n")
    sums = rolled(bound, {"booked": "sum(amount)", "n_leaves": "sum(leaves)"}).select(*NODE, "booked", "n_leaves")
    ends = digests(convs.select(*NODE, F.col("c").alias("conv_id")))

    parents = nodes.filter("n_children > 0").select(node(*NODE).alias("of"), F.col("rep").alias("parent_conv_id"), F.col("n_children").alias("n"))
    inner = nodes.filter("depth > 0").withColumn("below", F.struct((F.col("depth") - 1).alias("depth"), F.col("p1").alias("x1"), F.col("p2").alias("x2")))
    known = join_split(inner, parents, F.col("below"), F.col("of"), "n").drop("below", "of", "n")
    known = known.unionByName(nodes.filter("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long")))
    out = known.join(sums, [*NODE]).join(ends, [*NODE], "left")
    return out.select(
        F.col("rep").alias("conv_id"),
        "depth",
        "parent_conv_id",
        "n_convs",
        "n_children",
        "n_leaves",
        (F.col("booked") - F.coalesce("above", F.lit(0))).alias("saved_tokens"),
        F.coalesce("sha", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )
