"""Line dedup with content-defined chunks.

First the lines are hashed: which pairs of neighbouring lines, and which long lines (``LONG``
characters or more), occur again anywhere.  A long line is a chunk of its own.  Other lines are
parted where that status of neighbouring pairs changes, so a repeated passage starts and ends its own
chunks whatever stands around it.  Inside, a rolling hash over the hashes of two neighbouring lines
ends a chunk where it is a multiple of ``DIVISOR`` and was none a line before; in repeated passages
both sides keep ``LEAST_LINES`` lines, so an inserted or removed line moves boundaries only near
itself.  A short line between long ones is compared together with its neighbour.  Repeated chunks
are compared as bytes, and all but the first occurrence (by id, then text hash, then position) are
removed.

What stays: short lines that are repeated alone (by design, as are chunks of under ``LEAST_CHARS``
characters), and runs in which every pair is repeated but which are put together from different places.

Edge cases: null text is empty and gives one empty line.  Rows with equal id and text count as
one document, so none of them loses a chunk to another.  Null ids come first.  Empty tables give
empty results; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm._common import BROADCAST_ROWS, WHITE_CHARS, cut, join_split, pinned, small

DIVISOR, LEAST_LINES, LEAST_CHARS, LONG = 3, 2, 40, 160


def hashed(docs: DataFrame) -> DataFrame:
    """docs with _l (lines), _h (their hashes) and _g (whether each is long)."""
    df = docs.withColumn("_l", pinned(F.split("text", "\n")))
    df = df.withColumn("_h", pinned(F.transform("_l", lambda x: F.xxhash64(x))))
    return df.withColumn("_g", pinned(F.transform("_l", lambda x: F.length(x) >= LONG)))


def keys(docs: DataFrame) -> DataFrame:
    """(doc_id, th, k): k.key of each long line (k.at is twice its position) and of each pair of neighbouring
    lines that are not both long (k.at is one more than twice the later one's position)."""
    df = hashed(docs)
    at = F.sequence(F.lit(0), F.size("_l") - 1)
    alone = F.transform(F.filter(at, lambda i: F.get("_g", i)), lambda i: F.struct((2 * i).alias("at"), F.xxhash64(F.lit(1), F.get("_h", i)).alias("key")))
    some = F.filter(at, lambda i: (i > 0) & ~(F.get("_g", i) & F.get("_g", i - 1)))
    pairs = F.transform(some, lambda i: F.struct((2 * i + 1).alias("at"), F.xxhash64(F.get("_h", i - 1), F.get("_h", i)).alias("key")))
    return df.select("doc_id", "th", F.explode(F.concat(alone, pairs)).alias("k"))


def chunked(docs: DataFrame) -> DataFrame:
    """docs (doc_id, th, text, _p: the repeated ones of ``keys``, by k.at) with _l (lines) and _c: array of
    (pos, at, n, f, m), one per chunk; lines from f on, m of them, are compared (m = 0: nothing is)."""
    df = hashed(docs).withColumn("_p", F.coalesce("_p", F.array().cast("array<int>")))
    df = df.withColumn("_e", pinned(F.transform(F.sequence(F.lit(0), F.size("_l")), lambda i: F.array_contains("_p", 2 * i + 1))))
    is_long = lambda i: F.coalesce(F.get("_g", i), F.lit(False))
    again = lambda i: F.coalesce(F.get("_e", i), F.lit(False))
    inner = lambda i: again(i) & ~is_long(i) & ~is_long(i - 1)
    ends = lambda i: F.pmod(F.xxhash64(F.get("_h", i - 2), F.get("_h", i - 1)), F.lit(DIVISOR)) == 0

    def starts(i):
        repeated = inner(i - 1) & inner(i + 1) & ends(i) & ~(inner(i - 2) & ends(i - 1))
        return (i == 0) | is_long(i) | is_long(i - 1) | F.when(again(i), repeated).otherwise(again(i - 1) | again(i + 1) | ends(i))

    df = df.withColumn("_b", pinned(F.filter(F.sequence(F.lit(0), F.size("_l") - 1), starts)))
    length = lambda b, j: F.coalesce(F.get("_b", j + 1), F.size("_l")) - b

    def chunk(b, j):
        n = length(b, j)
        single = F.when(is_long(b), F.when(F.array_contains("_p", 2 * b), 1).otherwise(0)).when(again(b + 1) | again(b), 2).otherwise(0)
        compared = F.when(n >= LEAST_LINES, F.when(again(b + 1), n).otherwise(0)).otherwise(single)
        back = (n == 1) & ~is_long(b) & ~again(b + 1) & again(b)
        return F.struct(j.alias("pos"), b.alias("at"), n.alias("n"), F.when(back, b - 1).otherwise(b).alias("f"), compared.alias("m"))

    return df.withColumn("_c", pinned(F.transform("_b", chunk)))


def _text(lines: str, c: str):
    return F.concat_ws("\n", F.slice(lines, F.col(f"{c}.f") + 1, F.col(f"{c}.m")))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_lines, n_chunks, removed_chunks, removed_lines, clean_text."""
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    docs = docs.select(docs[id_col].alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))
    repeated = cut(keys(docs).groupBy("k.key").agg(F.count("*").alias("_n")).filter("_n > 1").select(F.col("key").alias("_r"), "_n"), "repeated")
    few = repeated.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    key = F.col("k.key"), F.col("_r")
    where = keys(docs).join(F.broadcast(repeated), key[0] == key[1], "left_semi") if few else join_split(keys(docs), repeated, *key, "_n", "left_semi")
    where = where.groupBy("doc_id", "th").agg(F.collect_set("k.at").alias("_p"))
    where = cut(where.select(F.col("doc_id").alias("_i"), F.col("th").alias("_t"), "_p"), "where")
    same = lambda: F.col("doc_id").eqNullSafe(F.col("_i")) & (F.col("th") == F.col("_t"))
    several = chunked(docs.join(small(where), same())).select("doc_id", "th", "_l", F.explode("_c").alias("c")).filter("c.m > 0")
    several = several.select("doc_id", "th", "c.pos", "c.n", _text("_l", "c").alias("chunk"))
    several = cut(several.filter(F.length(F.translate("chunk", WHITE_CHARS, "")) >= LEAST_CHARS), "chunks")
    place = lambda: F.struct("doc_id", "th", "pos")
    # Grouped and joined by the bytes themselves.
    first = cut(several.groupBy(F.col("chunk").alias("_k")).agg(F.count("*").alias("_n"), F.min(place()).alias("_first")).filter("_n > 1"), "firsts")
    gone = join_split(several, first, F.col("chunk"), F.col("_k"), "_n").filter(~place().eqNullSafe(F.col("_first")))
    gone = gone.select("doc_id", "th", "pos", "n").distinct().groupBy("doc_id", "th").agg(F.collect_set("pos").alias("_gone"), F.sum("n").alias("_lines"))
    gone = gone.select(F.col("doc_id").alias("_j"), F.col("th").alias("_u"), "_gone", "_lines")
    where = where.join(small(cut(gone, "gone")), F.col("_i").eqNullSafe(F.col("_j")) & (F.col("_t") == F.col("_u")), "left").select("_i", "_t", "_p", "_gone", "_lines")
    out = chunked(docs.join(small(cut(where, "gone-where")), same(), "left"))
    none = F.array().cast("array<int>")
    kept = F.filter("_c", lambda c: ~F.array_contains(F.coalesce(F.col("_gone"), none), c["pos"]))
    clean = F.concat_ws("\n", F.flatten(F.transform(kept, lambda c: F.slice("_l", c["at"] + 1, c["n"]))))
    return out.select(
        "doc_id",
        F.size("_l").cast("long").alias("n_lines"),
        F.size("_c").cast("long").alias("n_chunks"),
        F.size(F.coalesce("_gone", none)).cast("long").alias("removed_chunks"),
        F.coalesce("_lines", F.lit(0)).cast("long").alias("removed_lines"),
        F.when(F.col("_gone").isNull(), F.col("text")).otherwise(clean).alias("clean_text"),
    )
