"""Benchmark decontamination: find every occurrence of a benchmark's 13-word windows.

The test side becomes a table of word windows (an item of fewer words is one window).  Any
occurrence of a window of at least L words holds, at every alignment, a gram of g words that
starts at a multiple of L - g + 1; so only those grams of a document are probed, with the same
completeness as probing all, against a hash set of the test side's grams (broadcast behind a
row count, else joined by shuffle).  Documents that are hit are then matched window by window,
as text, and covered word positions are counted.

Edge cases: null or empty texts have no words and no hits.  Null ids and repeated rows are
kept, one row per input row: rows are told apart by id and text hash, and equal rows have equal
results, so ties need no order.  Items without an id count for hits and are left out of the item
lists only.  Very long texts are one row; only those that are hit are cut into windows.  Empty
tables (either side) give no hits; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm._common import cut, lower_ascii, pinned, small

WINDOW, GRAM = 13, 3
#: What lies between words, before lower-casing: ASCII that is neither digit nor letter.
BETWEEN = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"


def _words(text: Column) -> Column:
    return F.filter(F.split(text, BETWEEN), lambda w: w != "")


def _windows(words: str, length: Column | int) -> Column:
    """Array of (pos, window as text); empty where there are fewer words."""
    n = F.lit(length) if isinstance(length, int) else length
    some = F.sequence(F.lit(0), F.size(words) - n)
    return F.when(F.size(words) >= n, F.transform(some, lambda i: F.struct(i.alias("pos"), F.concat_ws(" ", F.slice(words, i + 1, n)).alias("window"))))


def test_windows(benchmark: DataFrame) -> DataFrame:
    """(len, window, items): every distinct window with the items that have it (those with an id)."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), _words(lower_ascii(F.coalesce(F.col("text"), F.lit("")))).alias("w")).filter("size(w) > 0")
    length = F.least(F.size("w"), F.lit(WINDOW))
    return items.select("item", length.alias("len"), F.explode(_windows("w", length)).alias("x")).select("len", F.col("x.window").alias("window"), "item").groupBy("len", "window").agg(F.collect_set("item").alias("items"))


def _grams(words: Column, gram: int, stride: int) -> Column:
    """Hashes of the ``gram``-word runs at multiples of ``stride``."""
    at = F.sequence(F.lit(0), F.size(words) - gram, F.lit(stride))
    hashed = lambda i: F.xxhash64(lower_ascii(F.concat_ws(" ", *[F.get(words, i + k) for k in range(gram)])))
    return F.when(F.size(words) >= gram, F.transform(at, hashed)).otherwise(F.array().cast("array<bigint>"))


def find(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_words, n_hit, items (hit items as sorted strings) and spans
    (start, end word positions of each covered stretch, end exclusive)."""
    windows = cut(test_windows(benchmark), "windows")
    lengths = sorted(r["len"] for r in windows.select("len").distinct().limit(WINDOW).collect())  # 13 values at most
    docs = docs.select(docs[id_col].alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    key = F.xxhash64("text").alias("th")
    least = lengths[0] if lengths else WINDOW
    gram = min(GRAM, least)
    base = docs.select("doc_id", key, pinned(_words(F.col("text"))).alias("w"))
    base = cut(base.select("doc_id", "th", F.size("w").cast("long").alias("n_words"), _grams(F.col("w"), gram, least - gram + 1).alias("grams")), "probes")
    none = F.array().cast("array<string>")
    if not lengths:
        return base.select("doc_id", "n_words", F.lit(0).cast("long").alias("n_hit"), none.alias("items"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))
    parts = F.split("window", " ")
    tested = windows.select(F.explode(F.transform(F.sequence(F.lit(0), F.size(parts) - gram), lambda i: F.xxhash64(F.concat_ws(" ", *[F.get(parts, i + k) for k in range(gram)])))).alias("gram")).distinct()
    hit = base.select("doc_id", "th", F.explode("grams").alias("gram")).join(small(tested), "gram", "left_semi").select("doc_id", "th").distinct()
    hit = cut(hit, "candidates")
    again = docs.select("doc_id", key, "text").alias("d").join(small(hit).alias("h"), F.col("d.doc_id").eqNullSafe(F.col("h.doc_id")) & (F.col("d.th") == F.col("h.th")), "left_semi")
    again = again.dropDuplicates(["doc_id", "th"]).select("doc_id", "th", pinned(_words(lower_ascii(F.col("text")))).alias("w"))
    each = again.select("doc_id", "th", "w", F.explode(F.array(*[F.lit(n) for n in lengths])).alias("len")).select("doc_id", "th", "len", F.explode(_windows("w", F.col("len"))).alias("x"))
    met = each.select("doc_id", "th", "len", "x.pos", "x.window").join(small(windows), ["len", "window"])
    seen = met.groupBy("doc_id", "th").agg(F.sort_array(F.collect_set(F.struct("pos", "len"))).alias("at"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    start = F.expr("cast(array() as array<struct<start:int,end:int>>)")
    # Covered word positions in order; a stretch begins and ends where its neighbour is missing.
    seen = seen.withColumn("p", pinned(F.array_sort(F.array_distinct(F.flatten(F.transform("at", lambda x: F.sequence(x["pos"], x["pos"] + x["len"] - 1)))))))
    begins = F.filter("p", lambda x, i: F.coalesce(F.get("p", i - 1) < x - 1, F.lit(True)))
    ends = F.filter("p", lambda x, i: F.coalesce(F.get("p", i + 1) > x + 1, F.lit(True)))
    seen = seen.withColumn("f", pinned(begins)).withColumn("g", pinned(ends))
    spans = F.transform("f", lambda x, i: F.struct(x.alias("start"), (F.get("g", i) + 1).alias("end")))
    seen = seen.select(F.col("doc_id").alias("i"), F.col("th").alias("k"), "items", F.size("p").cast("long").alias("n_hit"), spans.alias("spans"))
    seen = small(cut(seen, "hits"))
    out = base.join(seen, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("th") == F.col("k")), "left")
    return out.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", none).alias("items"), F.coalesce("spans", start).alias("spans"))


CONTAMINATED = "n_hit > 0 and 20 * n_hit >= n_words"


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without contaminated documents (at least a twentieth of the words lies in test
    windows); all others stay as they are.  Rows without an id are judged by their text alone."""
    th = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    named = docs.select(F.struct(F.col("doc_id"), th.alias("th")).alias("key"), "text")
    bad = find(named, benchmark, id_col="key").filter(CONTAMINATED).select(F.col("doc_id.doc_id").alias("i"), F.col("doc_id.th").alias("k")).distinct()
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("id"), th.alias("th"))
    return rows.join(small(cut(bad, "contaminated")), F.col("id").eqNullSafe(F.col("i")) & (F.col("th") == F.col("k")), "left_anti").select("row.*")
