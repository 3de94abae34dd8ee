"""Exact Jaccard self-join of documents on 5-word shingles, by universe partitioning.

Documents with equal shingle sets form a *class*; one text of each class goes on.  Set sizes
fall into bands.  A pair is looked for in the band of its smaller set, where the hash space is
cut into ``m`` segments.  Two sets whose symmetric difference is at most ``H`` differ by
``depth`` or more in at most ``H // depth`` segments, so with ``m`` segments at least
``m - H // depth`` match: wholly (depth 1), or up to one shingle (depth 2, found through
one-deletion neighbourhoods).  ``m`` is larger than needed by ``2 * spare``, so either side may
leave segments out: the smallest (least selective) when they are indexed, and then the most
frequent ones once counts are known.  ``plan`` picks depth and spare per band by their cost.

Candidates are compared by sketches first: each set's hashes counted in ``BINS`` bins, whose differences add up
to the symmetric difference at most; so no text moves for a pair that these show to be too far apart.  The others
are verified on their texts.  Within the documents that share a segment each
meets the group's first; only documents that are still in different components meet later.
These (large clouds of near copies, documents that share a passage) are not paired: the partition
is refined for them to segments of one shingle.  Of these a linked pair has four ninths of both sizes in
common, so each side leaves out the frequent ones as far as every size of partner allows, and rows of a
group meet only where enough shingles are left on both sides (``refined``).  There each set meets
the most central set of its group, and of the rest only pairs across components meet.

Edge cases: null or empty text, or text without words: no shingles, linked with nothing.
Null ``doc_id``: counted, never linked, component null.  Rows that share a ``doc_id`` are one
node, and equal rows give equal rows.  Equal sets are one class, whichever row stands for it; the least id
names a component, so ties change nothing.  Very long texts are one row with many signatures, cut up
by numpy.  Empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm._common import arrow_batches, cut, discard, join_split, partitions, scratch, small
from gridloom.llm.components import components

WORDS, SHARE = 5, (80, 100)
BAND_RATIO = 1.6
#: A segment seen in more documents of one task than this goes out row by row, dealt at random.
HOT = 48
#: Signatures that one segment forced on (nearly) empty content is counted as, in ``plan``.
FORCED = 8

_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]
_S = [np.uint64(x) for x in (30, 27, 31, 32, 33)]


def mix(x):
    """Finaliser that spreads every input bit (arrays of uint64, wrapping)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _S[0])) * _M[1]
        x = (x ^ (x >> _S[1])) * _M[2]
        return x ^ (x >> _S[2])


class WordHashes(dict):
    """word -> 64-bit hash, kept while it is small."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        value = xxhash.xxh64_intdigest(word)
        if len(word) <= 64:
            if len(self) > 100_000:
                self.clear()
            self[word] = value
        return value


def words_of(text: str | None) -> list[bytes]:
    """ASCII-lower-cased words between ASCII white space."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingle_hashes(words: list[bytes], hashes: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the 5-word shingles (all words as one where there are fewer)."""
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    k = min(WORDS, len(words))
    with np.errstate(over="ignore"):
        acc = np.full(len(words) - k + 1, k, np.uint64)
        for j in range(k):
            acc = mix(acc * _M[0] + h[j : len(words) - k + 1 + j])
    return np.unique(acc)


def shingles(words: list[bytes]) -> set:
    """The same set as words, for exact verification."""
    if len(words) < WORDS:
        return {tuple(words)} if words else set()
    return set(zip(*(words[j:] for j in range(WORDS)), strict=False))


def linked(a: set, b: set) -> bool:
    both = len(a & b)
    return bool(a) and bool(b) and SHARE[1] * both >= SHARE[0] * (len(a) + len(b) - both)


# ---- the plan of bands -------------------------------------------------------------------


@lru_cache(None)
def edges_upto(size: int) -> tuple[int, ...]:
    out = [1]
    while out[-1] <= size:
        out.append(max(out[-1] + 1, int(out[-1] * BAND_RATIO)))
    return tuple(out)


@lru_cache(100_000)
def band(size: int) -> int:
    return int(np.searchsorted(edges_upto(size), size, "right")) - 1


def most_apart(total: int) -> int:
    """Largest symmetric difference of a linked pair whose sizes sum to ``total`` or less."""
    least = lambda t: -(-t * SHARE[0] // (SHARE[0] + SHARE[1]))  # noqa: E731  intersection needed
    return max([0, *(t - 2 * least(t) for t in range(max(2, total - 9), total + 1))])


def larger(size: int) -> int:
    return size * SHARE[1] // SHARE[0]


@lru_cache(None)
def plan(k: int, depths: tuple[int, ...] = (1, 2)) -> tuple[int, int, int]:
    """(depth, segments, spare) of band k: the cheapest by signatures written, and by what is
    expected to be forced on empty or one-shingle segments, which match far too often."""
    e = edges_upto(2**40)
    a, b = e[k], e[k + 1] - 1
    apart = most_apart(b + larger(b))
    best = None
    for depth in depths:
        for spare in sorted({0, 1, 2, 3, 2 + apart // 24, 2 + apart // 16, 2 + apart // 12}):
            m = apart // depth + 1 + 2 * spare
            cost = 0.0
            for size in {a, (a + b) // 2, b}:
                kept = min(m, -(-(m + apart // depth + 1) // 2))
                mean = size / m
                poor = math.exp(-mean) if depth == 1 else math.exp(-mean) * (1 + mean)
                useful = m * (1 - poor) - 2 * math.sqrt(m * poor * (1 - poor))
                cost += kept * (1 if depth == 1 else 1 + mean) + FORCED * max(0.0, kept - useful)
            if best is None or cost < best[0]:
                best = (cost, depth, m, spare)
    return best[1:]


def roles(size: int) -> list[tuple[int, int, int]]:
    """(band, role, largest distance) under which a set of this size is indexed: role 0 in its
    own band, role 1 in each lower band that can hold a smaller partner."""
    if larger(size) == size:  # only an equal set could be linked
        out = []
    else:
        out = [(band(size), 0, most_apart(size + larger(size)))]
    e, k, least = edges_upto(size), band(size) - 1, -(-size * SHARE[0] // SHARE[1])
    while k >= 0 and e[k + 1] - 1 >= least:
        out.append((k, 1, most_apart(size + e[k + 1] - 1)))
        k -= 1
    return out


DELETED = 32


def signatures(s: np.ndarray, mixed: np.ndarray, depths: tuple[int, ...] = (1, 2)):
    """Yield (signatures, metas) for one sorted set.  A meta holds the role (16), whether a shingle was
    deleted (32), and in its low bits how many signatures may still be left out."""
    for k, role, apart in roles(len(s)):
        depth, m, spare = plan(k, depths)
        with np.errstate(over="ignore"):
            seg = ((s >> _S[3]) * np.uint64(m)) >> _S[3]
            starts = np.flatnonzero(np.concatenate(([True], seg[1:] != seg[:-1])))
            ids = seg[starts]
            sums = np.add.reduceat(mixed, starts)
            counts = np.diff(np.append(starts, len(s)))
            least = min(m, -(-(m + apart // depth + 1) // 2))
            want = min(m, least + (spare + 1) // 2)
            if len(ids) > want:
                keep = np.sort(np.argsort(-counts, kind="stable")[:want])
            else:
                keep = np.arange(len(ids))
            salt = lambda i: mix(i * _M[0] + np.uint64(k * 4 + depth) * _M[2])
            out = [mix(sums[keep] ^ salt(ids[keep]))]
            if (lack := least - len(keep)) > 0:
                empty = np.setdiff1d(np.arange(m, dtype=np.uint64), ids)[:lack]
                out.append(mix(np.uint64(0) ^ salt(empty)))
            if depth == 2:
                kept = np.isin(seg, ids[keep])
                which = np.searchsorted(ids, seg[kept])
                out.append(mix((sums[which] - mixed[kept]) ^ salt(seg[kept])))
        slack = max(0, min(15, len(keep) - least)) if depth == 1 else 0
        sigs = np.concatenate(out)
        meta = np.full(len(sigs), role << 4 | slack, np.uint8)
        if depth == 2:
            meta[len(sigs) - len(out[-1]) :] |= DELETED
        yield sigs, meta


# ---- Spark stages ------------------------------------------------------------------------

ROWS = "kind int, sig long, h1 long, meta int, doc_id long, n_shingles long, h2 long, sketch binary"
SHARED, PROFILE = 0, 1
#: Texts that a task unpacks at a time.
SLICE = 256
#: Documents whose signatures are packed together.
PACK = 1500
#: Bytes of signatures of a bucket, about; a task holds one bucket at a time.  Signatures take that many bytes a
#: byte of text, about.
BUCKET_BYTES, GROWTH = 8 << 20, 1.6
#: Bins of a sketch; each counts to 255.
BINS = 128
#: Bytes of a batch between Spark and Python.
BATCH_BYTES = 8 << 20


def sketch(s: np.ndarray) -> bytes:
    """How many of a set's hashes lie in each bin."""
    return np.minimum(np.bincount((s >> np.uint64(64 - BINS.bit_length() + 1)).astype(np.int64), minlength=BINS), 255).astype(np.uint8).tobytes()


def indexed_rows(docs: DataFrame, depths: tuple[int, ...] = (1, 2)) -> DataFrame:
    """Rows of two kinds, from one pass over the texts.  PROFILE: doc_id, size and 128-bit hash of the
    set of each input row.  SHARED: (sig, h1, meta) of every signature that two or more
    classes have (rows may repeat).

    Signatures travel in packed blocks, dealt by bucket.  A signature that is frequent among the
    documents packed together keeps two markers in its bucket and sends the rest in blocks dealt at
    random, so what one task gathers of it is bounded by ``HOT`` times the number of packs."""
    spark = docs.sparkSession
    text_bytes = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(partitions(spark), math.ceil(GROWTH * text_bytes / BUCKET_BYTES))
    names = ["bucket", "sigs", "handles", "metas", "ids", "sketches"]
    rows = [x.split() for x in ROWS.split(", ")]
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    schema = pa.schema([(n, kinds[k]) for n, k in rows])
    signed = lambda x: pa.array(x.view(np.int64))

    def packed(to, parts):
        """One row per value of the sorted ``to``."""
        at = np.flatnonzero(np.concatenate(([True], to[1:] != to[:-1])))
        till = np.append(at[1:], len(to))
        blocks = [[x[i:j].tobytes() for i, j in zip(at, till, strict=True)] for x in parts]
        return pa.RecordBatch.from_arrays([pa.array(to[at].astype(np.int32)), *(pa.array(b, pa.binary()) for b in blocks), *[pa.nulls(len(at), pa.binary())] * 2], names)

    def emit(batches):
        hashes, turn = WordHashes(), 0
        for batch in batches:
            for start in range(0, batch.num_rows, PACK):
                part = batch.slice(start, PACK)
                sigs, who, meta, profile, sketches = [], [], [], [], []
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    s = shingle_hashes(words_of(text), hashes)
                    with np.errstate(over="ignore"):
                        mixed = mix(s * _M[1] + _M[2])
                        h = mix(np.add.reduce(mixed, dtype=np.uint64) + np.uint64(len(s)))
                        profile.append((doc_id is None, doc_id or 0, len(s), h, np.add.reduce(mix(s + _M[2]), dtype=np.uint64)))
                    sketches.append(sketch(s))
                    if len(s) and doc_id is not None:
                        for sig, m in signatures(s, mixed, depths):
                            sigs.append(sig)
                            who.append(np.full(len(sig), h, np.uint64))
                            meta.append(m)
                turn += 1
                null, ids, n, h1, h2 = (np.array(x, t) for x, t in zip(zip(*profile, strict=True), (np.uint8, np.int64, np.int64, np.uint64, np.uint64), strict=True))
                yield pa.RecordBatch.from_arrays([pa.array([2 * buckets + (hash_of(h1) + turn) % buckets], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in (h1, h2, n, np.concatenate([ids.view(np.uint8), null]))), pa.array([b"".join(sketches)], pa.binary())], names)
                if not sigs:
                    continue
                sig, h, m = map(np.concatenate, (sigs, who, meta))
                order = np.argsort(sig)
                sig, h, m = sig[order], h[order], m[order]
                first = np.flatnonzero(np.concatenate(([True], sig[1:] != sig[:-1])))
                size = np.diff(np.append(first, len(sig)))
                to = (((sig >> _S[3]) * np.uint64(buckets)) >> _S[3]).astype(np.int64)
                if (size > HOT).any():
                    # Markers: the first of the run, and the first that differs from it.
                    run = np.repeat(np.arange(len(first)), size)
                    differs = np.flatnonzero(h != h[first][run])
                    second = differs[np.unique(run[differs], return_index=True)[1]]
                    hot = np.repeat(size > HOT, size)
                    hot[first] = False
                    hot[second] = False
                    far = (mix(h[hot] ^ sig[hot]) % np.uint64(buckets)).astype(np.int64) + buckets
                    order = np.argsort(far, kind="stable")
                    yield packed(far[order], [x[hot][order] for x in (sig, h, m)])
                    to, sig, h, m = to[~hot], sig[~hot], h[~hot], m[~hot]
                yield packed(to, (sig, h, m))
        pa.default_memory_pool().release_unused()  # a worker that waits for its next task holds on to it

    def gather(batches):
        """Rows come in the order of their buckets; the signatures of one bucket are held at a time."""
        at, cold = None, [[], [], []]

        def shared(s, h, m):
            nothing = pa.nulls(len(s), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(s), SHARED, np.int32)), signed(s), signed(h), pa.array(m.astype(np.int32)), nothing, nothing, nothing, pa.nulls(len(s), pa.binary())], schema=schema)

        def several_of(parts):
            sig, h, m = map(np.concatenate, parts)
            order = np.argsort(sig)
            sig, h, m = sig[order], h[order], m[order]
            first = np.flatnonzero(np.concatenate(([True], sig[1:] != sig[:-1])))
            size = np.diff(np.append(first, len(sig)))
            several = np.logical_or.reduceat(h != np.repeat(h[first], size), first)
            keep = np.flatnonzero(np.repeat(several, size))
            for i in range(0, len(keep), 100_000):
                k = keep[i : i + 100_000]
                yield shared(sig[k], h[k], m[k])

        for batch in batches:
            for k in range(batch.num_rows):
                b, s, h, m, ids, drawn = (c[k].as_py() for c in batch.columns)
                if b >= 2 * buckets:
                    h1, h2, n = np.frombuffer(s, np.uint64), np.frombuffer(h, np.uint64), np.frombuffer(m, np.int64)
                    own, null = np.frombuffer(ids, np.int64, len(n)), np.frombuffer(ids, np.uint8, len(n), 8 * len(n)).astype(bool)
                    nothing, less = pa.nulls(len(n), pa.int64()), pa.nulls(len(n), pa.int32())
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), PROFILE, np.int32)), nothing, signed(h1), less, pa.array(own, mask=null), pa.array(n), signed(h2), pa.array([drawn[i : i + BINS] for i in range(0, len(drawn), BINS)], pa.binary())], schema=schema)
                    continue
                parts = [np.frombuffer(s, np.uint64), np.frombuffer(h, np.uint64), np.frombuffer(m, np.uint8)]
                if b >= buckets:
                    yield shared(*parts)
                    continue
                if b != at and cold[0]:
                    yield from several_of(cold)
                    cold = [[], [], []]
                at = b
                for to, x in zip(cold, parts, strict=True):
                    to.append(x)
        if cold[0]:
            yield from several_of(cold)
        pa.default_memory_pool().release_unused()

    blocks = docs.select("doc_id", "text").mapInArrow(emit, "bucket int, sigs binary, handles binary, metas binary, ids binary, sketches binary")
    return blocks.repartition(partitions(spark), "bucket").sortWithinPartitions("bucket").mapInArrow(gather, ROWS)


def hash_of(x: np.ndarray) -> int:
    return int(x[0] >> _S[4]) if len(x) else 0


def shared_rows(rows: DataFrame) -> DataFrame:
    """(sig, h1, role, deleted, slack, c), once each, of groups that can hold a pair: one of their documents
    has the band as its own and all of its shingles."""
    bit = lambda n: F.col("meta").bitwiseAND(n) > 0
    each = rows.filter(F.col("kind") == SHARED).groupBy("sig", "h1").agg(F.min("meta").alias("meta"))
    each = cut(each.select("sig", "h1", bit(16).alias("lower"), bit(DELETED).alias("deleted"), F.col("meta").bitwiseAND(15).alias("slack")), "signatures")
    counts = each.groupBy(F.col("sig").alias("of")).agg(F.count("*").alias("c"), F.bool_or(~F.col("lower")).alias("own"), F.bool_or(~F.col("deleted")).alias("full")).filter("c > 1 and own and full")
    return join_split(each, cut(counts.select("of", "c"), "counts"), F.col("sig"), F.col("of"), "c").drop("of")


def allocated(shared: DataFrame) -> DataFrame:
    """Leave out, of each set, the most frequent signatures that its slack allows."""
    rank = F.row_number().over(Window.partitionBy("h1", "lower").orderBy(F.col("c").desc(), "sig"))
    return shared.withColumn("r", rank).filter("c <= 2 or r > slack").select("sig", "h1", "lower", "deleted")


def stars(indexed: DataFrame) -> DataFrame:
    """(x, y, lead, h1): each document of a group with the group's first."""
    first = F.min(F.when(~F.col("lower"), F.struct("deleted", "h1"))).alias("first")
    lead = cut(indexed.groupBy(F.col("sig").alias("of")).agg(first, F.count("*").alias("c")).filter("first is not null"), "leads")
    met = join_split(indexed, lead, F.col("sig"), F.col("of"), "c").filter("first.h1 <> h1")
    return met.select(F.least("first.h1", "h1").alias("x"), F.greatest("first.h1", "h1").alias("y"), F.col("first.h1").alias("lead"), "h1")


# ---- groups that stay apart: the partition refined to single shingles ---------------------

#: Ratio of neighbouring size classes in the refined index.
CLASS_RATIO = 1.05


def size_class(n: Column) -> Column:
    return F.floor(F.log(n.cast("double")) / F.lit(math.log(CLASS_RATIO))).cast("int")


def set_hashes(docs: DataFrame) -> DataFrame:
    """(h1, s): each set once, as the array of its shingle hashes."""

    def run(batches):
        hashes = WordHashes()
        for batch in batches:
            for k in range(0, batch.num_rows, SLICE):
                sets = [shingle_hashes(words_of(t), hashes) for t in batch.column(0).slice(k, SLICE).to_pylist()]
                with np.errstate(over="ignore"):
                    h1 = [mix(np.add.reduce(mix(x * _M[1] + _M[2]), dtype=np.uint64) + np.uint64(len(x))) for x in sets]
                lists = pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(np.array(h1, np.uint64).view(np.int64)), lists], ["h1", "s"])

    return docs.select("text").mapInArrow(run, "h1 long, s array<long>").dropDuplicates(["h1"])


def refined(sets: DataFrame) -> DataFrame:
    """(sig, of, h1, n, left, small): ``sets`` under the segments of the finest partition, one shingle
    each, the frequent ones left out.

    A linked pair of sizes b <= a has ``need(a, b)`` of these in common.  So in the order of rising
    frequency (shingles of one set alone come first) the first common one has at least that many
    left, itself included, on either side.  The smaller set is indexed under its own size class
    where that holds for any partner, the larger one under the classes of the partners that it
    still can have; all else is left out.  ``left``: shingles from this one on."""
    each = cut(sets.select("h1", F.size("s").alias("n"), F.explode("s").alias("sig")), "shingles")
    counts = cut(each.groupBy(F.col("sig").alias("s")).agg(F.count("*").alias("c")).filter("c > 1"), "counts")
    # Ranks count from the end, so shingles that no other set has need no row.
    rank = F.row_number().over(Window.partitionBy("h1").orderBy(F.col("c").desc(), F.col("sig").desc()))
    kept = join_split(each, counts, F.col("sig"), F.col("s"), "c").drop("s").withColumn("left", rank)
    low, high = F.ceil(F.col("n") * SHARE[0] / SHARE[1]), F.least(F.col("n"), F.floor(F.col("left") * (SHARE[0] + SHARE[1]) / SHARE[0]) - F.col("n"))
    smaller = kept.filter(f"{SHARE[0] + SHARE[1]} * left >= {2 * SHARE[0]} * n").select("sig", size_class(F.col("n")).alias("of"), "h1", "n", "left", F.lit(True).alias("small"))
    larger = kept.withColumn("low", low).withColumn("high", high).filter("low <= high")
    larger = larger.select("sig", F.explode(F.sequence(size_class(F.col("low")), size_class(F.col("high")))).alias("of"), "h1", "n", "left", F.lit(False).alias("small"))
    out = cut(smaller.unionByName(larger), "refined")
    discard(each)
    return out


def fits(a: str, b: str) -> str:
    """Whether rows a and b of a group of ``refined`` can be the first that a linked pair has in common."""
    return f"{SHARE[0] + SHARE[1]} * least({a}.left, {b}.left) >= {SHARE[0]} * ({a}.n + {b}.n) and {a}.h1 <> {b}.h1"


def leads(index: DataFrame) -> DataFrame:
    """(key, c, n): of each group's sets of the class the most central one, which has most shingles left; and the
    group's rows."""
    central = F.min(F.when(F.col("small"), F.struct((F.col("n") - F.col("left")).alias("before"), "h1", "n", "left"))).alias("c")
    return cut(index.groupBy(F.struct("sig", "of").alias("key")).agg(central, F.count("*").alias("rows")).filter("c is not null"), "leads")


def pair(a: str, b: str) -> list[Column]:
    return [F.least(f"{a}.h1", f"{b}.h1").alias("x"), F.greatest(f"{a}.h1", f"{b}.h1").alias("y")]


def with_lead(index: DataFrame) -> DataFrame:
    """(x, y): each set of a group with the group's lead."""
    met = join_split(index, leads(index), F.struct("sig", "of"), F.col("key"), "rows")
    p, q = F.struct("h1", "n", "left").alias("p"), F.col("c").alias("q")
    return met.select(p, q).filter(fits("p", "q")).select(*pair("p", "q")).distinct()


def across(index: DataFrame) -> DataFrame:
    """index with labels -> (x, y): pairs of a smaller and a larger set of a group that have different
    labels.  Of each such pair one at least has not the label of the group's lead, and only
    these few meet the others."""
    main = leads(index).withColumn("h1", F.col("c.h1")).join(index.filter("small").select("h1", "label").distinct(), "h1").select("key", "rows", F.col("label").alias("main"))
    known = join_split(index, cut(main, "main"), F.struct("sig", "of"), F.col("key"), "rows").drop("key", "rows")
    known = cut(known.withColumn("odd", F.col("label") != F.col("main")), "groups")  # written, so that a skewed join of it can be split
    some = known.filter("odd").select("sig", "of").distinct()
    known = known.join(some, ["sig", "of"], "left_semi")
    odd = known.filter("odd")
    met = [p.alias("p").join(q.alias("q"), ["sig", "of"]).filter(f"p.small and not q.small and p.label <> q.label and {fits('p', 'q')}").select(*pair("p", "q")) for p, q in ((odd, known), (known.filter("not odd"), odd))]
    return met[0].unionByName(met[1]).distinct()


def near_enough(pairs: DataFrame) -> DataFrame:
    """pairs (a, b, n_a, n_b, sk_a, sk_b) -> (a, b) that sizes and sketches do not rule out."""
    allowed = np.vectorize(most_apart, otypes=[np.int64])

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            n, m = (batch.column(c).to_numpy() for c in ("n_a", "n_b"))
            drawn = [np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, BINS).astype(np.int16) for c in ("sk_a", "sk_b")]
            apart = np.abs(drawn[0] - drawn[1]).sum(1)
            total, at = np.unique(n + m, return_inverse=True)
            good = (SHARE[1] * np.minimum(n, m) >= SHARE[0] * np.maximum(n, m)) & (apart <= allowed(total)[at])
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return pairs.select("a", "b", "n_a", "n_b", "sk_a", "sk_b").mapInArrow(run, "a long, b long")


def verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """pairs (x, y) of class handles -> (a, b) document pairs that are linked, by their texts."""
    one = lambda side, to: classes.select(F.col("h1").alias(side), F.col("rep").alias(to), F.col("n_shingles").alias(f"n_{to}"), F.col("sketch").alias(f"sk_{to}"))
    ids = cut(near_enough(pairs.join(one("x", "a"), "x").join(one("y", "b"), "y")), "pairs")
    involved = small(ids.select(F.col("a").alias("doc_id")).unionByName(ids.select(F.col("b").alias("doc_id"))).distinct())
    texts = docs.join(involved, "doc_id", "left_semi")
    both = ids.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b")

    def run(batches):
        last, kept = None, set()
        for batch in batches:
            for k in range(0, batch.num_rows, SLICE):
                part, good = batch.slice(k, SLICE), []
                for ta, tb in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True):
                    if ta != last:
                        last, kept = ta, shingles(words_of(ta))
                    good.append(linked(kept, shingles(words_of(tb))))
                yield part.select(["a", "b"]).filter(pa.array(good, pa.bool_()))
        pa.default_memory_pool().release_unused()

    return both.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (smallest id reachable by links)
    and n_copies_of (the id that stands for all documents with the same set)."""
    docs = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    kept: list[DataFrame] = []
    with scratch(kept), arrow_batches(docs.sparkSession, BATCH_BYTES):
        profiles, classes, labels = labelled_classes(docs)
        kept += [profiles, classes, labels]
    named = classes.join(labels, classes.rep == labels.node, "left").select("h1", "h2", "rep", F.coalesce("label", "rep").alias("component"))
    out = profiles.join(named, ["h1", "h2"], "left")
    has = F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)
    return out.select("doc_id", "n_shingles", F.when(has, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"), F.when(has, F.col("rep")).otherwise(F.col("doc_id")).alias("n_copies_of"))


def labelled_classes(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Written tables: the profile of each row (doc_id, n_shingles, h1, h2); the classes (h1, h2, rep, n_shingles,
    sketch); and (node, label) of each class's document that has a link."""
    rows = cut(indexed_rows(docs), "indexed-rows")
    profile = rows.filter(F.col("kind") == PROFILE)
    profiles = cut(profile.select("doc_id", "n_shingles", "h1", "h2"), "profiles")
    one = F.min(F.struct("doc_id", "n_shingles", "sketch")).alias("one")  # equal sets have equal sketches
    classes = cut(profile.filter("n_shingles > 0 and doc_id is not null").groupBy("h1", "h2").agg(one).select("h1", "h2", F.col("one.doc_id").alias("rep"), "one.n_shingles", "one.sketch"), "classes")
    indexed = cut(allocated(shared_rows(rows)), "indexed")
    discard(rows)
    star = cut(stars(indexed), "stars")

    # Each class meets one partner first, then the first of each of its groups, then the rest of small
    # groups that are still apart; documents of large ones go through the second index likewise.
    done = cut(star.groupBy("h1").agg(F.min("lead").alias("lead")).select(F.least("lead", "h1").alias("x"), F.greatest("lead", "h1").alias("y")).distinct(), "first")
    labels = cut(components(verified(done, classes, docs), "a", "b"), "labels")

    def labelled() -> DataFrame:
        return classes.join(labels, classes.rep == labels.node, "left").select("h1", "rep", F.coalesce("label", "rep").alias("label"))

    def meet(pairs: DataFrame) -> None:
        """Verify those pairs that are new and not connected yet; update the labels."""
        nonlocal done, labels
        of = labelled()
        lx, ly = of.select(F.col("h1").alias("x"), F.col("label").alias("lx")), of.select(F.col("h1").alias("y"), F.col("label").alias("ly"))
        pairs = cut(pairs.distinct().join(done, ["x", "y"], "left_anti").join(lx, "x").join(ly, "y").filter("lx <> ly").select("x", "y"), "meet")
        done = done.unionByName(pairs)
        more = cut(verified(pairs, classes, docs), "links")
        if more.limit(1).count():
            known = labels.select(F.col("node").alias("a"), F.col("label").alias("b")).filter("a <> b")
            old, labels = labels, cut(components(known.unionByName(more), "a", "b"), "labels")
            discard(old)
        discard(more)

    meet(star.select("x", "y"))
    discard(star)
    # Documents of groups, of three or more, that are in several components.
    member = cut(indexed.join(labelled(), "h1").select("sig", "rep", "label"), "members")
    groups = member.groupBy(F.col("sig").alias("of")).agg(F.min("label").alias("l0"), F.max("label").alias("l1"), F.count("*").alias("c")).filter("l0 < l1 and c > 2").select("of", "c")
    apart = cut(join_split(member, cut(groups, "apart-groups"), F.col("sig"), F.col("of"), "c", "left_semi").select(F.col("rep").alias("doc_id")).distinct(), "apart")
    discard(member)
    if apart.limit(1).count():
        second = refined(set_hashes(docs.join(small(apart), "doc_id", "left_semi")))
        meet(with_lead(second))
        meet(across(second.join(labelled().select("h1", "label"), "h1")))
    return profiles, classes, labels


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` without near copies: the row with the smallest id of each group stays, once.
    Rows without an id stay."""
    found = near_duplicates(docs)
    gone = found.filter("doc_id <> component_id").select("doc_id").distinct()
    out = docs.join(small(gone), "doc_id", "left_anti").select(docs.columns)
    twice = cut(docs.groupBy("doc_id").count().filter("count > 1 and doc_id is not null").select("doc_id"), "twice")
    if twice.limit(1).count():
        out = out.join(twice, "doc_id", "left_anti").select(docs.columns).unionByName(out.join(twice, "doc_id", "left_semi").select(docs.columns).dropDuplicates(["doc_id"]))
    return out
