"""Token ids in sorted-string-table shards.

A shard file holds documents in key order: blocks of entries whose keys share prefixes with the
entry before, a sparse index (first key, offset and length of each block), a Bloom filter over
the keys, and a fixed footer.  A lookup asks the Bloom filter, bisects the index and reads one
block.

Layout: MAGIC, blocks, index, Bloom bits, footer.  Entry: varints (shared key bytes, further key
bytes, value bytes), the further key bytes, the value (ids as little-endian 16- or 32-bit).
Footer: ``<QQQQQQBB8s`` - index offset and length, Bloom offset and length, documents, ids, id
width, Bloom hashes, MAGIC.

Files go to the shared folder through Arrow's filesystem layer (local, HDFS, S3) under a hidden name,
and are renamed when whole.  Names are those of the attempt, so a task that is run again, after its
executor was lost or by speculation, never meets a file that is there already; the manifest lists
the file of the attempt that Spark committed, and readers go by it.

Edge cases: null text is empty (only the end id); null ids have the empty key and come first;
rows that share an id are kept in order of their text's hash, in several files where they are very many;
equal rows are kept, in any order.  A very long text is one entry in a block of its own size.  Empty
tables write no files; other columns are ignored.
"""

from __future__ import annotations

import bisect
import struct
import uuid
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm._common import cut, partitions, shared_folder

MAGIC = b"GLSST001"
END_ID = 2
FOOTER = struct.Struct("<QQQQQQBB8s")
BLOCK_BYTES, BLOOM_BITS, BLOOM_HASHES = 64 * 1024, 10, 7
#: Text that a file holds, about; at least as many files are written as a shuffle has partitions.
FILE_BYTES = 256 << 20


# ---- keys, varints, Bloom filter -----------------------------------------------------------


def key_of(doc_id: int | None) -> bytes:
    """Bytes that sort as the ids do; the empty key is null."""
    return b"" if doc_id is None else struct.pack(">Q", doc_id + (1 << 63))


def id_of(key: bytes) -> int | None:
    return None if not key else struct.unpack(">Q", key)[0] - (1 << 63)


def put_varint(out: bytearray, n: int) -> None:
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)


def get_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def bloom_hash(key: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(key)


def bloom_places(h: int, bits: int, hashes: int) -> list[int]:
    step = (h >> 17) | 1
    return [(h + k * step) % bits for k in range(hashes)]


# ---- one shard file ------------------------------------------------------------------------


class ShardWriter:
    """Writes entries in key order; only one block is held at a time."""

    def __init__(self, out, width: int):
        self.out, self.width = out, width
        self.at = self._put(MAGIC, 0)
        self.block, self.last, self.first = bytearray(), b"", None
        self.index: list[tuple[bytes, int, int]] = []
        self.hashes = array("Q")  # eight bytes a key until the filter's size is known
        self.rows = self.tokens = 0

    def _put(self, data: bytes, at: int) -> int:
        self.out.write(data)
        return at + len(data)

    def add(self, key: bytes, ids: np.ndarray) -> None:
        value = ids.astype("<u2" if self.width == 2 else "<u4").tobytes()
        if self.first is None:
            self.first, self.last = key, b""
        shared = 0
        while shared < min(len(key), len(self.last)) and key[shared] == self.last[shared]:
            shared += 1
        for n in (shared, len(key) - shared, len(value)):
            put_varint(self.block, n)
        self.block += key[shared:]
        self.block += value
        self.last = key
        self.hashes.append(bloom_hash(key))
        self.rows += 1
        self.tokens += len(ids)
        if len(self.block) >= BLOCK_BYTES:
            self.flush()

    def flush(self) -> None:
        if self.block:
            self.index.append((self.first, self.at, len(self.block)))
            self.at = self._put(bytes(self.block), self.at)
            self.block, self.first = bytearray(), None

    def close(self) -> None:
        self.flush()
        index = bytearray()
        for key, offset, length in self.index:
            put_varint(index, len(key))
            index += key
            put_varint(index, offset)
            put_varint(index, length)
        bits = max(64, self.rows * BLOOM_BITS)
        bloom = bytearray(-(-bits // 8))
        for h in self.hashes:
            for p in bloom_places(h, bits, BLOOM_HASHES):
                bloom[p >> 3] |= 1 << (p & 7)
        start = self.at
        self.at = self._put(bytes(index), self.at)
        middle = self.at
        self.at = self._put(struct.pack("<Q", bits) + bytes(bloom), self.at)
        self._put(FOOTER.pack(start, len(index), middle, 8 + len(bloom), self.rows, self.tokens, self.width, BLOOM_HASHES, MAGIC), self.at)


class ShardReader:
    def __init__(self, source, size: int):
        self.source = source
        foot = self._read(size - FOOTER.size, FOOTER.size)
        self.index_at, self.index_n, self.bloom_at, self.bloom_n, self.rows, self.tokens, self.width, self.hashes, magic = FOOTER.unpack(foot)
        if magic != MAGIC:
            raise ValueError("not a shard file, or not whole")
        data, at, self.index = self._read(self.index_at, self.index_n), 0, []
        while at < len(data):
            n, at = get_varint(data, at)
            key, at = data[at : at + n], at + n
            offset, at = get_varint(data, at)
            length, at = get_varint(data, at)
            self.index.append((key, offset, length))

    def _read(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def block(self, k: int):
        _, offset, length = self.index[k]
        data, at, key = self._read(offset, length), 0, b""
        while at < length:
            shared, at = get_varint(data, at)
            more, at = get_varint(data, at)
            size, at = get_varint(data, at)
            key = key[:shared] + data[at : at + more]
            at += more
            yield key, np.frombuffer(data, "<u2" if self.width == 2 else "<u4", size // self.width, at).astype("<u4")
            at += size

    def __iter__(self):
        for k in range(len(self.index)):
            yield from self.block(k)

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """Ids of every entry under the key, by Bloom filter, bisection and one block (or more, where
        rows that share an id cross a block's end)."""
        key = key_of(doc_id)
        data = self._read(self.bloom_at, self.bloom_n)
        bits = struct.unpack_from("<Q", data)[0]
        if not all(data[8 + (p >> 3)] >> (p & 7) & 1 for p in bloom_places(bloom_hash(key), bits, self.hashes)):
            return []
        firsts = [x[0] for x in self.index]
        k = max(0, bisect.bisect_left(firsts, key) - 1)
        found = []
        while k < len(firsts) and firsts[k] <= key:
            found += [ids for x, ids in self.block(k) if x == key]
            k += 1
        return found


# ---- tokenizing ----------------------------------------------------------------------------


class Encoder:
    """The tokenizer's ids of whole texts as little-endian 32-bit bytes.

    The tokenizer lower-cases, and splits at white space and between letters and marks before
    anything crosses these places.  So a text's ids are those of its words in turn, A-Z may be
    lowered first (not in texts that may hold a special token, which begin with ``<``), and ASCII
    marks after a word of letters be set apart.  Words repeat, and their ids are kept.  New words of
    letters only are encoded together: each is one piece, which ends with an end-of-word token.
    Others are encoded together around a separator word with a single id; words that hold the
    separator, or are long, alone."""

    SEPARATOR, LONG, KEEP = "0", 64, 500_000
    MARKS = "!\"#$%&'()*+,-./:;=>?@[\\]^_`{|}~"

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        mark = self._ids(self.SEPARATOR)
        self.mark = mark[0] if len(mark) == 1 else None
        self.known: dict[str, bytes] = {"": b""}
        vocabulary = self.tokenizer.get_vocab()
        self.width = 2 if max(vocabulary.values()) < 1 << 16 else 4
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def _keep(self, part: list[str], ids: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        raw = ids.tobytes()
        self.known.update(zip(part, [raw[a:b] for a, b in zip((starts * 4).tolist(), (ends * 4).tolist(), strict=True)], strict=True))

    def _learn(self, words: set[str]) -> None:
        # Marks after letters are a piece of their own, so such words are put together from two.
        marked = [(w, s, w[len(s) :]) for w in words if (s := w.rstrip(self.MARKS)) != w and s.isalpha()]
        plain = words.difference([w for w, _, _ in marked]).union([s for _, s, _ in marked], [t for _, _, t in marked])
        self._learn_plain(list(plain.difference(self.known)))
        self.known.update([(w, self.known[s] + self.known[t]) for w, s, t in marked])

    def _learn_plain(self, words: list[str]) -> None:
        short = [w for w in words if len(w) <= self.LONG]
        letters = [w for w in short if w.isalpha()]
        for k in range(0, len(letters), 4000):
            part = letters[k : k + 4000]
            ids = np.array(self._ids(" ".join(part)), "<u4")
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) == len(part) and ends[-1] == len(ids):
                self._keep(part, ids, np.append(0, ends[:-1]), ends)
        plain = [w for w in short if w not in self.known and self.SEPARATOR not in w] if self.mark is not None else []
        for k in range(0, len(plain), 4000):
            part = plain[k : k + 4000]
            ids = np.array(self._ids(f" {self.SEPARATOR} ".join(part)), "<u4")
            ends = np.flatnonzero(ids == self.mark)
            if len(ends) == len(part) - 1:
                self._keep(part, ids, np.append(0, ends + 1), np.append(ends, len(ids)))
        for w in words:
            if w not in self.known:
                self.known[w] = np.array(self._ids(w), "<u4").tobytes()

    def _words(self, text: str) -> list[str]:
        text = text.replace("\n", " ")
        if "<" not in text:
            text = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
        return text.split(" ")

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > self.KEEP:
            self.known = {"": b""}
        split = [self._words(t) for t in texts]
        if new := set().union(*split).difference(self.known):
            self._learn(new)
        return [b"".join(map(self.known.__getitem__, ws)) for ws in split]


@lru_cache(1)
def encoder_of(path: str) -> Encoder:
    """One encoder a Python worker, so the ids of words outlast a task."""
    return Encoder(path)


# ---- Spark ---------------------------------------------------------------------------------


def write_shards(docs: DataFrame, folder: str, tokenizer: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write ``docs`` under ``folder``, one file a range of ids; returns the manifest
    (shard, path, rows, tokens), one row a file."""
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    files = max(partitions(docs.sparkSession), -(-size // FILE_BYTES))
    # Rows that share an id are parted by their text's hash, so one id with very many rows spreads over files.
    ranged = rows.repartitionByRange(files, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))

    def write(batches):
        from pyarrow import fs
        from pyspark import TaskContext

        place, base = fs.FileSystem.from_uri(folder)
        shard, writer, encoder = TaskContext.get().partitionId(), None, None
        name = f"{shard:06d}-{uuid.uuid4().hex}"
        temp, final = f"{base}/.{name}", f"{base}/shard-{name}.sst"
        out = None
        for batch in batches:
            if writer is None and batch.num_rows:
                place.create_dir(base, recursive=True)
                encoder = encoder_of(tokenizer)
                out = place.open_output_stream(temp)
                writer = ShardWriter(out, encoder.width)
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                for doc_id, ids in zip(part.column(0).to_pylist(), encoder.encode(part.column(1).to_pylist()), strict=True):
                    writer.add(key_of(doc_id), np.append(np.frombuffer(ids, "<u4"), np.uint32(end_id)))
        if writer is not None:
            writer.close()
            out.close()
            place.move(temp, final)
            yield pa.RecordBatch.from_pylist([{"shard": shard, "path": final, "rows": writer.rows, "tokens": writer.tokens}], pa.schema([("shard", pa.int32()), ("path", pa.string()), ("rows", pa.int64()), ("tokens", pa.int64())]))

    return cut(ranged.mapInArrow(write, "shard int, path string, rows long, tokens long"), "manifest")


def read_shards(manifest: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, ids) of every document in the files, in file order."""
    spark = manifest.sparkSession
    starts, at = [], 0
    for r in manifest.orderBy("shard").collect():  # one row a file
        starts.append((r["path"], at))
        at += r["tokens"]
    files = spark.createDataFrame(starts, "path string, start long").repartition(max(1, len(starts)), "path")

    def read(batches):
        from pyarrow import fs

        place, _ = fs.FileSystem.from_uri(folder)
        names = ["doc_id", "start", "ids"]
        for batch in batches:
            for path, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with place.open_input_file(path) as source:
                    rows: list[list] = [[], [], []]
                    for key, ids in ShardReader(source, source.size()):
                        for to, x in zip(rows, (id_of(key), start, ids.tobytes()), strict=True):
                            to.append(x)
                        start += len(ids)
                        if len(rows[0]) == 500:
                            yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.binary())], names)
                            rows = [[], [], []]
                    if rows[0]:
                        yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.binary())], names)

    return files.mapInArrow(read, "doc_id long, start long, ids binary")


def new_folder(spark) -> str:
    folder = f"{shared_folder(spark)}/gridloom/sst-{uuid.uuid4().hex}"
    return folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"


def crc_of(ids: bytes) -> int:
    return zlib.crc32(ids)
