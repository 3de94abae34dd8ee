"""The trie against one built by plain dictionaries."""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from gridloom.llm import prefix_trie
from gridloom.operators import ranks

SCHEMA = "conv_id long, turn long, role string, text string, depth int, t string, n int, block string"


def plain(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append(((turn is not None, turn or 0), role or "", text or ""))
    built = {}
    for c in own:
        # Ties by the digest of role and text, as stated.
        digest = lambda r, t: hashlib.md5(f"{len(r.encode())}:".encode() + r.encode() + t.encode()).hexdigest()
        own[c].sort(key=lambda x: (x[0], digest(x[1], x[2])))
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        built[c] = [x[1:] for x in own.get(base, [])[:h]] + [x[1:] for x in own[c][h:]]
    nodes, below = defaultdict(list), defaultdict(list)
    for c, s in built.items():
        for d in range(len(s) + 1):
            nodes[tuple(s[:d])].append(c)
    for k in nodes:
        if k:
            below[k[:-1]].append(k)
    saved, leaves, out = {}, {}, []
    for k in sorted(nodes, key=len, reverse=True):
        saved[k] = ((len(nodes[k]) - 1) * len(k[-1][1].encode()) if k else 0) + sum(saved[x] for x in below[k])
        leaves[k] = sum(leaves[x] for x in below[k]) if below[k] else 1
    for k, m in nodes.items():
        ends = ",".join(str(c) for c in sorted(m) if len(built[c]) == len(k))
        out.append((min(m), len(k), min(nodes[k[:-1]]) if k else None, len(m), len(below[k]), leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def conversations():
    rows = []
    for c in range(-6, 40):
        rows += [(c, t, "user" if t % 2 else "assistant", f"turn {t} of {c % 7 if t > 3 else 0}") for t in range(3 + c % 5 * 4)]
    rows += [(100 + k, t, "user", f"hello {t}") for k in range(30) for t in range(9)]  # copies
    rows += [(200, None, None, None), (200, None, "a", ""), (200, -3, None, "x é ü"), (200, 5, "user", None)]
    rows += [(203, 1, "user", "only")] + [(200 + k, 1, "user", "lone") for k in (6, 7, 8, 9)]  # 206 to 209: no conversation 205
    rows += [(300, 4, "u", "tie"), (300, 4, "u", "tie"), (300, 4, "a", "tie"), (None, 1, "user", "no id")]
    rows += [(400, t, "user", f"long {t % 3} " + "y" * (t % 11)) for t in range(700)] + [(401, t, "user", f"long {t % 3} " + "y" * (t % 11)) for t in range(0, 690)]
    rows += [(5000 + 5000 * k, 0, "user", "far apart") for k in range(4)]  # ids in several chunks
    rows += [(500, 0, "user", "z" * 200_000)]
    return rows


@pytest.fixture(scope="module")
def frame(spark):
    return lambda rows: spark.createDataFrame([(*r, 1, "t", 2, "b") for r in rows], SCHEMA).repartition(5)


def test_trie(frame):
    rows = conversations()
    assert sorted(map(tuple, prefix_trie.trie(frame(rows)).collect()), key=str) == plain(rows)


def test_trie_in_short_spans(frame, monkeypatch):
    """Conversations over many spans of the running sums, and node ids over many chunks."""
    monkeypatch.setattr(ranks, "SPAN", 3)
    monkeypatch.setattr(prefix_trie, "CHUNK_BITS", 2)
    rows = conversations()
    assert sorted(map(tuple, prefix_trie.trie(frame(rows)).collect()), key=str) == plain(rows)


def test_without_turns(frame):
    assert prefix_trie.trie(frame(conversations()).limit(0)).count() == 0
    rows = [(c, 0, "user", "only") for c in range(1, 400, 5)]  # no conversation that is divisible by five
    got = sorted(map(tuple, prefix_trie.trie(frame(rows)).collect()), key=str)
    assert got == plain(rows) and [r for r in got if r[1] == 0][0][3] == len(rows)
