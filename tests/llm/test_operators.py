"""Each operator against brute force on a small table of awkward rows, and on an empty one."""

from __future__ import annotations

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm import decontaminate, license_scan, line_dedup, mixing, ngram_join, pii, pu_quality, quality_rules, sharding, sstable

from .conftest import passage


def multiset(rows):
    return Counter(map(tuple, rows))


# ---- 1 -------------------------------------------------------------------------------------

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            luhn = sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(digits))) % 10 == 0
            if {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in m[0].split(".")), "card": 13 <= len(digits) <= 19 and luhn, "phone": 9 <= len(digits) <= 15}[kind]:
                out.append((kind, *m.span()))
    return out


@pytest.mark.parametrize("text", ["a@b.c+d@e.f", "@x.y a@@b.c", "1.2.3.4.5.6.7.8", "1..2.3.4.5", "4111-1111 1111 1111 1", "+1 2", "+49 30 1234 5678 +49-30-12345678", "a@b..c", "9" * 400, "1.2." * 300, "x@y." * 200])
def test_pii_base(text):
    assert [(k, a, b) for ks in [pii.base_spans(text)] for k in pii.BASE_KINDS for a, b in ks[k]] == plain_spans(text)


def test_pii(docs, none, texts):
    got = pii.detect(docs).collect()
    assert len(got) == len(texts) and pii.detect(none).count() == 0
    one = next(r for r in got if r["doc_id"] == 70)
    assert {s["kind"] for s in one["spans"]} == {"email", "ip", "card", "phone", "iban"}
    wanted = multiset((i, str(plain_spans(t or ""))) for i, t, _ in texts)
    assert multiset((r["doc_id"], str([(s["kind"], s["start"], s["end"]) for s in r["spans"] if s["kind"] in pii.BASE_KINDS])) for r in got) == wanted


def test_pii_further_spans(spark):
    """Further kinds by plain search: they stay apart from base spans, and need a checksum or context."""
    r = random.Random(2)
    parts = ["tel 555-123-4567", "555-123-4567", "ssn 123-45-6789", "123-45-6789", "IBAN DE89 3704 0044 0532 0130 00", "iban DE88 3704 0044 0532 0130 00", "card 4111 1111 1111 1111", "+1 555-123-4567", "mail a@b.co", "10.0.0.1", "filler words of no kind at all, over and over again"]
    for _ in range(300):
        text = " ; ".join(r.choice(parts) for _ in range(r.randint(1, 12)))
        got = [(k, a, b) for k, a, b, _ in pii.find_spans(text)]
        base = [s for s in got if s[0] in pii.BASE_KINDS]
        assert base == plain_spans(text)
        further = [s for s in got if s[0] not in pii.BASE_KINDS]
        assert all(b <= x or y <= a for _, a, b in further for _, x, y in base)
        want = []
        for kind, pattern in (("iban", r"(?<![A-Za-z0-9])DE89 3704 0044 0532 0130 00(?![A-Za-z0-9])"), ("ssn", r"(?<![0-9-])123-45-6789(?![0-9-])"), ("phone_local", r"(?<![0-9+(-])555-123-4567(?![0-9-])")):
            for m in re.finditer(pattern, text):
                near = (text[max(0, m.start() - 40) : m.start()] + " " + text[m.end() : m.end() + 40]).lower()
                if (kind == "iban" or any(w in near for w in pii.CONTEXT[kind])) and all(m.end() <= x or y <= m.start() for _, x, y in base):
                    want.append((kind, *m.span()))
        of = lambda spans, *kinds: {s for s in spans if s[0] in kinds}
        assert of(further, "iban", "ssn") == {s for s in of(want, "iban", "ssn") if s[0] == "iban" or pii.PRIOR["ssn"] + pii.CONTEXT_BONUS >= pii.ACCEPT}
        assert of(further, "phone_local") <= set(want)


# ---- 2 -------------------------------------------------------------------------------------


def plain_set(text):
    """Distinct 5-word shingles, made by regular expression and text; no code of the operator."""
    lower = re.sub("[A-Z]", lambda m: chr(ord(m[0]) + 32), text or "")
    words = re.findall("[^ \t\n\x0b\f\r]+", lower)
    return {"\n".join(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def groups(rows):
    """id -> smallest id reachable by links between any two rows."""
    sets = [(i, plain_set(t)) for i, t, _ in rows if i is not None]
    label = {i: i for i, _ in sets}
    edges = [(i, j) for k, (i, x) in enumerate(sets) for j, y in sets[:k] if x and y and i != j and 100 * len(x & y) >= 80 * len(x | y)]
    for _ in sets:
        before = dict(label)
        for i, j in edges:
            label[i] = label[j] = min(label[i], label[j])
        if label == before:
            break
    return label


def test_ngram_join(docs, none, texts):
    label = groups(texts)
    got = ngram_join.near_duplicates(docs).collect()
    assert multiset((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == multiset((i, len(plain_set(t)), label.get(i)) for i, t, _ in texts)
    assert ngram_join.near_duplicates(none).count() == 0
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns and Counter(r["doc_id"] for r in kept.collect()) == Counter([i for i in label if label[i] == i] + [None, None])
    assert ngram_join.keep_one(none).count() == 0


def hot_rows(repeat=1):
    """Documents that share a passage, a chain of near copies, and a cloud around one text of which no member is central."""
    shared = passage(1, 60)
    rows = [(k, shared + " " + passage(1000 + k, 40), "s") for k in range(40)]
    words = passage(5, 200).split()
    for k in range(40):  # each text differs from the next by a word
        words[5 * k] = f"w{k}"
        rows.append((100 + k, " ".join(words), "s"))
    rows += [(300 + k, f"{rows[k][1]} extra{k}", "s") for k in range(0, 40, 3)]
    seed, r = passage(8, 150).split(), random.Random(4)
    for k in range(60):
        own = list(seed)
        for at in r.sample(range(150), r.randint(2, 6)):
            own[at] = f"c{k}x{at}"
        rows.append((400 + k, " ".join(own), "s"))
    rows += [(500, rows[-1][1] + " end", "s"), (501, " ".join(seed[:130]), "s")]
    return rows * repeat


@pytest.mark.parametrize("repeat", [1, 3])
def test_ngram_join_hot_groups(spark, repeat):
    rows = hot_rows(repeat)
    df = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string").repartition(3)
    label = groups(rows)
    got = ngram_join.near_duplicates(df).collect()
    assert len(got) == len(rows) and {r["doc_id"]: r["component_id"] for r in got} == label
    assert len(set(label.values())) > 60


def test_refined_index_finds_every_linked_pair(spark):
    """The refined index by itself, all pairs of different labels asked for: every linked pair comes, few others do."""
    rows = hot_rows()
    df = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    sets = ngram_join.set_hashes(df).cache()
    by = {r["h1"]: set(r["s"]) for r in sets.collect()}
    handles = sorted(by)
    linked = {(x, y) for k, y in enumerate(handles) for x in handles[:k] if 100 * len(by[x] & by[y]) >= 80 * len(by[x] | by[y])}
    index = ngram_join.refined(sets).withColumn("label", F.col("h1"))
    found = {tuple(r) for r in ngram_join.with_lead(index).unionByName(ngram_join.across(index)).collect()}
    assert linked <= found and len(found) < 3 * len(linked) + 100


@pytest.mark.parametrize("depths", [(1, 2), (2,)])
def test_segments_find_every_linked_pair(depths):
    rng = np.random.default_rng(3)
    for size in [4, 5, 6, 8, 9, 13, 14, 21, 22, 35, 60, 100, 200, 400]:
        for _ in range(25):
            both = rng.integers(0, 2**63, size * 2).astype(np.uint64)
            a = np.unique(both[:size])
            inter = int(rng.integers(-(-4 * size * 2 // 9), size + 1))
            b = np.unique(np.concatenate([a[rng.permutation(size)[: min(size, inter)]], both[size : size + int(rng.integers(0, size // 4 + 1))]]))
            if not ngram_join.linked(set(a), set(b)) or set(a) == set(b):
                continue
            sides = []
            for s in (a, b):
                sig = [(x, m) for xs, ms in ngram_join.signatures(s, ngram_join.mix(s), depths) for x, m in zip(xs.tolist(), ms.tolist(), strict=True)]
                sides.append(dict(sig))
            common = set(sides[0]) & set(sides[1])
            slack = [max((m & 15 for m in side.values()), default=0) for side in sides]
            good = [x for x in common if not (sides[0][x] & 32 and sides[1][x] & 32) and not (sides[0][x] & 16 and sides[1][x] & 16)]
            assert len(good) > sum(slack), (size, len(a), len(b))


# ---- 3 -------------------------------------------------------------------------------------


def counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {i + j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_quality_rules(docs, none, texts):
    got = quality_rules.score(docs).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert multiset((r["doc_id"], *(r[n] for n in names)) for r in got) == multiset((i, *counts(t or "")) for i, t, _ in texts)
    for r in got:
        failed = r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]
        assert r["base_failed"] == failed and not (failed and r["kept"])
    assert {r["doc_id"] for r in got if r["kept"]} >= set(range(12)) - {9} | {20, 60}
    assert not {71, 72} & {r["doc_id"] for r in got if r["kept"]}
    assert quality_rules.score(none).count() == 0
    kept = quality_rules.keep_good(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r["kept"] for r in got)


def plain_fit(rows, rounds=500):
    """Expectation maximisation document by document, in the plainest form."""
    prior = {-1: (0.4, 0.05), 0: (0.2, 0.2), 1: (0.4, 0.75)}
    weight, good, table = max(1.0, len(rows) / 100), 0.8, [dict(prior) for _ in rows[0]]
    for _ in range(rounds):
        told = [plain_posterior(v, good, table) for v in rows]
        good = (sum(told) + 0.8 * weight) / (len(rows) + weight)
        for k in range(len(table)):
            counts = {x: [weight * prior[x][c] + sum((p if c else 1 - p) for v, p in zip(rows, told, strict=True) if v[k] == x) for c in (0, 1)] for x in prior}
            table[k] = {x: tuple(counts[x][c] / sum(n[c] for n in counts.values()) for c in (0, 1)) for x in prior}
    return good, table


def plain_posterior(votes, good, table):
    bad, fine = 1 - good, good
    for v, t in zip(votes, table, strict=True):
        bad, fine = bad * t[v][0], fine * t[v][1]
    return fine / (bad + fine)


def test_rules_fit_finds_the_classes():
    rng = np.random.default_rng(0)
    good = rng.random(4000) < 0.7
    votes = np.where(rng.random((4000, 8)) < 0.3, 0, np.where((rng.random((4000, 8)) < 0.85) == good[:, None], 1, -1))
    share, table = quality_rules.fit(list(Counter(map(tuple, votes.tolist())).items()))
    told = np.array([quality_rules.posterior(tuple(v), share, table) > 0.5 for v in votes.tolist()])
    assert (told == good).mean() > 0.95 and abs(share - 0.7) < 0.05


def test_rules_verdict_is_the_fit(spark):
    """On given documents: the posterior of a plain fit, votes outvoted both ways, and labels mostly met."""
    from ..conftest import DATA

    docs = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet")
    rows = quality_rules.score(docs).join(spark.read.parquet(f"{DATA}/sf0.01/labels.parquet").select("doc_id", "quality"), "doc_id", "left").collect()
    votes = {r["doc_id"]: tuple(int(c) - 1 for c in r["votes"]) for r in rows}
    rest = [r for r in rows if not r["base_failed"]]
    good, table = plain_fit([votes[r["doc_id"]] for r in rest], 120)
    assert all(abs(r["quality_probability"] - plain_posterior(votes[r["doc_id"]], good, table)) < 1e-4 for r in rows)
    assert all(r["kept"] == (r["quality_probability"] >= 0.5) for r in rest)
    assert any(r["kept"] and -1 in votes[r["doc_id"]] for r in rest)
    assert any(not r["kept"] and sum(votes[r["doc_id"]]) > 0 for r in rest)
    of = lambda q: [r["kept"] for r in rest if r["quality"] == q]
    assert sum(of(1)) > 0.99 * len(of(1)) and sum(of(0)) < 0.1 * len(of(0))


# ---- 4 -------------------------------------------------------------------------------------


def test_pu_quality(spark, docs, none):
    good = [(1000 + k, passage(k, 150).capitalize() + ".") for k in range(300)]
    junk = [(3000 + k, ("buy | " + passage(k, 2) + " | ") * 25) for k in range(100)]
    df = spark.createDataFrame(good + junk, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, 0) for i, _ in good[:150]] + [(i, 0, 0) for i, _ in junk[:50]], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in pu_quality.score(df, labels).collect()}
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i in got)
    wrong = sum(got[i]["predicted"] != 1 for i, _ in good) + sum(got[i]["predicted"] != 0 for i, _ in junk)
    assert wrong <= 12
    assert pu_quality.score(none, labels).count() == 0
    assert pu_quality.score(docs, labels).count() == docs.count()  # no trusted text among them
    assert set(pu_quality.score(docs, labels.limit(0)).select("score").distinct().toPandas()["score"]) == {0.5}


def test_prior_is_near_the_share_of_labels():
    """The estimate, which never reads negative labels, against their share; and the score against plain counts."""
    import pyarrow.parquet as pq

    from ..conftest import DATA

    docs = pq.read_table(f"{DATA}/sf0.1/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    quality = {r["doc_id"]: r["quality"] for r in pq.read_table(f"{DATA}/sf0.1/labels.parquet").to_pylist()}
    x = np.array([pu_quality.features(r["text"]) for r in docs])
    trusted = np.array([quality.get(r["doc_id"]) == 1 and zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1 for r in docs])
    model, prior = pu_quality.train(x[trusted], x[np.random.default_rng(0).permutation(len(x))])
    assert abs(prior - np.mean([v == 1 for v in quality.values()])) < 0.04
    row, width = x[7], pu_quality.BINS + 1
    plain = model.bias + sum(model.weights[k * width + sum(e <= row[f] for e in model.edges[k])] for k, f in enumerate(model.taken))
    assert model.score(row[None])[0] == pytest.approx(1 / (1 + np.exp(-plain)))


def test_hashed_features():
    """Buckets of words and of three-byte strings, against plain counts."""
    text = "ab ab\ncd é$$ " + "x" * 30
    got = pu_quality.features(text)
    raw = text.encode()
    words, threes = [0] * pu_quality.BUCKETS, [0] * pu_quality.BUCKETS
    for w in text.split():
        words[zlib.crc32(w.encode()) % pu_quality.BUCKETS] += 1
    for k in range(len(raw) - 2):
        threes[int.from_bytes(raw[k : k + 3], "big") * 2654435761 % 2**32 * pu_quality.BUCKETS >> 32] += 1
    n = len(pu_quality.NAMES)
    assert got[n : n + pu_quality.BUCKETS] == pytest.approx([c / 5 for c in words])
    assert got[n + pu_quality.BUCKETS :] == pytest.approx([c / (len(raw) - 2) for c in threes])
    assert not pu_quality.features(None).any() and len(pu_quality.features("a")) == pu_quality.WIDTH
    assert (pu_quality.unpacked([got.tobytes()])[0] == got).all()


def test_risk_is_least():
    """The non-negative risk by plain loops: what the fit ends at is about the least around it."""
    rng = np.random.default_rng(3)
    p, u = rng.normal(1.5, 1, (300, 3)), np.concatenate([rng.normal(1.5, 1, (360, 3)), rng.normal(-1.5, 1, (240, 3))])
    prior = 0.6

    def plain(model):
        soft = lambda g: math.log1p(math.exp(-abs(g))) + max(g, 0.0)
        raw = lambda row: model.bias + sum(model.weights[k * (pu_quality.BINS + 1) + sum(e <= row[f] for e in model.edges[k])] for k, f in enumerate(model.taken))
        gp, gu = [raw(r) for r in p], [raw(r) for r in u]
        positive = prior * sum(soft(-g) for g in gp) / len(gp)
        negative = sum(soft(g) for g in gu) / len(gu) - prior * sum(soft(g) for g in gp) / len(gp)
        assert pu_quality.risk(np.array(gp), np.array(gu), prior) == pytest.approx((positive, negative))
        penalty = pu_quality.PENALTY + 0.1 / len(p)
        return positive + max(0.0, negative) + penalty / 2 * float((model.weights**2).sum())

    model, _ = pu_quality.train(p, u, prior)
    pu_quality._fit(model, model.places(p), model.places(u), prior)  # as fitted, before the bias is set
    least = plain(model)
    weights, bias = model.weights.copy(), model.bias
    for _ in range(12):
        model.weights, model.bias = weights + rng.normal(0, 0.3, len(weights)), bias + rng.normal(0, 0.2)
        assert plain(model) > least
    model.weights, model.bias = weights * 0, 0.0
    assert plain(model) > least + 0.1


def test_share_above_one_half_is_the_prior():
    rng = np.random.default_rng(4)
    p, u = rng.normal(2, 1, (500, 4)), np.concatenate([rng.normal(2, 1, (800, 4)), rng.normal(-2, 1, (200, 4))])
    for prior in (0.6, 0.8, 0.95):
        model, _ = pu_quality.train(p, u, prior)
        assert abs((model.score(u) >= 0.5).mean() - prior) < 0.005 + pu_quality.NEAR * math.sqrt(prior * (1 - prior) / 500)
    assert pu_quality.valley(np.array([5.0, 1.0, 1.1, 4.0, 4.2, 4.1, 4.3, 4.4]), 0.7, 20) == pytest.approx(2.55)
    assert pu_quality.valley(np.array([2.0]), 0.7, 1) == 2.0


def test_prior_estimate():
    rng = np.random.default_rng(1)
    p = rng.normal(2, 1, (4000, 5))
    u = np.concatenate([rng.normal(2, 1, (4200, 5)), rng.normal(-2, 1, (1800, 5))])
    _, prior = pu_quality.train(p, u)
    assert abs(prior - 0.7) < 0.06


# ---- 5 -------------------------------------------------------------------------------------


def test_sharding(docs, none, texts, spark):
    got = sharding.assign(docs, 4).collect()
    assert multiset((r["doc_id"], r["size"]) for r in got) == multiset((i, len((t or "").encode()) + 16) for i, t, _ in texts)
    for s in {r["shard"] for r in got}:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    assert sharding.assign(none, 4).count() == 0
    assert sharding.sharded_docs(docs, 4).count() == len(texts)
    many = spark.range(20_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "same").otherwise(F.repeat(F.md5(F.col("id").cast("string")), (F.col("id") % 9).cast("int"))).alias("text"))
    sizes = [r[0] for r in sharding.assign(many).groupBy("shard").agg(F.sum("size")).select("sum(size)").collect()]
    assert len(sizes) == 40 and max(sizes) / min(sizes) < 1.04


def plain_shards(rows, shards):
    """rows (hash, id, size) -> shard of each, all in one list: groups above a hundredth of a shard first, by size, to
    the emptiest shard; the others in order into the room that is left; groups above a shard record by record."""
    total, group = sum(n for *_, n in rows), Counter()
    each = total / shards
    for h, _, n in rows:
        group[h] += n
    load, home = [0] * shards, {}
    for h, b in sorted(group.items(), key=lambda g: (-g[1], g[0])):
        if each / 100 < b <= each:
            home[h] = load.index(min(load))
            load[home[h]] += b
    rest = [r for r in sorted(rows) if r[0] not in home]
    room = [max(0, each - x) for x in load]
    ends = np.cumsum(room) * sum(n for *_, n in rest) / sum(room)
    out, at, starts = {}, 0, {}
    for h, i, n in rest:
        middle = at + n / 2 if group[h] > each else starts.setdefault(h, at) + group[h] / 2
        out[h, i] = int((ends[:-1] <= middle).sum())
        at += n
    return {(h, i): home.get(h, out.get((h, i))) for h, i, _ in rows}


def test_sharding_equals_plain_placement(spark):
    rows = [(k, "huge " * 40) for k in range(900)] + [(2000 + k, passage(k // (1 + k % 40), 5 + k % 30)) for k in range(3000)] + [(9000 + k, "medium " * 30) for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    hashed = df.withColumn("hash", F.xxhash64("text"))
    got = sharding.assign(hashed, 10, keep=("doc_id", "hash", "text")).collect()
    want = plain_shards([(r["hash"], r["doc_id"], r["size"]) for r in got], 10)
    assert all(r["shard"] == want[r["hash"], r["doc_id"]] for r in got) and len(got) == len(rows)
    at = {}
    for r in got:
        at.setdefault(r["text"], set()).add(r["shard"])
    assert [t[:5] for t, s in at.items() if len(s) > 1] == ["huge "]
    for s in range(10):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))


def test_shards_with_groups_near_their_size(spark):
    """Forty-one equal groups for forty shards: one is subdivided, and no shard holds more than its share."""
    rows = [(1000 * g + k, passage(g, 60)) for g in range(41) for k in range(20)]
    got = sharding.assign(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    load = Counter()
    for r in got:
        load[r["shard"]] += r["size"]
    mean = sum(load.values()) / 40
    assert len(got) == len(rows) and len(load) == 40 and max(load.values()) <= 1.03 * mean + max(r["size"] for r in got)
    for s in load:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))


# ---- 6 -------------------------------------------------------------------------------------


def test_targets_never_exceed_twice():
    t = mixing.targets({"a": 10, "b": 1000, None: 500, "c": 0})
    assert list(t) == ["a", "b", "c", None]
    assert sum(t.values()) == pytest.approx(1.5 * 1510) and all(t[s] <= 2 * n + 1e-9 for s, n in {"a": 10, "b": 1000, None: 500, "c": 0}.items())


def test_mixing(spark, docs, none):
    df = docs.select("doc_id", "text", "source", mixing.item_of("text").alias("item"), mixing.size_of("text").alias("words"))
    got = mixing.mix(df, size_col="words").collect()
    assert len(got) == docs.count() and all(0 <= r["copies"] <= 2 for r in got)
    for s in {r["source"] for r in got}:
        mine = [r for r in got if r["source"] == s]
        assert abs(sum(r["words"] * r["copies"] for r in mine) - mine[0]["target"]) <= max(r["words"] for r in mine)
        assert mine[0]["source_size"] == sum(r["words"] for r in mine)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(df.repartition(5), size_col="words").collect()))
    assert mixing.mix(df.limit(0), size_col="words").count() == 0
    again = mixing.taken_docs(docs)
    assert again.columns == docs.columns and mixing.taken_docs(none).count() == 0


def limits(members, capacity, most=2):
    return {(p, s): most * capacity[p] for p in members for s in members[p]}


def test_flow_uses_overlaps():
    """One pattern serves both sources: its words go where they are needed, none is repeated."""
    capacity = {0: 10.0, 1: 10.0, 2: 10.0}
    used = mixing.flow(capacity, limits({0: [0], 1: [0, 1], 2: [1]}, capacity), {0: 18.0, 1: 12.0})
    assert sum(v for (p, s), v in used.items() if s == 0) == pytest.approx(18)
    assert sum(v for (p, s), v in used.items() if s == 1) == pytest.approx(12)
    assert all(sum(v for (q, _), v in used.items() if q == p) <= 10 + 1e-9 for p in range(3))


@pytest.mark.parametrize("seed", range(12))
def test_flow_costs_no_more_than_any_other(seed):
    """Whole words on a small graph, against every way of dealing them out."""
    import itertools

    r = random.Random(seed)
    members = {p: sorted(r.sample(range(2), r.randint(1, 2))) for p in range(3)}
    capacity = {p: float(r.randint(1, 3)) for p in members}
    limit = limits(members, capacity)
    most = {s: sum(v for (p, x), v in limit.items() if x == s) for s in range(2)}
    quota = {s: float(r.randint(0, int(m))) for s, m in most.items()}

    def cost(used):
        spent = {p: sum(v for (q, _), v in used.items() if q == p) for p in capacity}
        return sum(max(0.0, spent[p] - c * capacity[p]) for p in capacity for c in range(1, 4))

    edges = sorted(limit)
    ways = (dict(zip(edges, x, strict=True)) for x in itertools.product(*(range(int(limit[e]) + 1) for e in edges)))
    best = min(cost(u) for u in ways if all(sum(v for (_, x), v in u.items() if x == s) == q for s, q in quota.items()))
    used = mixing.flow(capacity, limit, quota)
    assert all(used[e] <= limit[e] + 1e-9 for e in limit) and cost(used) == pytest.approx(best)
    assert all(sum(v for (_, x), v in used.items() if x == s) == pytest.approx(q) for s, q in quota.items())


def test_mixing_takes_shared_items_once(spark):
    """Two sources hold the same texts; the mix reads the flow, which takes them for one source first."""
    rows = [(k, "a", passage(k, 50)) for k in range(40)] + [(100 + k, "b", passage(k, 50)) for k in range(40)] + [(200 + k, "b", passage(500 + k, 50)) for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("item", mixing.item_of("text")).withColumn("size", mixing.size_of("text"))
    got = mixing.mix(df).collect()
    words = lambda low, high: sum(r["size"] * r["copies"] for r in got if low <= r["doc_id"] < high)
    # Targets: a twice its 2000 words, b the rest of 9000, 5000.  a has only shared texts; b takes its own twice before it takes these a third time.
    assert (words(0, 100), words(100, 200), words(200, 300)) == (4000, 1000, 4000)


def reached(start, members, used, limit):
    """Patterns to which a word of ``start`` can be moved: a source takes it less there and more here, and so on."""
    seen, stack = {start}, [start]
    of = {}
    for p, ss in members.items():
        for s in ss:
            of.setdefault(s, []).append(p)
    while stack:
        p = stack.pop()
        for s in members[p]:
            if used[p, s] > 1e-5:
                for q in of[s]:
                    if q not in seen and limit[q, s] - used[q, s] > 1e-5:
                        seen.add(q)
                        stack.append(q)
    return seen


@pytest.mark.parametrize("seed", range(6))
def test_flow_can_not_be_bettered(seed):
    """No word can be moved to where it would cost less, along any path: so the cost is the least there is."""
    r = random.Random(seed)
    sources = r.randint(2, 7)
    members = {p: sorted(r.sample(range(sources), r.randint(1, min(3, sources)))) for p in range(60)}
    capacity = {p: float(r.randint(1, 90)) for p in members}
    limit = limits(members, capacity)
    most = {s: sum(v for (_, x), v in limit.items() if x == s) for s in range(sources)}
    quota = {s: r.choice([0.3, 0.8, 1.0]) * m for s, m in most.items()}
    used = mixing.flow(capacity, limit, quota)
    assert all(-1e-9 <= used[e] <= limit[e] + 1e-6 for e in limit)
    for s, q in quota.items():
        assert sum(v for (_, x), v in used.items() if x == s) == pytest.approx(q, abs=1e-4)
    spent = {p: sum(used[p, s] for s in members[p]) for p in members}
    level = lambda words, p: min(mixing.LEVELS, math.floor(words / capacity[p]) + 1)
    for p in members:
        if spent[p] > 1e-4:
            last = level(spent[p] - 1e-4, p)
            assert all(level(spent[q] + 1e-4, q) >= last for q in reached(p, members, used, limit))


def test_flow_over_many_patterns():
    """A hundred thousand cells in less than half a minute."""
    r = random.Random(5)
    members = {p: sorted(r.sample(range(24), 1 + p % 4)) for p in range(40_000)}
    capacity = {p: float(r.randint(1, 5000)) for p in members}
    limit = limits(members, capacity)
    quota = mixing.targets({s: sum(capacity[p] for p, ss in members.items() if s in ss) for s in range(24)})
    start = time.perf_counter()
    used = mixing.flow(capacity, limit, quota)
    assert len(limit) == 100_000 and time.perf_counter() - start < 30
    got = dict.fromkeys(quota, 0.0)
    for (_, s), v in used.items():
        got[s] += v
    assert all(got[s] == pytest.approx(q) for s, q in quota.items())


def test_mixing_selects_in_seeded_order(spark, monkeypatch):
    """Sources without common items, in many slices, against a plain walk along the order."""
    monkeypatch.setattr(mixing, "SLICE_ROWS", 7)
    r = random.Random(9)
    rows = [(k, f"s{k % 3}" if k % 7 else None, f"item{k}", r.randrange(60)) for k in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, source string, item string, size long").repartition(5)
    order = F.xxhash64(F.lit(17), F.col("doc_id").cast("string"), F.col("size"))
    at = {x["doc_id"]: (x["o"] % (1 << 40), x["o"], x["size"]) for x in df.select("doc_id", order.alias("o"), "size").collect()}
    sizes = {s: sum(x[3] for x in rows if x[1] == s) for s in {x[1] for x in rows}}
    quota, want = mixing.targets(sizes), {}
    for s, total in sizes.items():
        rounds = int(quota[s] // total)
        part, run = quota[s] - rounds * total, 0
        for i in sorted((x[0] for x in rows if x[1] == s), key=at.get):
            n = at[i][2]
            want[i] = (rounds + (run + n / 2 < part)) * (n > 0)
            run += n
    got = {x["doc_id"]: x["copies"] for x in mixing.mix(df).collect()}
    assert got == want


def test_mixing_with_columns_of_its_own_names(spark):
    names = ["_s", "_n", "_k", "_o", "_m", "_p", "target", "source_size", "copies", "_cell"]
    df = spark.createDataFrame([(k, k % 3, f"i{k % 4}", 10, *[5] * len(names)) for k in range(20)], "doc_id long, source long, item string, size long, " + ", ".join(f"{n} long" for n in names))
    got = mixing.mix(df).collect()
    assert len(got) == 20 and all(r["_s"] == 5 and r["_cell"] == 5 and r["target"] != 5 for r in got)


def test_mixing_beyond_its_patterns(spark):
    """Only the largest patterns are told apart; targets are met all the same."""
    r = random.Random(2)
    rows = [(20 * k + j, s, f"item{k}", 3 + k % 40) for k in range(300) for j, s in enumerate(r.sample("abcdef", 1 + k % 4))]
    df = spark.createDataFrame(rows, "doc_id long, source string, item string, size long").repartition(4)
    for most in (100_000, 3, 0):
        got = mixing.mix(df, max_patterns=most).collect()
        assert len(got) == len(rows) and all(0 <= x["copies"] <= 2 for x in got)
        for s in "abcdef":
            mine = [x for x in got if x["source"] == s]
            assert abs(sum(x["size"] * x["copies"] for x in mine) - mine[0]["target"]) <= 100


# ---- 7 -------------------------------------------------------------------------------------


def test_line_dedup(docs, none, texts):
    got = line_dedup.dedup(docs).collect()
    assert len(got) == len(texts) and line_dedup.dedup(none).count() == 0
    by = {r["doc_id"]: r for r in got}
    assert by[60]["removed_lines"] == 0 and by[61]["removed_lines"] >= 4 and by[62]["removed_lines"] >= 4
    assert by[50]["removed_lines"] == 0 and by[40]["clean_text"] == ""
    original = {i: t or "" for i, t, _ in texts}
    for r in got:
        gone = Counter(original[r["doc_id"]].split("\n")) - Counter(r["clean_text"].split("\n")) if r["doc_id"] is not None else Counter()
        assert sum(gone.values()) == r["removed_lines"]
        assert all(any(line in (t or "") for i, t, _ in texts if i != r["doc_id"]) for line in gone)


def test_line_dedup_whole_copies(spark):
    """Long lines, one-line documents and passages go wherever they stand; short lines alone stay."""
    line = [passage(500 + k, 60) for k in range(9)]
    few = "\n".join(passage(600 + k, 8) for k in range(8))
    rows = [(k, x) for k, x in enumerate(line[:3])] + [(10 + k, x) for k, x in enumerate(line[:3])]
    rows += [(20, "Title\n" + line[3] + "\n\n" + line[4]), (21, "Title\n" + line[3] + "\n\n" + line[4])]
    rows += [(30 + k, f"own {k}\nTitle\n{passage(700 + k, 9)}\n{line[5]}\nend {k}") for k in range(3)]
    rows += [(40 + k, f"{passage(720 + k, 9)}\n{passage(740 + k, 9)}\n{few}\n{passage(760 + k, 9)}") for k in range(12)]
    rows += [(60, few), (None, line[6]), (61, line[6])]
    got = {r["doc_id"]: r for r in line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(got) == len(rows)
    for i, text in rows:
        gone = {10: 1, 11: 1, 12: 1, 21: 4, 31: 1, 32: 1, 60: 8, 61: 1, **{k: 8 for k in range(41, 52)}}.get(i, 0)
        assert (i, got[i]["removed_lines"], got[i]["n_lines"]) == (i, gone, len(text.split("\n")))
        assert len(got[i]["clean_text"].split("\n")) == max(1, len(text.split("\n")) - gone)
    assert got[32]["clean_text"] == f"own 2\nTitle\n{passage(702, 9)}\nend 2" and got[45]["clean_text"] == f"{passage(725, 9)}\n{passage(745, 9)}\n{passage(765, 9)}"


def plain_dedup(rows):
    """id -> text that stays, by a plain reading of the scheme; ids differ.  hash2: hash of two lines, hash1: of one."""
    texts = sorted((i, t or "") for i, t, _, _ in rows)
    hash2 = {(i, k): h for i, _, pairs, _ in rows for k, h in enumerate(pairs, 1)}
    lines = {i: t.split("\n") for i, t in texts}
    is_long = lambda i, k: 0 <= k < len(lines[i]) and len(lines[i][k]) >= line_dedup.LONG
    pair = lambda i, k: (lines[i][k - 1], lines[i][k]) if 0 < k < len(lines[i]) and not (is_long(i, k) and is_long(i, k - 1)) else None
    seen = Counter(x for i, _ in texts for k in range(len(lines[i])) for x in ([pair(i, k)] if pair(i, k) else []) + ([lines[i][k]] if is_long(i, k) else []))
    again = lambda i, k: pair(i, k) is not None and seen[pair(i, k)] > 1
    inner = lambda i, k: again(i, k) and not is_long(i, k) and not is_long(i, k - 1)
    ends = lambda i, k: k >= 2 and hash2[i, k - 1] % line_dedup.DIVISOR == 0
    chunks, found = {}, Counter()
    for i, _ in texts:
        n = len(lines[i])
        starts = [k for k in range(n) if k == 0 or is_long(i, k) or is_long(i, k - 1) or ((inner(i, k - 1) and inner(i, k + 1) and ends(i, k) and not (inner(i, k - 2) and ends(i, k - 1))) if again(i, k) else again(i, k - 1) or again(i, k + 1) or ends(i, k))]
        chunks[i] = []
        for a, b in zip(starts, [*starts[1:], n], strict=True):
            if is_long(i, a):
                body = [lines[i][a]] if seen[lines[i][a]] > 1 else []
            elif b - a >= line_dedup.LEAST_LINES:
                body = lines[i][a:b] if again(i, a + 1) else []
            else:
                body = lines[i][a : a + 2] if again(i, a + 1) else lines[i][a - 1 : a + 1] if again(i, a) else []
            text = "\n".join(body)
            chunks[i].append((a, b, text if len("".join(text.split(" ")).replace("\n", "")) >= line_dedup.LEAST_CHARS else ""))
    out, first = {}, set()
    for i, _ in texts:
        for _, _, text in chunks[i]:
            found[text] += 1
    for i, _ in texts:
        kept = []
        for a, b, text in chunks[i]:
            if not text or text not in first:
                kept += lines[i][a:b]
            first.add(text)
        out[i] = "\n".join(kept)
    return out


@pytest.mark.parametrize("seed", range(2))
def test_line_dedup_equals_plain_scheme(spark, seed, monkeypatch):
    """Random documents put together from passages, headings and long lines, against the scheme in plain Python;
    the second time by the joins that large tables take."""
    if seed:
        monkeypatch.setattr(line_dedup, "BROADCAST_ROWS", 0)
    r = random.Random(seed)
    passages = [[passage(1000 * seed + 20 * p + k, r.randint(3, 9)) for k in range(r.randint(2, 9))] for p in range(6)]
    long_lines = [passage(9000 + 10 * seed + k, 50) for k in range(3)]
    rows = []
    for i in range(60):
        lines = []
        for _ in range(r.randint(1, 5)):
            kind = r.random()
            lines += r.choice(passages) if kind < 0.4 else [r.choice(long_lines)] if kind < 0.6 else ["Heading"] if kind < 0.7 else [passage(50_000 + 100 * i + len(lines), 7) for _ in range(r.randint(1, 3))]
        rows.append((i, "\n".join(lines)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    with_hash = df.withColumn("l", F.split("text", "\n")).withColumn("h", F.transform("l", lambda x: F.xxhash64(x)))
    with_hash = with_hash.withColumn("p", F.when(F.size("l") > 1, F.transform(F.sequence(F.lit(1), F.size("l") - 1), lambda k: F.xxhash64(F.get("h", k - 1), F.get("h", k)))).otherwise(F.array().cast("array<bigint>")))
    want = plain_dedup([(x["doc_id"], x["text"], x["p"], None) for x in with_hash.collect()])
    got = {x["doc_id"]: x["clean_text"] for x in line_dedup.dedup(df).collect()}
    assert got == want and sum(got[i] != t for i, t in rows) > 20


# ---- 8 -------------------------------------------------------------------------------------


def test_license_scan(docs, none, texts, spark):
    got = license_scan.scan(docs).collect()
    assert len(got) == len(texts) and license_scan.scan(none).count() == 0
    assert [r["doc_id"] for r in got if r["licenses"]] == [73] and next(r for r in got if r["doc_id"] == 73)["licenses"] == ["MIT"]
    each = spark.createDataFrame([(k, passage(k, 200) + " " + t + " " + passage(k + 50, 300)) for k, t in enumerate(license_scan.TEMPLATES.values())], "doc_id long, text string")
    names = list(license_scan.TEMPLATES)
    assert all(names[r["doc_id"]] in r["licenses"] for r in license_scan.scan(each).collect())


def test_license_texts(spark):
    """Inexact notices, headers, whole texts and tags; versions and variants stay apart."""
    w = license_scan.WORDINGS
    mit = w["MIT"][0].split()
    cases = [
        ("Released under MIT License.", ["MIT"]),
        ("This work was licensed under the GNU General Public License, version 3.", ["GPL-3.0"]),
        ("It is free; GPL version 3 or later applies.", ["GPL-3.0"]),
        ("This work is licensed under the GNU Lesser General Public License, version 3.", ["LGPL-3.0"]),
        (" ".join(x for k, x in enumerate(mit) if k % 40 != 20), ["MIT"]),
        (w["GPL-2.0"][0].replace("program", "library"), ["GPL-2.0"]),
        (w["GPL-3.0"][0].replace("program", "library"), ["GPL-3.0"]),
        (w["GPL-3.0"][0] + "\n" + w["GPL-2.0"][0].replace("free software", "software"), ["GPL-2.0", "GPL-3.0"]),
        (w["BSD-2-Clause"][0], ["BSD-2-Clause"]),
        (w["BSD-3-Clause"][0].replace("copyright holder nor", "University nor"), ["BSD-3-Clause"]),
        (w["Apache-2.0"][0].replace("http://www.apache.org/licenses/LICENSE-2.0", "the usual place"), ["Apache-2.0"]),
        ("// SPDX-License-Identifier: Apache-2.0", ["Apache-2.0"]),
        ("# SPDX-License-Identifier: GPL-2.0-or-later", ["GPL-2.0"]),
        ("Licensed under CC BY-SA 4.0, not more.", ["CC-BY-SA-4.0"]),
        (w["ISC"][0], ["ISC"]),
        (w["0BSD"][0], ["0BSD"]),
        ("We met under the general public, version 3 of the plan, to license nothing.", []),
    ]
    rows = [(k, passage(800 + k, 70 + 5 * k) + "\n" + t + "\n" + passage(850 + k, 90)) for k, (t, _) in enumerate(cases)]
    got = {r["doc_id"]: list(r["licenses"]) for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {k: x for k, (_, x) in enumerate(cases)}
    each = [(k, passage(k, 30 + k % 40) + " " + t + " " + passage(k + 300, 60), name) for k, (name, t) in enumerate((name, t) for name, ts in w.items() for t in ts)]
    got = {r["doc_id"]: list(r["licenses"]) for r in license_scan.scan(spark.createDataFrame([x[:2] for x in each], "doc_id long, text string")).collect()}
    assert [(k, name, got[k]) for k, _, name in each if got[k] != [name]] == []


def exact_licenses(texts):
    """id -> licenses by the share of shingles that each template has in the whole text."""
    known = license_scan.templates()
    tests, within = license_scan.tests_of(known)
    wanted = {}
    for t, _, part, shingle, _, need, _ in tests:
        wanted.setdefault(t, {}).setdefault((part, need), set()).add(shingle)
    want = {}
    for k, text in texts:
        words = re.findall("[0-9a-z]+", text.lower())
        have = {" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))}
        found = {t for t, parts in wanted.items() if all(len(s & have) >= need * len(s) for (_, need), s in parts.items())}
        want[k] = {known[t][0] for t in found if not any((t, u) in within for u in found)}
    return want


def license_recall(spark, texts):
    want = exact_licenses(texts)
    got = {x["doc_id"]: set(x["licenses"]) for x in license_scan.scan(spark.createDataFrame(texts, "doc_id long, text string").repartition(3)).collect()}
    assert all(got[k] <= want[k] for k in want)
    return sum(len(got[k] & want[k]) for k in want) / sum(map(len, want.values()))


def test_license_recall_against_exact_containment(spark):
    """Texts that hold one to four notices in turn, some with a word changed: what the bands retrieve is nearly
    all of what is there."""
    r = random.Random(6)
    names = list(license_scan.TEMPLATES)
    rows = []
    for k in range(240):
        parts = [passage(7000 + k, r.randint(5, 80))]
        for name in r.sample(names, r.randint(1, 4)):
            words = license_scan.TEMPLATES[name].split()
            if r.random() < 0.3 and len(words) > 15:
                words[r.randrange(len(words))] = "changed"
            parts += [" ".join(words), passage(r.randrange(10**6), r.randint(0, 30))]
        rows.append((k, "\n".join(parts)))
    assert license_recall(spark, rows) >= 0.99


def test_license_recall_of_short_wordings_beside_long_texts(spark):
    """Every short wording right before, and right after, every long text of another license."""
    long = [(k, max(license_scan.WORDINGS[k], key=len)) for k in ("MIT", "Apache-2.0", "BSD-3-Clause", "BSD-2-Clause")]
    short = [(k, t) for k, ts in [*license_scan.WORDINGS.items(), *((k, [t]) for k, t in license_scan.TEMPLATES.items())] for t in ts if len(re.findall("[0-9A-Za-z]+", t)) <= 6]
    texts = [t for k, x in short for j, y in long if j != k for t in (f"{x}\n{y}", f"{y}\n{x}")]
    assert len(texts) > 400
    assert license_recall(spark, list(enumerate(texts))) >= 0.99


def test_license_recall_of_long_texts_with_changes(spark):
    """Long texts of which up to a fifth of the words are changed or left out, in long documents."""
    r = random.Random(8)
    rows = []
    for k in range(120):
        words = r.choice([t for ts in license_scan.WORDINGS.values() for t in ts if len(t) > 150]).split()
        share = r.uniform(0, 0.2)
        at = r.randrange(len(words))
        words = words[:at] + ["changed"] * int(share * len(words) * 0.5) + words[at + int(share * len(words)) :]
        rows.append((k, f"{passage(k, 300)} {' '.join(words)} {passage(k + 500, 300)}"))
    assert license_recall(spark, rows) >= 0.98


# ---- 9 -------------------------------------------------------------------------------------


def test_sstable(spark, docs, none, texts, tmp_path):
    tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    manifest = sstable.write_shards(docs, f"file://{tmp_path}/a", path)
    got = sstable.read_shards(manifest, f"file://{tmp_path}/a").collect()
    ids = lambda x: [*t.encode(x or "", add_special_tokens=False).ids, 2]
    assert multiset((r["doc_id"], bytes(r["ids"])) for r in got) == multiset((i, np.array(ids(x), "<u4").tobytes()) for i, x, _ in texts)
    order = sorted(got, key=lambda r: r["start"])
    assert [r["doc_id"] for r in order] == sorted((i for i, *_ in texts), key=lambda i: (i is not None, i))
    assert all(b["start"] == a["start"] + len(a["ids"]) // 4 for a, b in zip(order, order[1:], strict=False))
    one = manifest.orderBy("shard").first()["path"]
    with open(one, "rb") as f:
        reader = sstable.ShardReader(f, f.seek(0, 2))
        some = next(r for r in order if r["doc_id"] == sstable.id_of(reader.index[0][0]))
        assert bytes(some["ids"]) in [x.tobytes() for x in reader.get(some["doc_id"])]
        assert reader.get(987654321) == []
    assert sstable.read_shards(sstable.write_shards(none, f"file://{tmp_path}/b", path), f"file://{tmp_path}/b").count() == 0


@pytest.mark.parametrize("text", ["it's 2020's  don't\n\n0 zero 0\t x", "<|endoftext|> a<|endoftext|>b", "É́ ß ＡＢ  x y \x1cz \x85", "x" * 300, "0", " ", "a 0 b 10 c"])
def test_word_by_word_encoding(text):
    tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = tokenizers.path("word_bpe_49k.json")
    assert np.frombuffer(sstable.Encoder(path).encode([text])[0], "<u4").tolist() == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids


# ---- 10 ------------------------------------------------------------------------------------


def hits(text, items):
    split = lambda x: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in x or ""))
    words, covered, found = split(text), set(), set()
    for i, x in items:
        w = split(x)
        n = min(13, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            for at in range(len(words) - n + 1):
                if words[at : at + n] == w[k : k + n]:
                    covered |= set(range(at, at + n))
                    found.add(str(i))
    return len(words), len(covered), ",".join(sorted(found))


@pytest.mark.parametrize("short", [[], [(7, "one Two three"), (8, "é"), (9, None), (10, "")]])
def test_decontamination(spark, docs, none, texts, short):
    items = [(1, passage(2, 40)), (2, " ".join(passage(5, 120).split()[30:43]) + "!"), (3, passage(3, 25)), (3, passage(11, 14)), *short]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.find(docs, bench).collect()
    rows = [(i, t) for i, t, _ in texts if i != 51]  # the long text by itself, below
    assert multiset((r["doc_id"], r["n_words"], r["n_hit"], ",".join(r["items"])) for r in got if r["doc_id"] != 51) == multiset((i, *hits(t, items)) for i, t in rows)
    assert next(r for r in got if r["doc_id"] == 51)["n_words"] == 30_000
    assert decontaminate.find(none, bench).count() == 0
    assert {r["n_hit"] for r in decontaminate.find(docs, bench.limit(0)).collect()} == {0}
    bad = sum(h > 0 and 20 * h >= n for n, h, _ in (hits(t, items) for _, t in rows))
    for r in got:  # spans are the covered stretches: apart, in order, as long as n_hit in all
        ends = [x for p in r["spans"] for x in (p["start"], p["end"])]
        assert ends == sorted(set(ends)) and sum(p["end"] - p["start"] for p in r["spans"]) == r["n_hit"]
    clashing = docs.withColumns({c: F.lit(1) for c in ("bad_id", "bad_k", "i", "id", "key", "th", "w", "_r")})
    assert decontaminate.keep_clean(clashing, bench).columns == clashing.columns
    assert decontaminate.keep_clean(none, bench).count() == 0
    kept = decontaminate.keep_clean(docs, bench)
    assert kept.columns == docs.columns and kept.count() == len(texts) - bad


def test_digest_of_nothing(spark):
    assert spark.range(1).select(F.sha2(F.array_join(F.expr("cast(array() as array<string>)"), ","), 256)).first()[0] == hashlib.sha256(b"").hexdigest()
