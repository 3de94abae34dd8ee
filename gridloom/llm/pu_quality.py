"""Quality classifier from positive and unlabelled texts.

Each text becomes a few counts and shares, and hashed n-grams: the shares of its words and of its three-byte
strings that fall into each of ``BUCKETS`` buckets, of which those go into the model that differ most between trusted
texts and the mixture.  An additive model over quantile bins of these is fitted
by the non-negative unbiased risk (positives carry the class prior; the negative part of the
risk, estimated from unlabelled minus positive texts, is kept from going below zero).  The class
prior is estimated too, from the mixture alone: in the region above any threshold of a first model's
score, unlabelled mass per positive mass is at least the prior.  The region is chosen whose ratio has the least
upper bound, ``DEVIATIONS`` standard errors up, on halves that the first model was not fitted on.  Where
the risk is held at zero, the fit stops short of the negatives it has found last; so the bias is set such that the
share of the mixture above one half is about the prior, in the widest gap between scores there.  No
text with a negative label is trained on as such, and the share of labels is never read.

The fit sees about ``MAX_POSITIVE`` trusted and ``MAX_UNLABELLED`` other texts, those whose seeded hash
is below a bound made from counts; every text is scored.

Edge cases: null and empty texts have all-zero features and get a score like any other; null
ids are scored and never drawn as trusted; repeated rows each give a row and are drawn once; rows of
equal features tie in score.  Very long texts are counted in one pass, in time in proportion to their
length.  Without positives or without other texts every score is the prior, 0.5.  Empty tables give
empty results; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm._common import cut, small

MAX_POSITIVE, MAX_UNLABELLED, BINS, SEED = 12_000, 24_000, 12, 5
STEPS, RATE, PENALTY = 800, 0.1, 2e-4
#: Standard errors in the choice of the region that the prior is read from, which holds that share of the trusted texts
#: at least; and standard errors of what is near the prior.
DEVIATIONS, REGION, NEAR = 1.5, 0.5, 2.0
#: Buckets of hashed words, and as many of three-byte strings; and how many of all these the model takes.
BUCKETS, TAKEN = 64, 16

_SYMBOLS = re.compile(r"[#*$%&|<>]")
_UPPER = re.compile(r"[A-Z]")
_DIGITS = re.compile(r"[0-9]")
_MARKS = re.compile(r"[.,;:?]")
NAMES = (
    "log_words", "word_length", "long_words", "distinct", "top_word", "same_as_next", "repeated_triples", "symbols", "pipes", "bangs", "upper", "upper_words", "digits",
    "marks", "stops", "not_ascii", "lines", "duplicate_lines", "line_words", "urls", "curly",
)


def counted(text: str) -> list[float]:
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(NAMES)
    chars = sum(map(len, words))
    counts = Counter(words)
    triples = Counter(zip(words, words[1:], words[2:], strict=False))
    lines = [x for x in text.split("\n") if x.strip()]
    upper = len(_UPPER.findall(text))
    return [
        np.log1p(n),
        chars / n,
        sum(len(w) > 14 for w in counts) / len(counts),
        len(counts) / n,
        max(counts.values()) / n,
        sum(map(str.__eq__, words, words[1:])) / n,
        sum(c for c in triples.values() if c > 1) / n,
        len(_SYMBOLS.findall(text)) / n,
        text.count("|") / n,
        text.count("!") / n,
        upper / chars,
        sum(w.isupper() for w in counts) / len(counts),
        len(_DIGITS.findall(text)) / chars,
        len(_MARKS.findall(text)) / n,
        text.count(".") / n,
        (len(text.encode("utf-8", "surrogatepass")) - len(text)) / chars,
        len(lines) / n,
        1 - len(set(lines)) / len(lines),
        np.log1p(n / len(lines)),
        (text.count("http") + text.count("www.")) / n,
        (text.count("{") + text.count("}") + text.count("=")) / n,
    ]


_WORD = {}


def bucket_of(word: str) -> int:
    """A word's bucket, kept while the table is small."""
    if word not in _WORD:
        if len(_WORD) > 100_000:
            _WORD.clear()
        _WORD[word] = zlib.crc32(word.encode("utf-8", "surrogatepass")) % BUCKETS
    return _WORD[word]


def hashed(text: str) -> np.ndarray:
    """Shares of the words and of the three-byte strings that fall into each bucket."""
    words = text.split()
    of_words = np.bincount(np.fromiter(map(bucket_of, words), np.int64, len(words)), minlength=BUCKETS) / max(1, len(words))
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint32)
    three = (raw[:-2] << 16) | (raw[1:-1] << 8) | raw[2:]
    of_bytes = np.bincount((three * np.uint32(2654435761)) >> np.uint32(32 - BUCKETS.bit_length() + 1), minlength=BUCKETS) / max(1, len(three))
    return np.concatenate([of_words, of_bytes])


def features(text: str | None) -> np.ndarray:
    """Counts first, hashed n-grams behind them."""
    text = text or ""
    return np.concatenate([counted(text), hashed(text)]).astype(np.float32)


WIDTH = len(NAMES) + 2 * BUCKETS


def unpacked(rows: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(rows), np.float32).reshape(-1, WIDTH).astype(np.float64)


def featured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, features) of every row; features as packed 32-bit numbers."""

    def run(batches):
        for batch in batches:
            rows = [features(t).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(rows, pa.binary())], ["doc_id", "features"])

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, "doc_id long, features binary")


class Model:
    """bias + sum over the features it takes of a weight per quantile bin."""

    def __init__(self, edges: list[np.ndarray], taken: np.ndarray, weights: np.ndarray, bias: float):
        self.edges, self.taken, self.weights, self.bias = edges, taken, weights, bias

    def places(self, x: np.ndarray) -> np.ndarray:
        """Column numbers of the bins, one per feature."""
        width = BINS + 1
        return np.stack([np.searchsorted(e, x[:, f], "right") + k * width for k, (e, f) in enumerate(zip(self.edges, self.taken, strict=True))], 1)

    def raw(self, places: np.ndarray) -> np.ndarray:
        return self.bias + self.weights[places].sum(1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(self.places(x)), -30, 30)))


def _fit(model: Model, p: np.ndarray, u: np.ndarray, prior: float | None) -> None:
    """Adam on the risk.  prior None: plain positive against unlabelled, for the prior's estimate."""
    width = len(model.weights)
    penalty = PENALTY + 0.1 / max(1, len(p))
    state = np.zeros((2, width + 1))
    theta = np.zeros(width + 1)
    sig = lambda g: 1 / (1 + np.exp(-np.clip(g, -30, 30)))
    soft = lambda g: np.logaddexp(0, g)

    def pull(places, d):
        return np.append(np.bincount(places.ravel(), np.repeat(d, places.shape[1]), width), d.sum()) / len(d)

    for t in range(1, STEPS + 1):
        model.weights, model.bias = theta[:-1], theta[-1]
        gp, gu = model.raw(p), model.raw(u)
        if prior is None:
            grad = pull(p, sig(gp) - 1) + pull(u, sig(gu))
        else:
            negative = soft(gu).mean() - prior * soft(gp).mean()
            push = pull(u, sig(gu)) - prior * pull(p, sig(gp))
            grad = prior * pull(p, sig(gp) - 1) + push if negative >= 0 else -push
        grad[:-1] += penalty * theta[:-1]
        state[0] = 0.9 * state[0] + 0.1 * grad
        state[1] = 0.99 * state[1] + 0.01 * grad**2
        theta = theta - RATE * (state[0] / (1 - 0.9**t)) / (np.sqrt(state[1] / (1 - 0.99**t)) + 1e-8)
    model.weights, model.bias = theta[:-1], theta[-1]


def risk(gp: np.ndarray, gu: np.ndarray, prior: float) -> tuple[float, float]:
    """The risk's positive part, and its negative part before it is held at zero or above."""
    soft = lambda g: np.logaddexp(0, g).mean()
    return prior * soft(-gp), soft(gu) - prior * soft(gp)


def estimate_prior(gp: np.ndarray, gu: np.ndarray) -> float:
    """Ratio of unlabelled to positive mass above the threshold at which its upper bound is least."""
    cuts = np.unique(np.append(gp, gu))
    above = lambda g: 1 - np.searchsorted(np.sort(g), cuts, "left") / len(g)
    p, u = above(gp), above(gu)
    error = lambda share, g: np.sqrt(np.maximum(share * (1 - share), 1 / len(g)) / len(g))
    low = p - DEVIATIONS * error(p, gp)
    some = (low > 0) & (p >= REGION)
    if not some.any():
        return 0.5
    best = int(np.argmin((u[some] + DEVIATIONS * error(u, gu)[some]) / low[some]))
    return float(np.clip(u[some][best] / p[some][best], 0.02, 0.98))


def differ_most(p: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Numbers of the features that a model takes: all counts, and the hashed ones whose distributions are farthest
    apart (by the largest difference between their shares below any value)."""
    def apart(k: int) -> float:
        at = np.unique(np.append(p[:, k], u[:, k]))
        below = lambda x: np.searchsorted(np.sort(x[:, k]), at, "right") / len(x)
        return float(np.abs(below(p) - below(u)).max())

    counts = min(len(NAMES), p.shape[1])
    ranked = sorted(range(counts, p.shape[1]), key=lambda k: (-apart(k), k))
    return np.array([*range(counts), *sorted(ranked[:TAKEN])])


def train(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None = None) -> tuple[Model, float]:
    both = np.concatenate([positive, unlabelled])
    taken = differ_most(positive, unlabelled)
    edges = [np.unique(np.quantile(both[:, k], np.linspace(0, 1, BINS + 1)[1:])) for k in taken]
    empty = lambda: Model(edges, taken, np.zeros(len(edges) * (BINS + 1)), 0.0)
    model = empty()
    p, u = model.places(positive), model.places(unlabelled)
    if prior is None:
        halves = []
        for k in (0, 1):
            if min(len(p), len(u)) < 2:
                break
            first = empty()
            _fit(first, p[k::2], u[k::2], None)
            halves.append([first.raw(x[1 - k :: 2]) for x in (p, u)])
        prior = estimate_prior(*(np.concatenate(x) for x in zip(*halves, strict=True))) if halves else 0.5
    _fit(model, p, u, prior)
    model.bias -= valley(model.raw(u), prior, min(len(p), len(u)))
    return model, prior


def valley(raw: np.ndarray, prior: float, known: int) -> float:
    """The middle of the widest gap between scores, where the share above is the prior or near it: by the standard
    error of a share of ``known`` texts, ``NEAR`` times, up or down."""
    raw, wide = np.sort(raw), NEAR * np.sqrt(prior * (1 - prior) / known)
    at = [int(np.clip(round(len(raw) * (1 - share)), 1, len(raw) - 1)) for share in (prior + wide, prior - wide)]
    if len(raw) < 2:
        return float(raw[0])
    k = at[0] + int(np.argmax(np.diff(raw[at[0] - 1 : at[1] + 1])))
    return float((raw[k - 1] + raw[k]) / 2)


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted.  Labels are read only where
    crc32 of the id's text, modulo 3, is not 1."""
    rows = cut(featured(docs, id_col, text_col).withColumn("row", F.xxhash64("doc_id", "features")), "features")
    out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1
    trusted = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality").filter("quality = 1").filter(~out).select("doc_id").distinct()
    marked = small(cut(trusted.withColumn("trusted", F.lit(True)), "trusted"))
    parts = rows.join(marked, "doc_id", "left").select("row", "features", F.coalesce("trusted", F.lit(False)).alias("trusted"))
    size = {r["trusted"]: r["n"] for r in parts.groupBy("trusted").agg(F.count_distinct("row").alias("n")).collect()}
    size = [size.get(k, 0) for k in (True, False)]
    bound = [int(min(1.0, most / max(1, n)) * (1 << 40)) for most, n in zip((MAX_POSITIVE, MAX_UNLABELLED), size, strict=True)]
    below = F.pmod(F.xxhash64(F.lit(SEED), "row"), F.lit(1 << 40)) < F.when(F.col("trusted"), bound[0]).otherwise(bound[1])
    found = parts.filter(below).dropDuplicates(["row", "trusted"]).collect()  # about MAX_POSITIVE and MAX_UNLABELLED rows
    drawn = [unpacked([bytes(r["features"]) for r in sorted((r for r in found if r["trusted"] == k), key=lambda r: r["row"])]) for k in (True, False)]
    positive, unlabelled = drawn
    model = None
    if len(positive) and len(unlabelled):
        # Unlabelled text is to be a sample of the whole mixture: trusted texts go in by their share.
        back = min(len(positive), round(len(unlabelled) * size[0] / max(1, size[1])))
        mixed = np.concatenate([unlabelled, positive[:back]])
        model, _ = train(positive, mixed[np.random.default_rng(SEED).permutation(len(mixed))])

    def run(batches):
        for batch in batches:
            x = unpacked(batch.column(1).to_pylist())
            s = model.score(x) if model is not None else np.full(len(x), 0.5)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s)], ["doc_id", "score"])

    scored = rows.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
