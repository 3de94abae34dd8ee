"""Quality rules as weak supervision: each rule votes good, bad or abstains; expectation
maximisation over the counts of vote patterns estimates how often each rule is right; the
posterior probability of quality replaces a filter that wants every rule passed.

Every rule votes both ways, so a document that one rule finds bad is held against the votes of all
others, and how much each vote weighs comes from the fit alone.  The fit is over the documents
that the base rule leaves to the verdict.

Everything per document is DataFrame expressions.  A pattern is one of ``3 ** len(rules())``, so
the table of counts that the driver fits on has a fixed bound whatever the corpus.

Edge cases: null or empty text has no words (base rule fails).  Null ids and repeated rows
are passed through, one row per input row; equal texts get equal verdicts, so there are no ties to
break.  Very long texts cost time in proportion to their length, in one row.  An empty table gives an
empty result, and where no document passes the base rule the verdict rests on the prior counts.
Other columns stay where ``score`` is asked to carry them.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm._common import UPPER, WHITE, WHITE_CHARS, cut, pinned

SYMBOLS = "#*$%&|<>"
OFTEN = WHITE[:-1] + "a-z]+"
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
THRESHOLD = 0.5

_deleted = lambda text, chars: F.length(text) - F.length(F.translate(text, chars, ""))


def with_features(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the counts
    that the further rules use, in columns named ``q_*``."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    blank = lambda c: F.ltrim(c, F.lit(WHITE_CHARS)) == ""
    # Stages are separate projections, so that each array is made once and then read.
    df = docs.withColumn("_t", text)
    df = df.withColumn("_w", pinned(F.filter(F.split("_t", WHITE + "+"), lambda w: w != ""))).withColumn("_l", pinned(F.filter(F.split("_t", "\n"), lambda x: ~blank(x))))
    df = df.withColumn("n_words", F.size("_w").cast("long"))
    # Characters are looked up one by one only in what is left without white space and lower-case letters.
    df = df.withColumn("_c", pinned(F.length(F.regexp_replace("_t", WHITE + "+", "")))).withColumn("_o", pinned(F.regexp_replace("_t", OFTEN, "")))
    # Windows are compared by a 64-bit hash of their three words.
    window = lambda i: F.xxhash64(F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2))
    df = df.withColumn("_g", pinned(F.when(F.col("n_words") >= 3, F.transform(F.sequence(F.lit(0), F.size("_w") - 3), window)).otherwise(F.array().cast("array<bigint>"))))
    some = F.size(F.array_distinct("_g")) < F.size("_g")
    # Places of windows found twice or more, in order; each covers three words.
    df = df.withColumn("_s", pinned(F.when(some, F.sort_array(F.transform("_g", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))))
    same = lambda x, j: (x["h"] == F.get("_s", j - 1)["h"]) | (x["h"] == F.get("_s", j + 1)["h"])
    df = df.withColumn("_p", pinned(F.when(some, F.sort_array(F.transform(F.filter("_s", lambda x, j: F.coalesce(same(x, j), F.get("_s", F.when(j > 0, j - 1))["h"] == x["h"], F.get("_s", j + 1)["h"] == x["h"], F.lit(False))), lambda x: x["i"])))))
    covered = F.aggregate("_p", F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")), lambda a, p: F.struct((p + 3).alias("end"), (a["n"] + p + 3 - F.greatest(a["end"], p)).alias("n")), lambda a: a["n"])
    return df.select(
        *docs.columns,
        "n_words",
        F.col("_c").cast("long").alias("word_chars"),
        _deleted(F.col("_o"), SYMBOLS).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        pinned(F.coalesce(covered, F.lit(0)).cast("long")).alias("n_repeat_words"),
        F.size("_l").cast("long").alias("q_lines"),
        _deleted(F.col("_o"), "!").cast("long").alias("q_bangs"),
        _deleted(F.col("_o"), UPPER).cast("long").alias("q_upper"),
        (F.col("_c") - F.length("_o")).cast("long").alias("q_lower"),
        _deleted(F.col("_o"), PUNCTUATION).cast("long").alias("q_marks"),
        _deleted(F.col("_o"), ".?").cast("long").alias("q_stops"),
    )


def _vote(bad: Column, good: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def rules() -> dict[str, Column]:
    """Rule -> its vote (-1 bad, 0 abstains, 1 good).  Every rule abstains between its two limits."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    chars = F.greatest(F.col("word_chars"), F.lit(1))
    lines = F.greatest(F.col("q_lines"), F.lit(1))
    letters = F.greatest(F.col("q_upper") + F.col("q_lower"), F.lit(1))
    return {
        "length": _vote(n < 80, n >= 120),
        "repeats": _vote(100 * F.col("n_repeat_words") > 20 * n, 100 * F.col("n_repeat_words") < 5 * n),
        "symbols": _vote(100 * F.col("n_symbols") > 10 * n, 100 * F.col("n_symbols") < 2 * n),
        "duplicate_lines": _vote(100 * F.col("n_dup_lines") > 20 * lines, 100 * F.col("n_dup_lines") < 5 * lines),
        "word_length": _vote((10 * chars < 35 * n) | (10 * chars > 70 * n), (10 * chars >= 45 * n) & (10 * chars <= 60 * n)),
        "capitals": _vote(100 * F.col("q_upper") > 20 * letters, 100 * F.col("q_upper") < 5 * letters),
        "punctuation": _vote(100 * F.col("q_marks") > 10 * chars, 100 * F.col("q_marks") < 7 * chars),
        "sentences": _vote((100 * F.col("q_stops") < 2 * n) | (100 * F.col("q_stops") > 20 * n), (100 * F.col("q_stops") >= 4 * n) & (100 * F.col("q_stops") <= 15 * n)),
        "shouting": _vote(100 * F.col("q_bangs") > 5 * n, 100 * F.col("q_bangs") < n),
    }


#: Prior counts of every rule, vote -> (given bad, given good), in parts of ``PRIOR_WEIGHT`` of the documents:
#: what the fit starts from, and what tells it which class is which.
PRIOR = {-1: (0.4, 0.05), 0: (0.2, 0.2), 1: (0.4, 0.75)}
PRIOR_GOOD, PRIOR_WEIGHT = 0.8, 0.01
ROUNDS, CLOSE = 500, 1e-9


def fit(patterns: list[tuple[tuple[int, ...], int]]) -> tuple[float, list[dict[int, tuple[float, float]]]]:
    """Expectation maximisation of a naive model: quality is hidden, rules vote independently given
    it.  patterns: (votes, documents).  Returns the share of good documents and, per rule, vote ->
    (its probability given bad, given good)."""
    width = len(patterns[0][0]) if patterns else 0
    prior = np.array([PRIOR[v] for v in (-1, 0, 1)])
    good, table = PRIOR_GOOD, np.repeat(prior[None], width, 0)
    number = np.array([n for _, n in patterns], float)
    # One row a pattern, and for each rule which of its three votes it has.
    has = np.stack([np.array([p for p, _ in patterns]).reshape(len(patterns), width) == v for v in (-1, 0, 1)], 2).astype(float)
    weight = max(1.0, PRIOR_WEIGHT * number.sum())
    for _ in range(ROUNDS if patterns else 0):
        logs = np.einsum("nkv,kvc->nc", has, np.log(table)) + np.log([1 - good, good])
        share = 1 / (1 + np.exp(np.clip(logs[:, 0] - logs[:, 1], -700, 700)))
        counts = np.stack([np.einsum("n,nkv->kv", number * x, has) for x in (1 - share, share)], 2) + weight * prior
        last, good = good, (number @ share + weight * PRIOR_GOOD) / (number.sum() + weight)
        table = counts / counts.sum(1, keepdims=True)
        if abs(good - last) < CLOSE:
            break
    return float(good), [{v: (float(t[k][0]), float(t[k][1])) for k, v in enumerate((-1, 0, 1))} for t in table]


def evidence(vote: int, rule: dict[int, tuple[float, float]]) -> float:
    """What a rule's vote adds to the log odds of quality."""
    return math.log(rule[vote][1] / rule[vote][0])


def posterior(votes: tuple[int, ...], good: float, table: list[dict[int, tuple[float, float]]]) -> float:
    odds = math.log(good / (1 - good)) + sum(evidence(v, table[k]) for k, v in enumerate(votes))
    return 1 / (1 + math.exp(-max(-700.0, min(700.0, odds))))


def score(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Features, base_failed, the rules' votes (one digit a rule), quality_probability and kept."""
    wanted = docs.select(*keep, *([] if text_col in keep else [text_col]))
    featured = with_features(wanted, text_col)
    votes = rules()
    code = F.concat(*[(v + 1).cast("string") for v in votes.values()])
    featured = featured.withColumn("votes", code)
    # Written once with its features: the fit and the verdict would else each compute them.
    featured = cut(featured.drop(*[c for c in (text_col,) if c not in keep]), "features")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    rows = featured.filter(~failed).groupBy("votes").count().limit(3 ** len(votes)).collect()
    found = [(tuple(int(c) - 1 for c in r["votes"]), r["count"]) for r in rows]
    good, table = fit(sorted(found) or [((0,) * len(votes), 0)])
    # Log odds of a document as a sum over its votes: one small lookup a rule, no join.
    odds = F.lit(math.log(good / (1 - good)))
    for k in range(len(votes)):
        at = F.substring("votes", k + 1, 1)
        odds = odds + F.when(at == "0", evidence(-1, table[k])).when(at == "2", evidence(1, table[k])).otherwise(evidence(0, table[k]))
    out = featured.withColumn("base_failed", failed).withColumn("quality_probability", 1 / (1 + F.exp(-odds)))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("quality_probability") >= THRESHOLD))


def keep_good(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows that the rules reject, columns unchanged."""
    named = docs.select(F.struct(*docs.columns).alias("row"), F.col("text").alias("text"))
    return score(named, keep=("row",)).filter("kept").select("row.*")
