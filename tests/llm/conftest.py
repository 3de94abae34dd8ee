from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, shard int, row string, k long, count long, spans string, score double"


def passage(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="session")
def texts() -> list[tuple[int | None, str | None, str | None]]:
    """(id, text, source): null and empty texts, ties, copies, near copies, repeated rows, a long text,
    benchmark passages, personal data, junk, chunks that repeat."""
    base = [passage(k, 120) for k in range(12)]
    block = "\n".join(passage(900 + k, 9) for k in range(12))
    rows: list[tuple[int | None, str | None, str | None]] = [(k, t + ". " + t[:40] + ".", f"s{k % 3}") for k, t in enumerate(base)]
    near = base[3].split()
    rows += [(20 + k, " ".join([*near[:k], "changed", *near[k + 1 :]]), "s0") for k in range(5)]
    rows += [(30 + k, base[4].upper() if k % 2 else base[4], "s1") for k in range(4)]
    rows += [(40, None, "s1"), (41, "", None), (42, " \n\t ", "s2"), (43, "one two three", "s2"), (44, "ONE two\nthree", "s2")]
    rows += [(50, base[5] + " " + base[6], "s0"), (50, base[5] + " " + base[6], "s0"), (51, passage(77, 30_000), "s0")]
    rows += [(60, base[7] + "\n" + block + "\n" + base[8], "s1"), (61, passage(61, 60) + "\n" + block, "s1"), (62, block + "\n" + passage(62, 60), None)]
    rows += [(None, base[9], "s1"), (None, "x y", None)]
    rows += [(70, "mail me: a.b+c@ex-ample.co.uk or 10.0.0.256, 10.0.0.25; card 4111 1111 1111 1111, call +49 (30) 1234-5678. IBAN DE89 3704 0044 0532 0130 00 é@x.y 1.2.3.4.5", "s2")]
    rows += [(71, "buy | now | " * 60, "s0"), (72, ("BUY NOW!! " * 60).strip(), "s0"), (73, passage(73, 90) + "\nReleased under the MIT License.\n" + passage(74, 30), "s0")]
    return rows


@pytest.fixture(scope="session")
def docs(spark, texts):
    """The rows with further columns whose names clash with those the operators use."""
    rows = [(i, t, "en", s, len(t or ""), 1, 2, "r", 3, 4, "sp", 0.5) for i, t, s in texts]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(docs):
    return docs.limit(0)
