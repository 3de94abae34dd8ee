"""Personal data: patterns propose, checksums confirm, context words adjust a score.

Edge cases: a null text counts as empty (no spans); a null ``doc_id`` is passed through;
repeated rows each give a row; an empty table gives an empty result; other columns are
ignored.  Spans of equal start tie by kind.  Work per text grows as its length (and the logarithm of
its number of spans), so very long texts are safe.
"""

from __future__ import annotations

import bisect
import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "ssn", "phone_local")

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGIT = re.compile(r"[0-9]")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_PHONE_LOCAL = re.compile(r"(?<![0-9+(-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9-])")

#: Words that, found near a proposed span, raise its score.
CONTEXT = {
    "email": ("mail", "contact", "write", "@", "reply", "address", "courriel", "correo", "kontakt"),
    "ip": ("ip", "host", "server", "address", "dns", "gateway", "subnet", "login from", "adresse"),
    "card": ("card", "visa", "credit", "payment", "mastercard", "amex", "debit", "karte", "carte", "tarjeta"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "cell", "whatsapp", "anruf", "appel", "llam"),
    "iban": ("iban", "account", "bank", "konto", "transfer", "bic", "swift", "compte", "cuenta"),
    "ssn": ("ssn", "social", "security", "tax", "insurance", "taxpayer"),
    "phone_local": ("phone", "tel", "call", "mobile", "fax", "cell", "dial", "text me", "whatsapp"),
}
#: Score of a proposal before context; a passed checksum is part of it.
PRIOR = {"email": 0.8, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.8, "ssn": 0.45, "phone_local": 0.35}
CONTEXT_BONUS, CONTEXT_CHARS, ACCEPT = 0.2, 40, 0.6


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    turned = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches, found from each ``@`` outwards: a match must hold
    the first ``@`` after its local part, so its start is where the run of local characters
    before that ``@`` begins (not before the previous match's end)."""
    found, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            found.append((start, m.end()))
            free = m.end()
            at = text.find("@", free)
        else:
            at = text.find("@", at + 1)
    return found


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _octets_fit(s: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in s.split("."))


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """The four base kinds; failing matches are dropped without another try."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in BASE_KINDS}
    out["email"] = _emails(text)
    if first := _DIGIT.search(text):
        at = first.start()
        out["ip"] = [m.span() for m in _IP.finditer(text, at) if _octets_fit(m[0])]
        out["card"] = [m.span() for m in _CARD.finditer(text, at) if 13 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
        if "+" in text:
            out["phone"] = [m.span() for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return out


def score(kind: str, text: str, start: int, end: int) -> float:
    near = (text[max(0, start - CONTEXT_CHARS) : start] + " " + text[end : end + CONTEXT_CHARS]).lower()
    return PRIOR[kind] + (CONTEXT_BONUS if any(w in near for w in CONTEXT[kind]) else 0.0)


def find_spans(text: str) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) by kind as in ``KINDS``, then start; code points, end exclusive.
    Base kinds always stay; further kinds need a score of ``ACCEPT``, and never overlap a base span."""
    base = base_spans(text)
    spans = [(k, a, b, score(k, text, a, b)) for k in BASE_KINDS for a, b in base[k]]
    if _DIGIT.search(text):
        starts, ends = [], []  # the base spans' union, in order
        for a, b in sorted((a, b) for _, a, b, _ in spans):
            if ends and a < ends[-1]:
                ends[-1] = max(ends[-1], b)
            else:
                starts.append(a)
                ends.append(b)

        def free(a: int, b: int) -> bool:
            k = bisect.bisect_right(ends, a)
            return k == len(ends) or starts[k] >= b

        for kind, pattern, ok in (
            ("iban", _IBAN, lambda s: mod97(s.replace(" ", ""))),
            ("ssn", _SSN, lambda s: s[:3] not in ("000", "666") and s[0] != "9"),
            ("phone_local", _PHONE_LOCAL, lambda s: True),
        ):
            for m in pattern.finditer(text):
                if ok(m[0]) and (p := score(kind, text, *m.span())) >= ACCEPT and free(*m.span()):
                    spans.append((kind, *m.span(), p))
    return spans


SCHEMA = "doc_id long, text_length long, spans array<struct<kind:string,start:long,end:long,score:double>>"


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every span of every text, one row per input row."""

    def run(batches):
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            spans = [[{"kind": k, "start": a, "end": b, "score": p} for k, a, b, p in find_spans(t)] for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array(spans, kind)], ["doc_id", "text_length", "spans"]
            )

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, SCHEMA)


def redact(text: str, spans: list[tuple[str, int, int, float]]) -> str:
    """``text`` with each accepted span replaced by its kind in brackets."""
    out, at = [], 0
    for kind, a, b, _ in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
            at = b
    return "".join([*out, text[at:]])


def sha256_hex(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()
