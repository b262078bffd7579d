"""Personal data in texts: patterns propose spans, checksums confirm them, words nearby move the score.

Four base kinds (email, ip, card, phone) stand whatever their score; five more (iban, nir,
dni, steuer_id, ssn) are reported where the score reaches `LEAST`. A proposal starts with its kind's
prior, gains `CONFIRMED` by its checksum (Luhn for cards, mod 97 for iban and nir, a
mod-23 letter for dni, iterated mod 11,10 for steuer_id; a failed one ends it), gains or loses
`CONTEXT` by words in the code points before it. All offsets are code points, ends exclusive.

Every pattern runs in time linear in the text: the numeric ones only inside stretches of
digits and separators, the email one from each `@` outwards.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BASE = ("email", "ip", "card", "phone")
ADDED = ("iban", "nir", "dni", "steuer_id", "ssn")
ORDER = {kind: k for k, kind in enumerate((*BASE, *ADDED))}

# fixed values: the patterns of the base kinds
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
IP = r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
CARD = r"[0-9]([\x20-]?[0-9])+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# fixed values: shapes of the added kinds
SHAPES = {
    "iban": r"\b[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)\b",
    "nir": r"\b[12] ?[0-9]{2} ?(?:0[1-9]|1[0-2]) ?[0-9]{2} ?[0-9]{3} ?[0-9]{3} ?[0-9]{2}\b",
    "dni": r"\b[0-9]{8}-?[A-Z]\b",
    "steuer_id": r"\b[0-9]{2} ?[0-9]{3} ?[0-9]{3} ?[0-9]{3}\b",
    "ssn": r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b",
}
DNI_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"

# scores in per cent
PRIOR = {"email": 80, "ip": 50, "card": 40, "phone": 60, "iban": 30, "nir": 30, "dni": 10, "steuer_id": 10, "ssn": 40}
CONFIRMED, CONTEXT, LEAST = 40, 30, 60
CHECKED = ("card", "iban", "nir", "dni", "steuer_id")
NEAR = 40  # code points before a span in which words count
HINTS = {
    "email": "mail|contact|kontakt|correo|courriel",
    "ip": "ip|host|server|login|address",
    "card": "card|karte|carte|tarjeta|visa|mastercard",
    "phone": "tel|phone|call|mobil|fax",
    "iban": "iban|bank|konto|compte|cuenta|account",
    "nir": "nir|insee|secu|social",
    "dni": "dni|nif|documento|identidad",
    "steuer_id": "steuer|idnr|tax",
    "ssn": "ssn|social security",
}
CONTRARY = "version|isbn|order|invoice|serial|example|sample|test"

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# the characters of all numeric kinds; a match of seven or more lies inside one stretch
_STRETCH = re.compile(r"[+0-9][0-9+ ().-]{6,}")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")  # a start inside a run of digits finds no more than its first digit
_CARD = re.compile(CARD.replace("(", "(?:"))
_PHONE = re.compile(PHONE)
_SHAPES = {kind: re.compile(shape, re.ASCII) for kind, shape in SHAPES.items()}
_HINTS = {kind: re.compile(words, re.IGNORECASE | re.ASCII) for kind, words in HINTS.items()}
_CONTRARY = re.compile(CONTRARY, re.IGNORECASE | re.ASCII)


class Span(NamedTuple):
    start: int
    rank: int
    end: int
    score: int


def luhn(digits: str) -> bool:
    """Every second digit from the right doubled, its digits added: the sum ends in 0."""
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        total += n if k % 2 == 0 else (2 * n if n < 5 else 2 * n - 9)
    return total % 10 == 0


def mod97(code: str) -> bool:
    """Country and check digits moved behind, letters as 10 to 35: the number leaves 1 on division by 97."""
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def nir_key(digits: str) -> bool:
    """The last two digits are 97 less the rest of the 13 before them."""
    return int(digits[13:]) == 97 - int(digits[:13]) % 97


def dni_letter(code: str) -> bool:
    return DNI_LETTERS[int(code[:8]) % 23] == code[-1]


def mod11_10(digits: str) -> bool:
    """Iterated product check over the digits before the last; the first digit is not 0."""
    product = 10
    for c in digits[:-1]:
        product = ((int(c) + product) % 10 or 10) * 2 % 11
    return digits[0] != "0" and (11 - product) % 10 == int(digits[-1])


def issued(digits: str) -> bool:
    """Ranges that are handed out as social security numbers."""
    area = int(digits[:3])
    return area not in (0, 666) and area < 900 and digits[3:5] != "00" and digits[5:] != "0000"


_VALID = {"iban": mod97, "nir": nir_key, "dni": dni_letter, "steuer_id": mod11_10, "ssn": issued}
_DROP = str.maketrans("", "", " -")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            free = domain.end()
            yield start, free
        else:
            free = at + 1
        at = text.find("@", free)


def _proposals(text: str) -> Iterator[tuple[str, int, int]]:
    """(kind, start, end) of all spans that their checks confirm."""
    for start, end in _emails(text):
        yield "email", start, end
    for s in _STRETCH.finditer(text):
        first, last = s.span()
        for m in _IP.finditer(text, first, last):
            parts = [p.lstrip("0") for p in m[0].split(".")]
            if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
                yield "ip", *m.span()
        for m in _CARD.finditer(text, first, last):
            digits = m[0].translate(_DROP)
            if 12 <= len(digits) <= 19 and luhn(digits):
                yield "card", *m.span()
        if "+" in s[0]:
            for m in _PHONE.finditer(text, first, last):
                if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                    yield "phone", *m.span()
        # a letter may end a match, and the character behind it says whether it does
        for kind in ("nir", "dni", "steuer_id", "ssn"):
            for m in _SHAPES[kind].finditer(text, first, min(last + 2, len(text))):
                if _VALID[kind](m[0].translate(_DROP)):
                    yield kind, *m.span()
    for m in _SHAPES["iban"].finditer(text):
        if mod97(m[0].translate(_DROP)):
            yield "iban", *m.span()


def _score(text: str, kind: str, start: int) -> int:
    before = text[max(0, start - NEAR) : start]
    score = PRIOR[kind] + (CONFIRMED if kind in CHECKED else 0)
    if _HINTS[kind].search(before):
        score += CONTEXT
    if _CONTRARY.search(before):
        score -= CONTEXT
    return max(0, min(score, 100))


def find_spans(text: str | None) -> list[Span]:
    """All spans of a text by start, then kind in its listed order; a null text has none."""
    found = []
    for kind, start, end in _proposals(text or ""):
        score = _score(text, kind, start)
        if kind in BASE or score >= LEAST:
            found.append(Span(start, ORDER[kind], end, score))
    return sorted(found)


_NAMES = tuple(ORDER)


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{_NAMES[s.rank]}:{s.start}:{s.end}" for s in spans)


def personal_spans(docs: DataFrame, text_column: str = "text", id_column: str = "doc_id") -> DataFrame:
    """doc_id, kind, start, end, score, value: one row per span.

    Null and empty texts and texts without personal data give no row; repeated rows repeat
    theirs. Only the two named columns are read.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(i, _NAMES[s.rank], s.start, s.end, s.score, t[s.start : s.end]) for i, t in zip(pdf["doc_id"].astype("Int64"), pdf["text"], strict=True) for s in find_spans(t)]
            yield pd.DataFrame(rows, columns=["doc_id", "kind", "start", "end", "score", "value"]).astype({"doc_id": "Int64"})

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    return rows.mapInPandas(run, "doc_id long, kind string, start long, end long, score int, value string")


def personal_digests(docs: DataFrame, text_column: str = "text", id_column: str = "doc_id") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added, risk of every row.

    risk is the greatest score of any span, 0 without one. A null text counts as empty; repeated rows
    give repeated rows; only the two named columns are read.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for t in pdf["text"]:
                spans = find_spans(t)
                base = [s for s in spans if s.rank < len(BASE)]
                counts = [sum(s.rank == k for s in base) for k in range(len(BASE))]
                digest = hashlib.sha256(_joined(base).encode()).hexdigest()
                rows.append((*counts, digest, _joined(spans), len(spans) - len(base), max((s.score for s in spans), default=0)))
            out = pd.DataFrame(rows, columns=[*[f"n_{kind}" for kind in BASE], "base_sha256", "spans", "n_added", "risk"])
            out.insert(0, "doc_id", pdf["doc_id"].astype("Int64").to_numpy())
            yield out

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    counts = ", ".join(f"n_{kind} long" for kind in BASE)
    return rows.mapInPandas(run, f"doc_id long, {counts}, base_sha256 string, spans string, n_added long, risk int")


def mask(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """The rows with every span, merged where spans overlap, replaced by its kind in brackets.

    A merged stretch takes the name of its first span. Null texts stay null; all other columns stay as they are.
    """

    @F.pandas_udf("string")
    def masked(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([None if t is None else masked_text(t) for t in texts], dtype=object)

    return docs.withColumn(text_column, masked(F.col(text_column).cast("string")))


def masked_text(text: str) -> str:
    out, at = [], 0
    for s in find_spans(text):
        if s.start >= at:
            out += [text[at : s.start], f"[{_NAMES[s.rank]}]"]
        at = max(at, s.end)
    return "".join(out) + text[at:]
