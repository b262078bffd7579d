"""Personal data: base spans against the plain patterns, checksums, context, odd rows, time on hostile texts."""

from __future__ import annotations

import hashlib
import random
import re
import time

import duckdb

from fenland.llm import personal_data as pd_
from fenland.llm.sql_twins import OP13_SQL


def plain_base(text: str | None) -> str:
    text = text or ""
    out = [(m.start(), 0, f"email:{m.start()}:{m.end()}") for m in re.finditer(pd_.EMAIL, text)]
    out += [(m.start(), 1, f"ip:{m.start()}:{m.end()}") for m in re.finditer(pd_.IP, text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(pd_.CARD, text):
        digits = [int(c) for c in m[0] if c.isdigit()]
        doubled = [sum(divmod(2 * d, 10)) if k % 2 else d for k, d in enumerate(reversed(digits))]
        if 12 <= len(digits) <= 19 and sum(doubled) % 10 == 0:
            out.append((m.start(), 2, f"card:{m.start()}:{m.end()}"))
    out += [(m.start(), 3, f"phone:{m.start()}:{m.end()}") for m in re.finditer(pd_.PHONE, text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return ",".join(x[2] for x in sorted(out))


def with_luhn(rng: random.Random, n: int) -> str:
    body = "".join(rng.choice("0123456789") for _ in range(n - 1))
    return next(body + c for c in "0123456789" if pd_.luhn(body + c))


def random_text(rng: random.Random) -> str:
    parts = ["a.b@c.de", "x@y", "@", "a@b@c.d-e.f", "1.2.3.4", "256.1.1.1", "001.002.3.4.5", "+49 (30) 123-456 78", "+1", "++44 2079460958", " ", "é", "\n", "-", "."]
    out = []
    for _ in range(rng.randint(0, 12)):
        kind = rng.random()
        if kind < 0.5:
            out.append(rng.choice(parts))
        elif kind < 0.7:
            out.append(with_luhn(rng, rng.randint(11, 20)))
        else:
            out.append("".join(rng.choice("0123456789 -.+()a@") for _ in range(rng.randint(1, 25))))
        out.append(rng.choice(["", " ", " word "]))
    return "".join(out)


def base_of(text: str | None) -> str:
    return ",".join(f"{tuple(pd_.ORDER)[s.rank]}:{s.start}:{s.end}" for s in pd_.find_spans(text) if s.rank < len(pd_.BASE))


def test_base_spans_equal_the_plain_patterns():
    rng = random.Random(7)
    for _ in range(6000):
        text = random_text(rng)
        assert base_of(text) == plain_base(text), text


ADDED = [
    ("IBAN DE89 3704 0044 0532 0130 00 bitte", "iban:5:32"),
    ("pay GB82WEST12345698765432 now", "iban:4:26"),
    ("pay GB82WEST12345698765431 now", ""),
    ("an example: GB82WEST12345698765432", ""),
    ("nir 1 84 12 76 451 089 46", "nir:4:25"),
    ("DNI 12345678Z", "dni:4:13"),
    ("part 12345678Z", ""),
    ("Steuer-ID 86 095 742 719", "steuer_id:10:24"),
    ("86 095 742 719 boxes", ""),
    ("SSN 123-45-6789", "ssn:4:15"),
    ("SSN 666-45-6789, order 123-45-6789", ""),
    ("123-45-6789x", ""),
]


def test_added_kinds(spark):
    rows = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(ADDED)], "doc_id long, text string")
    got = {r.doc_id: r for r in pd_.personal_digests(rows).collect()}
    assert [got[k].spans for k in range(len(ADDED))] == [want for _, want in ADDED]
    assert all(r.n_added == (r.spans != "") and r.base_sha256 == hashlib.sha256(b"").hexdigest() for r in got.values())


def test_sql_twin_on_random_texts(spark):
    rng = random.Random(8)
    texts = [random_text(rng) for _ in range(1500)] + [t for t, _ in ADDED] + ["", None]
    words = ["iban ", "bank GB82WEST12345698765432 ", "ssn 123-45-6789 ", "order ", "dni 12345678Z ", "tel. "]
    texts += [" ".join(rng.choice(words) + random_text(rng) for _ in range(4)) for _ in range(500)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = pd_.personal_digests(rows)
    with duckdb.connect() as con:
        documents = rows.toPandas()  # noqa: F841  read by the SQL
        cursor = con.execute(OP13_SQL)
        names = [d[0] for d in cursor.description]
        want = sorted(map(repr, cursor.fetchall()))
    assert want == sorted(repr(tuple(r)) for r in got.select(*names).collect())


def test_hostile_texts_take_linear_time():
    start = time.perf_counter()
    for text in ("x" * 400_000, "1" * 400_000, "1." * 200_000, "+1" * 200_000, "+" + "1 " * 200_000, "a@" * 200_000, "(" * 400_000, "A1 " * 130_000):
        pd_.find_spans(text)
    assert time.perf_counter() - start < 20


def test_odd_rows_and_mask(spark, odd_docs, odd_rows):
    got = pd_.personal_digests(odd_docs).collect()
    assert sorted((str(r.doc_id), r.base_sha256) for r in got) == sorted((str(i), hashlib.sha256(plain_base(t).encode()).hexdigest()) for i, t, *_ in odd_rows)
    assert pd_.personal_digests(odd_docs.limit(0)).count() == 0 and pd_.personal_spans(odd_docs.limit(0)).count() == 0
    masked = pd_.mask(odd_docs)
    rest = [c for c in odd_docs.columns if c != "text"]
    assert masked.schema == odd_docs.schema
    assert sorted(map(repr, masked.select(*rest).collect())) == sorted(map(repr, odd_docs.select(*rest).collect()))
    rows = spark.createDataFrame([(1, "mail a@b.de, card 4111 1111 1111 1111.", "k"), (2, None, "k"), (None, "clean", "k")], "doc_id long, text string, spans string")
    assert {r.doc_id: r.text for r in pd_.mask(rows).collect()} == {1: "mail [email], card [card].", 2: None, None: "clean"}
    assert {(r.kind, r.value, r.score) for r in pd_.personal_spans(rows).collect()} == {("email", "a@b.de", 100), ("card", "4111 1111 1111 1111", 100)}
