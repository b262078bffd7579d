"""Periodic runs against a plain search over all periods, planted repeats, odd rows."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

from fenland.llm import periodic_runs as pr


def plain_runs(words: list) -> list[tuple[int, int, int]]:
    """Every period compared word by word; stretches whose first period repeats inside itself belong to a smaller one."""
    n, out = len(words), []
    for p in range(1, n // 4 + 1):
        i = 0
        while i + p < n:
            a = i
            while i + p < n and words[i] == words[i + p]:
                i += 1
            root = words[a : a + p]
            if i + p - a >= max(6, 4 * p) and not any(p % g == 0 and root[g:] == root[:-g] for g in range(1, p)):
                out.append((a, i + p - a, p))
            i += 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def repetitive(rng: random.Random) -> list[bytes]:
    letters = rng.choice([1, 2, 3, 5, 40])
    w = [b"%d" % rng.randrange(letters) for _ in range(rng.choice([0, 1, 5, 30, 100, 300]))]
    for _ in range(rng.randint(0, 4)):
        if w:
            a, p = rng.randrange(len(w)), rng.randint(1, max(1, len(w) // 5))
            root = w[a : a + p]
            w = (w[:a] + root * rng.randint(2, 9) + root[: rng.randint(0, len(root))] + w[a + p :])[:600]
    return w


def test_runs_equal_the_plain_search():
    rng = random.Random(3)
    for _ in range(250):
        texts = [repetitive(rng) for _ in range(rng.randint(0, 12))]
        assert [[tuple(r) for r in runs] for runs in pr.runs_of(texts)] == [plain_runs(t) for t in texts]


def test_long_periods_and_nested_repeats():
    rng = random.Random(5)
    inner = [b"%d" % rng.randrange(9) for _ in range(7)]
    root = [b"%d" % rng.randrange(9) for _ in range(3000)] + inner * 40 + [b"x"] * 200
    text = [b"a"] + root * 5 + [b"b"]
    got = [tuple(r) for r in pr.runs_of([text])[0]]
    assert (1, 5 * len(root), len(root)) in got
    assert sum(r[2] == 7 for r in got) == 5 and sum(r[2] == 1 and r[1] == 200 for r in got) == 5
    assert [tuple(r) for r in pr.runs_of([[b"w"] * 100_000])[0]] == [(0, 100_000, 1)]


def plain_digest(doc_id: int | None, text: str | None) -> tuple:
    """The contract's row, read word by word."""
    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0:
            a = (h // 10) % n
            p = 1 + (n - a) // (3 + (h // 10) % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    dropped = {k for s, length, p in runs for k in range(s + p, s + length)}
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None, None, None))
    milli = 1000 * best[1] // best[2] if runs else None
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(runs), *best, milli, sha("".join(f"{s},{length},{p}\n" for s, length, p in runs)), sha(" ".join(w for k, w in enumerate(words) if k not in dropped)))


def test_digests_equal_the_plain_rows(spark, odd_docs, odd_rows):
    rng = random.Random(9)
    rows = [(k, rng.choice([" ", "  ", "\n", "\x0b"]).join(w.decode() for w in repetitive(rng)) + rng.choice(["", " ", "\x1c", " "])) for k in range(400)]
    rows += [(400, None), (401, ""), (None, "a " * 20), (402, "b " * 20), (402, "b " * 20)]
    got = pr.run_digests(spark.createDataFrame(rows, "doc_id long, text string"), edit=pr.with_repeats)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(repr(plain_digest(*r)) for r in rows)
    short = [r for r in odd_rows if len(r[1] or "") < 10_000]
    odd = pr.run_digests(odd_docs.where("coalesce(length(text), 0) < 10000"), edit=pr.with_repeats)
    assert sorted(map(repr, map(tuple, odd.collect()))) == sorted(repr(plain_digest(i, t)) for i, t, *_ in short)
    assert pr.run_digests(odd_docs).count() == len(odd_rows)
    assert pr.run_digests(odd_docs.limit(0)).count() == 0 and pr.text_runs(odd_docs.limit(0)).count() == 0


def test_texts_without_their_repeats(spark, odd_docs):
    rows = spark.createDataFrame([(1, "x a b a b a b a b y", "k"), (2, "no  repeat\there", "k"), (3, None, None)], "doc_id long, text string, words string")
    assert {r.doc_id: r.text for r in pr.without_repeats(rows).collect()} == {1: "x a b y", 2: "no  repeat\there", 3: None}
    assert [tuple(r) for r in pr.text_runs(rows).collect()] == [(1, 1, 8, 2)]
    cut = pr.without_repeats(odd_docs)
    rest = [c for c in odd_docs.columns if c != "text"]
    assert cut.schema == odd_docs.schema
    assert sorted(map(repr, cut.select(*rest).collect())) == sorted(map(repr, odd_docs.select(*rest).collect()))
