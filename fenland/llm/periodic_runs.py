"""Repeated stretches of words (runs) found through string synchronising sets.

A run is a stretch with smallest period q and a length of at least max(6, 4 q) that no
neighbouring word extends. Periods from `FIRST` up are found at dyadic scales: a period q
belongs to the scale t with t <= q < 2 t. At scale t a position is selected when the
hash of the t words there, or of the t words t places on, is the least of those from
here to there; so selection depends on the next 2 t words alone, and every t positions
in a row hold a selected one unless the words there have a period of t / 4 or less.
Such highly periodic stretches are known from the smaller scales (the smallest periods
from comparing the words with themselves shifted) and their positions are left out of the
selection. A run of 4 q words therefore holds a selected position among its first q, and
the one q words on is selected with the same 2 t words as context; nothing nearer has
them, so neighbours of one context propose the period. Proposals are extended word by word,
which makes the result exact. Many texts are searched as one array, with a word of its own behind each.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST_LENGTH, LEAST_POWER = 6, 4
FIRST = 4  # the first scale; smaller periods are compared directly
BATCH_WORDS = 1_000_000  # texts are searched in groups of about so many words
_K1, _K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_OUT = np.uint64(2**64 - 1)  # hash of positions that take no part


class Run(NamedTuple):
    start: int
    length: int
    period: int


def words_of(text: str | None) -> list[bytes]:
    """Stretches without the six ASCII blanks, in UTF-8."""
    return (text or "").encode().split()


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * _K1 + (b ^ (b >> np.uint64(29))) * _K2
    x ^= x >> np.uint64(32)
    return x


def _stretches(same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the longest stretches of true."""
    edges = np.flatnonzero(np.diff(np.concatenate(([False], same, [False])).astype(np.int8)))
    return edges[::2], edges[1::2]


def _small_periods(words: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, end, period) of stretches of LEAST_POWER periods for periods below FIRST."""
    found = []
    for p in range(1, FIRST):
        if len(words) < LEAST_POWER * p:
            break
        first, last = _stretches(words[:-p] == words[p:])
        long = last - first >= (LEAST_POWER - 1) * p
        for a, e in zip(first[long].tolist(), (last[long] + p).tolist(), strict=True):
            if p == 1 or (words[a + 1 : a + p] != words[a]).any():  # else period 1 has it
                found.append((a, e, p))
    return found


def _agree(a: np.ndarray, b: np.ndarray) -> int:
    """Number of equal words from the front, compared in growing pieces."""
    n, at, step = min(len(a), len(b)), 0, 64
    while at < n:
        differ = a[at : at + step] != b[at : min(at + step, n)] if at + step <= n else a[at:n] != b[at:n]
        if differ.any():
            return at + int(differ.argmax())
        at, step = min(at + step, n), step * 4
    return n


def _primitive(root: np.ndarray) -> bool:
    n = rest = len(root)
    f = 2
    while rest > 1:
        if rest % f == 0:
            g = n // f
            if (root[g:] == root[:-g]).all():
                return False
            while rest % f == 0:
                rest //= f
        f = f + 1 if f * f <= rest else max(rest, f + 1)
    return True


def _selected(hashes: np.ndarray, scale: int) -> np.ndarray:
    """Positions whose own hash, or the one `scale` on, is the least from here to there."""
    least, span = hashes, 1
    while span < scale:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    ahead = hashes[scale:]
    least = np.minimum(least[: len(ahead)], ahead)
    return np.flatnonzero((least != _OUT) & ((hashes[: len(ahead)] == least) | (ahead == least)))


def _proposed(positions: np.ndarray, contexts: np.ndarray, scale: int) -> tuple[list[int], list[int]]:
    """Place and distance of neighbours with one context, one of each chain that is surely one stretch."""
    order = np.argsort(contexts, kind="stable")
    here, there, equal = positions[order[:-1]], positions[order[1:]], contexts[order[:-1]] == contexts[order[1:]]
    apart = there - here
    good = equal & (apart >= scale) & (apart < 2 * scale)
    here, apart = here[good], apart[good]
    order = np.lexsort((here, apart))
    here, apart = here[order], apart[order]
    head = np.ones(len(here), dtype=bool)
    head[1:] = (apart[1:] != apart[:-1]) | (here[1:] > here[:-1] + 2 * scale)
    return here[head].tolist(), apart[head].tolist()


def periodic_stretches(words: np.ndarray, reach: Callable[[int], int]) -> list[tuple[int, int, int]]:
    """(start, end, period) of all maximal stretches of LEAST_POWER periods or more.

    `words` holds the numbers of the words; `reach(n)` is how much of it holds the texts of n words or more.
    """
    found = _small_periods(words)
    level, width = _mixed(words.astype(np.uint64), words.astype(np.uint64)), 1
    scale = FIRST
    while (n := reach(LEAST_POWER * scale)) >= LEAST_POWER * scale:
        part = words[:n]
        level = level[: n - width + 1]
        while width < scale:
            level = _mixed(level[:-width], level[width:])
            width *= 2
        context = _mixed(level[:-width], level[width:])
        hashes = level.copy()
        inside = np.zeros(n + 1, dtype=np.int32)
        for a, e, p in found:
            if p * 4 <= scale and e - a >= scale and a < n:
                inside[a] += 1
                inside[e - scale + 1] -= 1
        hashes[np.cumsum(inside)[: len(hashes)] > 0] = _OUT
        chosen = _selected(hashes, scale)
        seen = set()
        for s, d in zip(*_proposed(chosen, context[chosen], scale), strict=True):
            start = s - _agree(part[:s][::-1], part[: s + d][::-1])
            if (start, d) in seen:
                continue
            seen.add((start, d))
            end = s + _agree(part[s:], part[s + d :]) + d
            if end - start >= LEAST_POWER * d and _primitive(part[start : start + d]):
                found.append((start, end, d))
        level, width = context, 2 * width
        scale *= 2
    return found


def runs_of(texts: Sequence[Sequence[bytes]]) -> list[list[Run]]:
    """The runs of each text (a list of words) by start, then period."""
    out: list[list[Run]] = [[] for _ in texts]
    order = sorted(range(len(texts)), key=lambda k: -len(texts[k]))
    number: dict[bytes, int] = {}
    for t in texts:
        for w in t:
            number.setdefault(w, len(number))
    sizes = np.array([len(texts[k]) for k in order], dtype=np.int64)
    ends = np.cumsum(sizes + 1)  # one word more behind each text
    if not len(ends):
        return out
    words = np.empty(int(ends[-1]), dtype=np.int64)
    for place, k in enumerate(order):
        end = int(ends[place]) - 1
        words[end - len(texts[k]) : end] = np.fromiter(map(number.__getitem__, texts[k]), dtype=np.int64, count=len(texts[k]))
        words[end] = len(number) + place
    starts = ends - sizes - 1

    def reach(n: int) -> int:
        held = int(np.searchsorted(-sizes, -n, side="right"))
        return int(ends[held - 1]) if held else 0

    for a, e, p in periodic_stretches(words, reach):
        if e - a >= LEAST_LENGTH:
            place = int(np.searchsorted(starts, a, side="right")) - 1
            out[order[place]].append(Run(a - int(starts[place]), e - a, p))
    for runs in out:
        runs.sort(key=lambda r: (r.start, r.period))
    return out


def strongest(runs: Sequence[Run]) -> Run | None:
    """The run with the greatest length / period; ties go to the smallest start, then period."""
    best = None
    for r in runs:
        if best is None or r.length * best.period > best.length * r.period:
            best = r
    return best


def collapsed(words: Sequence[bytes], runs: Sequence[Run]) -> list[bytes]:
    """The words that no run holds after its first period."""
    if not runs:
        return list(words)
    keep = np.ones(len(words), dtype=bool)
    for r in runs:
        keep[r.start + r.period : r.start + r.length] = False
    return [words[k] for k in np.flatnonzero(keep)]


def with_repeats(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """Every tenth id (by crc32) repeats a stretch from some word to its end; a null id repeats nothing."""
    if doc_id is None or not words:
        return words
    g, rest = divmod(zlib.crc32(str(doc_id).encode()), 10)
    if rest:
        return words
    n = len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    root = words[a : a + p]
    return words[:a] + (root * (-(-(n - a) // p)))[: n - a]


def _searched(pdf: pd.DataFrame, edit: Callable[[list[bytes], int | None], list[bytes]] | None) -> Iterator[tuple[int | None, list[bytes], list[Run]]]:
    """(id, words, runs) of every row, searched in groups of bounded size."""
    held: list[tuple[int | None, list[bytes]]] = []
    size = 0
    ids = [None if pd.isna(i) else int(i) for i in pdf["doc_id"]]
    for k, (i, text) in enumerate(zip(ids, pdf["text"], strict=True)):
        words = words_of(text)
        if edit is not None:
            words = edit(words, i)
        held.append((i, words))
        size += len(words)
        if size >= BATCH_WORDS or k + 1 == len(ids):
            for (doc_id, found), runs in zip(held, runs_of([w for _, w in held]), strict=True):
                yield doc_id, found, runs
            held, size = [], 0


def _rows(docs: DataFrame, text_column: str, id_column: str) -> DataFrame:
    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))


def text_runs(docs: DataFrame, text_column: str = "text", id_column: str = "doc_id") -> DataFrame:
    """doc_id, start, length, period: one row per run, counted in words.

    Null and empty texts have none; repeated rows repeat theirs; only the two named columns are read.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(i, *r) for i, _, runs in _searched(pdf, None) for r in runs]
            yield pd.DataFrame(rows, columns=["doc_id", "start", "length", "period"]).astype({"doc_id": "Int64"})

    return _rows(docs, text_column, id_column).mapInPandas(run, "doc_id long, start long, length long, period long")


def without_repeats(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """The rows with each text that holds runs cut down to their first periods, its words joined by one space.

    Texts without runs, null ones too, stay as they are; so do all other columns.
    """

    @F.pandas_udf("string")
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            pdf = pd.DataFrame({"doc_id": None, "text": texts})
            yield pd.Series([b" ".join(collapsed(w, runs)).decode() if runs else t for t, (_, w, runs) in zip(texts, _searched(pdf, None), strict=True)], dtype=object)

    return docs.withColumn(text_column, cut(F.col(text_column).cast("string")))


def run_digests(docs: DataFrame, edit: Callable[[list[bytes], int | None], list[bytes]] | None = None, text_column: str = "text", id_column: str = "doc_id") -> DataFrame:
    """doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256 of every row.

    The four numbers are those of the strongest run, null without one; the digests are those of
    the lines `start,length,period` and of the collapsed words joined by one space. `edit`
    changes the words before the search. A null text counts as empty; repeated rows give repeated rows.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for i, words, runs in _searched(pdf, edit):
                best = strongest(runs)
                lines = "".join(f"{r.start},{r.length},{r.period}\n" for r in runs)
                found = (best.start, best.length, best.period, 1000 * best.length // best.period) if best else (None,) * 4
                rows.append((i, len(runs), *found, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(b" ".join(collapsed(words, runs))).hexdigest()))
            names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
            yield pd.DataFrame(rows, columns=names).astype(dict.fromkeys(["doc_id", *names[2:6]], "Int64"))

    schema = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
    return _rows(docs, text_column, id_column).mapInPandas(run, schema)
