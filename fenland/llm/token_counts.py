"""Exact token counts at every prefix of a text for a byte-level merge vocabulary.

Texts are cut into words by the vocabulary's own pattern. Inside a word, the entry that
ends a prefix is found from the entry that ends the shorter prefix before it (two
neighbours must be ones that the merges leave apart), so the count at a prefix is the
count at the shorter one plus one. The counts at all prefixes of a word are kept;
the count of a text, of any of its prefixes, and the longest prefix within a
budget follow by addition and search, without encoding again.
"""

from __future__ import annotations

import bisect
import json
import re
from collections.abc import Iterable, Iterator
from itertools import accumulate

import ahocorasick
import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fenland.llm.merge_tree import SHIFT, MergeTree
from fenland.llm.piece_tokens import BATCH_WORDS, LONGEST_REMEMBERED, Words, in_groups
from fenland.llm.prefix_batch import PrefixBatch, padded

# fixed value: the pattern that cuts text into words before the merges
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# the same pattern for texts of code points below U+0250, whose letters, numbers and blanks are few enough to be
# written out; the standard engine then cuts a text in less than half the time
_LETTERS, _NUMBERS, _BLANKS = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼½¾", r"\t\n\x0b\x0c\r \x85\xa0"
_NEAR = re.compile(rf"'(?:[stmd]|re|ve|ll)| ?[{_LETTERS}]+| ?[{_NUMBERS}]+| ?[^{_BLANKS}{_LETTERS}{_NUMBERS}]+|[{_BLANKS}]+(?![^{_BLANKS}])|[{_BLANKS}]+")
_FAR = re.compile("[\u0250-\U0010ffff]")
MOST_CHARS = 4_000_000  # characters of the words in one generation of those remembered in a task
MOST_PAIRS = 2_000_000  # neighbours remembered in one task


def byte_marks() -> dict[str, int]:
    """The printable characters that stand for the 256 bytes in the vocabulary file."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class PrefixCounts:
    def __init__(self, tokens: list[bytes], merges: list[tuple[bytes, bytes]], specials: list[str]):
        self.rank = {pair: k for k, pair in enumerate(merges)}
        self.tokens = tokens
        self.tree = self._grown(merges)
        self.automaton = ahocorasick.Automaton()
        for k, token in enumerate(tokens):
            # others are never a result
            if k in self.tree.rank if self.tree else len(token) == 1 or self.merged(token) == [token]:
                self.automaton.add_word(token.decode("latin-1"), (k, len(token)))
        self.automaton.make_automaton()
        self.fits: dict[int, bool] = {}
        self.words = Words(lambda words: list(map(self._word_counts, words)), MOST_CHARS // 2)
        self.totals = Words(self._totals_of, MOST_CHARS)
        result = [(list(t), k) for k, t in enumerate(tokens) if self.automaton.exists(t.decode("latin-1"))]
        self.batch = PrefixBatch(result, 256, self._compatible)
        self.specials = specials
        self.pattern = regex.compile(PATTERN)
        self.special = regex.compile("|".join(map(regex.escape, sorted(specials, key=len, reverse=True)))) if specials else None

    def _grown(self, merges: list[tuple[bytes, bytes]]) -> MergeTree | None:
        """The entries in the order of their merges; none where an entry has a part of a later rank."""
        tree, number = MergeTree(), {token: k for k, token in enumerate(self.tokens)}
        for token, k in number.items():
            if len(token) == 1:
                tree.symbol(k)
        for rank, (a, b) in enumerate(merges):
            entry = number.get(a + b)
            if entry is None or a not in number or b not in number:
                return None
            if not tree.add(entry, number[a], number[b], rank) and (entry in tree.rank or self.merged(a + b) == [a + b]):
                return None
        return tree

    @staticmethod
    def load(path: str) -> PrefixCounts:
        """Read a vocabulary file; raises for one that cuts or merges in another way than this class does."""
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model, cutter = file["model"], file["pre_tokenizer"] or {}
        plain = model["type"] == "BPE" and not any(
            model.get(x) for x in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges")
        )
        by_bytes = cutter.get("type") == "ByteLevel" and not cutter.get("add_prefix_space") and cutter.get("use_regex", True)
        bare = not any(x[flag] for x in file["added_tokens"] for flag in ("single_word", "lstrip", "rstrip", "normalized"))
        if not (plain and by_bytes and bare) or file["normalizer"]:
            raise ValueError("only byte-level merge vocabularies with the plain word pattern are supported")
        marks = byte_marks()
        own = lambda text: bytes(marks[c] for c in text)
        special = [x["content"] for x in file["added_tokens"]]
        tokens = [own(t) for t in file["model"]["vocab"] if t not in special]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in file["model"]["merges"]]
        return PrefixCounts(tokens, [(own(a), own(b)) for a, b in pairs], special)

    def merged(self, word: bytes) -> list[bytes]:
        """The merges as defined, for short strings: lowest rank first, then leftmost."""
        parts = [word[k : k + 1] for k in range(len(word))]
        while len(parts) > 1:
            rank, k = min((self.rank.get((parts[k], parts[k + 1]), 1 << 30), k) for k in range(len(parts) - 1))
            if rank == 1 << 30:
                break
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def _compatible(self, left: int, right: int) -> bool:
        if len(self.fits) > MOST_PAIRS:
            self.fits.clear()
        if self.tree is None:
            a, b = self.tokens[left], self.tokens[right]
            known = self.merged(a + b) == [a, b]
        else:
            known = self.tree.apart(left, right)
        self.fits[left << SHIFT | right] = known
        return known

    def _byte_counts(self, raw: bytes) -> list[int]:
        """Tokens of every prefix of a word's bytes."""
        size, fits = len(raw), self.fits
        token, count = [0] * (size + 1), [0] * (size + 1)
        for at, (new, long) in self.automaton.iter(raw.decode("latin-1")):  # longest first at each end
            end = at + 1
            if count[end]:
                continue
            start = end - long
            if start:
                fit = fits.get(token[start] << SHIFT | new)
                if fit is None:
                    fit = self._compatible(token[start], new)
                if not fit:
                    continue
            token[end], count[end] = new, count[start] + 1
        return count

    def word_counts(self, word: str) -> bytes | list[int]:
        """Tokens of every prefix of a word, by code points, the empty prefix included."""
        return self.words[word]

    def _word_counts(self, word: str) -> bytes | list[int]:
        raw = word.encode()
        known = self._byte_counts(raw)
        if len(raw) != len(word):
            ends = [0, *accumulate(len(c.encode()) for c in word)]
            known = [known[k] for k in ends]
        return bytes(known) if len(word) <= LONGEST_REMEMBERED and max(known) < 256 else known

    def _totals_of(self, words: list[str]) -> list[int]:
        raws = [w.encode() for w in words]
        out = [0] * len(raws)
        together = [k for k, raw in enumerate(raws) if 0 < len(raw) <= LONGEST_REMEMBERED] if len(raws) > 16 else []
        together.sort(key=lambda k: len(raws[k]))  # words of like sizes share a table
        for a in range(0, len(together), BATCH_WORDS):
            part = together[a : a + BATCH_WORDS]
            own = [raws[k] for k in part]
            sizes = np.fromiter(map(len, own), np.int64, len(own))
            codes = padded(np.frombuffer(b"".join(own), np.uint8), sizes, 256)
            _, length = self.batch.fill(codes, sizes)
            count = np.zeros(length.shape, np.int64)
            rows = np.arange(len(part))
            for end in range(1, length.shape[1]):
                count[:, end] = count[rows, end - length[:, end]] + 1
            for k, n in zip(part, count[rows, sizes].tolist(), strict=True):
                out[k] = n
        return [n or self._byte_counts(raw)[-1] for n, raw in zip(out, raws, strict=True)]

    def cut(self, text: str) -> list[str]:
        """Words of a text without special strings."""
        return (self.pattern if _FAR.search(text) else _NEAR).findall(text)

    def _pieces(self, text: str) -> list[tuple[str, bool]]:
        """Stretches between special strings, and the special strings themselves."""
        if not self._special_in(text):
            return [(text, False)]
        out, at = [], 0
        for m in self.special.finditer(text):
            out += [(text[at : m.start()], False), (m[0], True)]
            at = m.end()
        return [*out, (text[at:], False)]

    def _words(self, text: str) -> list[tuple[str, bool]]:
        return [(w, special) for piece, special in self._pieces(text) for w in ([piece] if special else self.cut(piece))]

    def count(self, text: str) -> int:
        """Tokens of a text, special strings as one token each."""
        return sum(self._totals(self._words(text)))

    def _totals(self, words: list[tuple[str, bool]]) -> list[int]:
        known = self.totals
        return [1 if special else known[word] for word, special in words]

    def _inside(self, words: list[tuple[str, bool]], k: int, base: list[int]) -> list[int]:
        """Tokens of the text up to each prefix of word k, where base[k] counts the words before.

        A cut text is split by the pattern afresh: blanks at its end stay in one
        word, a cut contraction or special string is plain text.
        """
        word, special = words[k]
        if special:
            back = k
            while back and not words[back - 1][1] and back > k - 3:
                back -= 1
            head = "".join(w for w, _ in words[back:k])
            return [base[back] + (self.count(head + word[:j]) if j < len(word) else self.count(head) + 1) for j in range(len(word) + 1)]
        counts = [base[k] + n for n in self.word_counts(word)]
        before = words[k - 1] if k else ("", True)
        if not before[1] and before[0].isspace() and word[0].isspace():
            counts[1] = base[k - 1] + self.word_counts(before[0] + word[0])[-1]
        if len(word) == 3 and word[0] == "'" and word[1:] in ("re", "ve", "ll"):
            counts[2] = base[k] + self.word_counts("'")[-1] + self.word_counts(word[1])[-1]
        return counts

    def prefixes(self, text: str) -> list[int]:
        """Tokens of text[:0], text[:1], ..., text."""
        words = self._words(text)
        base = [0, *accumulate(1 if special else self.word_counts(w)[-1] for w, special in words)]
        out = [0]
        for k in range(len(words)):
            out += self._inside(words, k, base)[1:]
        return out

    def fitting(self, text: str, limit: int) -> int:
        """Code points of the longest prefix of at most `limit` tokens."""
        return self.count_and_fit(text, limit)[1]

    def count_and_fit(self, text: str, limit: int) -> tuple[int, int]:
        """Tokens of a text, and code points of its longest prefix of at most `limit` tokens; the text is cut once."""
        ((total, fit),) = self.count_and_fit_all([text], limit)
        return total, fit

    def count_and_fit_all(self, texts: Iterable[str], limit: int) -> Iterator[tuple[int, int]]:
        """The same for many texts, whose new words are counted together."""
        for group in in_groups(texts):
            plain = [None if self._special_in(text) else self.cut(text) for text in group]
            self.totals.meet([words for words in plain if words is not None])
            for text, own in zip(group, plain, strict=True):
                words = self._words(text) if own is None else own
                total = sum(self._totals(words)) if own is None else sum(map(self.totals.__getitem__, own))
                if total <= limit:
                    yield total, len(text)
                else:
                    if own is not None:
                        # a word has a token at least, so the first limit + 1 reach the limit; one more stands behind
                        ends = accumulate(map(self.totals.__getitem__, own[: limit + 2]))
                        words = [(w, False) for w in own[: next(k for k, n in enumerate(ends) if n > limit) + 3]]
                    yield total, self._fit(words, limit)

    def _special_in(self, text: str) -> bool:
        return self.special is not None and any(s in text for s in self.specials)

    def _fit(self, words: list[tuple[str, bool]], limit: int) -> int:
        base = list(accumulate(self._totals(words), initial=0))
        k = bisect.bisect_right(base, limit) - 1  # words before k fit, word k does not
        start = sum([len(w) for w, _ in words[:k]])
        best = start
        for word in (k, k + 1):  # blanks before the next word may close up
            if word < len(words):
                good = [j for j, n in enumerate(self._inside(words, word, base)) if j and n <= limit]
                if good:
                    best = max(best, start + good[-1])
                start += len(words[word][0])
        return best


_TABLES: dict[str, PrefixCounts] = {}


def table_of(path: str) -> PrefixCounts:
    """One table per Python worker and vocabulary."""
    if path not in _TABLES:
        _TABLES[path] = PrefixCounts.load(path)
    return _TABLES[path]


def count_documents(docs: DataFrame, path: str, limit: int = 512, text_column: str = "text", id_column: str = "doc_id") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, fit_chars of every row.

    fit_chars is the length in code points of the longest prefix within the limit. A null text
    counts as empty (no bytes, no tokens). Only the two named columns are read;
    repeated rows give repeated rows.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = table_of(path)
        for pdf in batches:
            texts = [t or "" for t in pdf["text"]]
            counts, fits = zip(*table.count_and_fit_all(texts, limit), strict=True) if texts else ((), ())
            yield pd.DataFrame(
                {
                    "doc_id": pdf["doc_id"].astype("Int64"),
                    "n_bytes": [len(t.encode()) for t in texts],
                    "n_tokens": counts,
                    "over_limit": [n > limit for n in counts],
                    "fit_chars": fits,
                }
            )

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    return rows.mapInPandas(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, fit_chars long")


def prefix_counts(docs: DataFrame, path: str, text_column: str = "text", id_column: str = "doc_id") -> DataFrame:
    """doc_id, counts: the whole table of each text, one number per prefix (the empty one first)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = table_of(path)
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "counts": [table.prefixes(t or "") for t in pdf["text"]]})

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    return rows.mapInPandas(run, "doc_id long, counts array<int>")
