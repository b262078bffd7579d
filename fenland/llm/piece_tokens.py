"""SentencePiece encoding and decoding by a prefix table of last tokens.

For every prefix of a word the table holds the one token the library's merges end it
with. Going one character on, the tokens that end there come from an automaton over
the vocabulary; the right one is the token that may stand behind the last token of
the prefix before it (the merges leave just those two apart, see `merge_tree`). The
ids are read from the table backwards.

A word is a stretch that no vocabulary entry crosses: the text is cut wherever two
neighbouring characters stand side by side in no entry. Words repeat, so each task
keeps a table of the words it has met, bounded by their characters: ids, ids as
text and decoded text of each, from which those of a document are joined.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from operator import itemgetter

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fenland.llm.merge_tree import SHIFT, MergeTree
from fenland.llm.prefix_batch import PrefixBatch, backwards, padded

SPACE = "▁"  # fixed value: the library's mark for a space
MOST_CHARS = 2_000_000  # characters of the words in one generation of those remembered in a task
ROWS_OUT = 1000  # documents in one frame of results
MOST_PAIRS = 500_000  # neighbours remembered in one task
LONGEST_REMEMBERED = 64  # characters; longer words are encoded each time
BATCH_WORDS = 4096  # words in one table
FAR = "\u0250"  # letters from here on are rare


class Words(dict):
    """word -> what `make(words)` gives for it, remembered up to a number of characters of all words.

    Two generations: when the young one is full it becomes the old one, and words met again move back, so
    frequent words stay and rare ones go.
    """

    def __init__(self, make: Callable[[list[str]], list], most_chars: int = MOST_CHARS):
        super().__init__()
        self.make, self.most, self.chars, self.old = make, most_chars, 0, {}

    def __missing__(self, word: str):
        found = self.old.get(word)
        if found is None:
            (found,) = self.make([word])
        self._keep(word, found)
        return found

    def _keep(self, word: str, found) -> None:
        if len(word) <= LONGEST_REMEMBERED:
            self[word] = found
            self.chars += len(word) + 8

    def meet(self, texts: list[list[str]]) -> None:
        """Take in the words of several texts at once; room is made before, never while they are looked up."""
        if self.chars >= self.most:
            self.old, self.chars = dict(self), 0
            self.clear()
        fresh = [w for w in set().union(*texts) if w not in self and w not in self.old and len(w) <= LONGEST_REMEMBERED]
        for word, found in zip(fresh, self.make(fresh) if fresh else [], strict=True):
            self._keep(word, found)


def in_groups(texts: Iterable[str], chars: int = 500_000) -> Iterator[list[str]]:
    """The texts in groups of about so many characters."""
    held, size = [], 0
    for text in texts:
        held.append(text)
        size += len(text)
        if size >= chars:
            yield held
            held, size = [], 0
    if held:
        yield held


class PieceTable:
    """Encoder for one vocabulary: a list of (piece, score, kind) in id order.

    kind is `normal`, `byte` or another name; only normal pieces take part in merges.
    """

    def __init__(self, pieces: list[tuple[str, float, str]], unknown: int, end: int):
        self.unknown, self.end = unknown, end
        self.pieces = pieces
        self.score = {p: s for p, s, kind in pieces if kind == "normal"}
        self.id_of = {p: i for i, (p, _, kind) in enumerate(pieces) if kind == "normal"}
        self.byte_id = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(pieces) if kind == "byte"}
        self.tree = self._grown()
        self.automaton = ahocorasick.Automaton()
        for piece, i in self.id_of.items():
            # others are never a result
            if i in self.tree.rank if self.tree else len(piece) == 1 or self.merged(piece) == [piece]:
                self.automaton.add_word(piece, (i, len(piece)))
        self.automaton.make_automaton()
        self.known = frozenset(p for p in self.id_of if len(p) == 1)
        self.names = [str(i) for i in range(len(pieces))]
        joined = sorted({p[k : k + 2] for p in self.id_of for k in range(len(p) - 1)})
        self.cuts = self._cutter(joined)
        self.fits: dict[int, bool] = {}
        self.encoded = Words(self._encoded)
        self.round_trips = Words(self._round_trips)
        # words of common letters are encoded together; others, and long ones, one by one
        self.symbol = {c: k for k, c in enumerate(sorted(c for c in self.known if c < FAR or c == SPACE))}
        common = [(list(map(self.symbol.get, p)), i) for p, i in self.id_of.items() if self.symbol.keys() >= set(p) and self.automaton.exists(p)]
        self.batch = PrefixBatch(common, len(self.symbol), self._apart)
        self.letters = frozenset(self.symbol)
        self.code_symbols = np.zeros(max(map(ord, self.symbol), default=0) + 1, np.int32)
        for c, k in self.symbol.items():
            self.code_symbols[ord(c)] = k

    @staticmethod
    def load(model_path: str) -> PieceTable:
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(model_path, "rb") as f:
            model.ParseFromString(f.read())
        spec, norm = model.trainer_spec, model.normalizer_spec
        plain = norm.name == "identity" and norm.add_dummy_prefix and not norm.remove_extra_whitespaces
        if spec.model_type != 2 or not plain or not norm.escape_whitespaces:
            raise ValueError("only merge-type models without text normalisation are supported")
        names = {1: "normal", 6: "byte"}
        pieces = [(p.piece, p.score, names.get(p.type, "other")) for p in model.pieces]
        return PieceTable(pieces, spec.unk_id, spec.eos_id)

    @staticmethod
    def _cutter(joined: list[str]) -> re.Pattern:
        """Pattern of words: runs in which each next character may follow the one before."""
        after: dict[str, list[str]] = {}
        for pair in joined:
            after.setdefault(pair[0], []).append(pair[1])
        # characters outside every pair stand alone; the rest is cut at spaces, which lead words
        inner = {c for first, seconds in after.items() for c in (first, *seconds)} - {SPACE}
        some = "".join(map(re.escape, sorted(inner)))
        return re.compile(f"{SPACE}*[{some}]+|{SPACE}+|.", re.DOTALL)

    def _grown(self) -> MergeTree | None:
        """The entries in the order of their scores; none where an entry has a part of a later rank or scores are shared.

        Only runs of marks may share a score, the last one: nothing but another mark asks which of them is first, and
        neighbours that meet in marks are tried by merging them.
        """
        tree = MergeTree()
        long = sorted((p for p in self.id_of if len(p) > 1), key=lambda p: (-self.score[p], len(p)))
        alone = [p for p in long if p.strip(SPACE)]
        marks = [p for p in long if not p.strip(SPACE)]
        if len({self.score[p] for p in alone}) < len(alone) or (marks and alone and max(map(self.score.get, marks)) >= self.score[alone[-1]]):
            return None
        for p, i in self.id_of.items():
            if len(p) == 1:
                tree.symbol(i)
        for rank, p in enumerate(long):
            parts = ((self.id_of.get(p[:k]), self.id_of.get(p[k:])) for k in range(1, len(p)))
            grown = any(a is not None and b is not None and tree.add(self.id_of[p], a, b, rank) for a, b in parts)
            if (not grown or not p.strip(SPACE)) and grown != (self.merged(p) == [p]):
                return None
        return tree

    def merged(self, text: str) -> list[str]:
        """The merges as defined, for short strings: best score first, then leftmost."""
        parts = list(text)
        while len(parts) > 1:
            best = max(
                ((self.score.get(parts[k] + parts[k + 1], float("-inf")), -k) for k in range(len(parts) - 1)),
            )
            if best[0] == float("-inf"):
                break
            k = -best[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def _compatible(self, left: int, right: int) -> bool:
        if len(self.fits) > MOST_PAIRS:
            self.fits.clear()
        known = self.fits[left << SHIFT | right] = self._apart(left, right)
        return known

    def _apart(self, left: int, right: int) -> bool:
        a, b = self._text(left), self._text(right)
        if self.tree is None or (a[-1] == b[0] == SPACE):
            return self.merged(a + b) == [a, b]
        return self.tree.apart(left, right)

    def _text(self, token: int) -> str:
        """Ids beyond the vocabulary stand for characters that no entry holds."""
        return self.pieces[token][0] if token < len(self.pieces) else chr(token - len(self.pieces))

    def _encode_word(self, word: str) -> tuple[int, ...]:
        size, fits = len(word), self.fits
        token, length = [0] * (size + 1), [0] * (size + 1)
        found = self.automaton.iter(word) if self.known.issuperset(word) else self._endings(word)
        for at, (new, long) in found:  # of those with one end, the longest comes first
            end = at + 1
            if length[end]:
                continue
            start = end - long
            if start:
                fit = fits.get(token[start] << SHIFT | new)
                if fit is None:
                    fit = self._compatible(token[start], new)
                if not fit:
                    continue
            token[end], length[end] = new, long
        out: list[int] = []
        at, entries = size, len(self.pieces)
        while at:
            if token[at] < entries:
                out.append(token[at])
            else:  # a character outside the vocabulary: its bytes
                out += [self.byte_id.get(b, self.unknown) for b in reversed(word[at - 1].encode())]
            at -= length[at]
        out.reverse()
        return tuple(out)

    def _encode_words(self, words: list[str]) -> list[tuple[int, ...] | list[int]]:
        out: list = [None] * len(words)
        together = [k for k, w in enumerate(words) if len(w) <= LONGEST_REMEMBERED and self.letters.issuperset(w)] if len(words) > 16 else []
        together.sort(key=lambda k: len(words[k]))  # words of like sizes share a table
        for a in range(0, len(together), BATCH_WORDS):
            part = together[a : a + BATCH_WORDS]
            own = [words[k] for k in part]
            sizes = np.fromiter(map(len, own), np.int64, len(own))
            flat = self.code_symbols[np.frombuffer("".join(own).encode("utf-32-le"), np.uint32)]
            codes = padded(flat, sizes, len(self.symbol))
            for k, ids in zip(part, backwards(*self.batch.fill(codes, sizes), sizes), strict=True):
                out[k] = ids
        return [self._encode_word(w) if ids is None else ids for w, ids in zip(words, out, strict=True)]

    def _endings(self, word: str):
        """As the automaton gives them, and characters without entry as ids beyond the vocabulary."""
        at, entries = 0, len(self.pieces)
        for end, found in (*self.automaton.iter(word), (len(word), None)):
            while at < min(end + 1, len(word)):
                if word[at] not in self.known:
                    yield at, (entries + ord(word[at]), 1)
                at += 1
            if found:
                yield end, found

    def encode(self, text: str) -> list[int]:
        """Ids as the library gives them, without begin and end ids; an empty text has none."""
        if not text:
            return []
        ((ids, _),) = self.encode_all([text])
        return ids[:-1].tolist()

    def encode_all(self, texts: Iterable[str]) -> Iterator[tuple[np.ndarray, str]]:
        """Of each text its ids with the end id, and their decoded text."""
        end = np.int32(self.end).tobytes()
        for group in in_groups(texts):
            cuts = [self._cut(text) if text else [] for text in group]
            self.encoded.meet(cuts)
            for words in cuts:
                parts = list(map(self.encoded.__getitem__, words))
                raw = b"".join(map(itemgetter(0), parts)) + end
                yield np.frombuffer(raw, np.int32), self._without_first("".join(map(itemgetter(1), parts)))

    def _encoded(self, words: list[str]) -> list[tuple[bytes, str]]:
        """The ids as 32-bit numbers, and what they decode to inside a text."""
        return [(np.array(ids, np.int32).tobytes(), self._decoded(w, ids)) for w, ids in zip(words, self._encode_words(words), strict=True)]

    def _decoded(self, word: str, ids: list[int] | tuple[int, ...]) -> str:
        # an encoded character's bytes stand together, so words decode one by one, those of known characters to themselves
        return word.replace(SPACE, " ") if self.known.issuperset(word) else self.decode(ids, inside=True)

    @staticmethod
    def _without_first(decoded: str) -> str:
        """Only the mark of a text's first piece is dropped."""
        return decoded[1:] if decoded[:1] == " " else decoded

    def _cut(self, text: str) -> list[str]:
        return self.cuts.findall(SPACE + text.replace(" ", SPACE))

    def _round_trips(self, words: list[str]) -> list[tuple[int, str, str]]:
        """Number of ids, the ids as text, and what they decode to inside a text."""
        names = self.names
        return [(len(ids), " ".join([names[i] for i in ids]), self._decoded(w, ids)) for w, ids in zip(words, self._encode_words(words), strict=True)]

    def round_trip(self, texts: Iterable[str]) -> Iterator[tuple[int, str, str]]:
        """Of each text the number of ids with the end id, the ids joined by one space, and their decoded text."""
        for group in in_groups(texts):
            cuts = [self._cut(text) if text else [] for text in group]
            self.round_trips.meet(cuts)
            yield from map(self._joined, cuts)

    def _joined(self, words: list[str]) -> tuple[int, str, str]:
        if not words:
            return 1, str(self.end), self.decode([self.end])
        parts = list(map(self.round_trips.__getitem__, words))
        joined = " ".join(map(itemgetter(1), parts))
        return sum(map(itemgetter(0), parts)) + 1, f"{joined} {self.end}", self._without_first("".join(map(itemgetter(2), parts)))

    def decode(self, ids: list[int] | tuple[int, ...], inside: bool = False) -> str:
        """The library's text of the ids: bytes joined, marks turned to spaces, a space before the first piece dropped.

        `inside`: other ids stand before them, so no space is dropped.
        """
        parts, raw, first = [], bytearray(), not inside
        for i in ids:
            piece, _, kind = self.pieces[i]
            if kind == "byte":
                raw.append(int(piece[3:5], 16))
                first = False
                continue
            if raw:
                parts.append(_as_text(raw))
                raw = bytearray()
            if kind == "normal":
                parts.append((piece[1:] if first and piece[0] == SPACE else piece).replace(SPACE, " "))
                first = False
            elif i == self.unknown:
                parts.append(" ⁇ ")
                first = False
        if raw:
            parts.append(_as_text(raw))
        return "".join(parts)


def _as_text(raw: bytearray) -> str:
    """UTF-8 with one replacement mark for every byte that is not part of a character."""
    out, rest = [], bytes(raw)
    while rest:
        try:
            out.append(rest.decode())
            break
        except UnicodeDecodeError as error:
            out.append(rest[: error.start].decode() + "�")
            rest = rest[error.start + 1 :]
    return "".join(out)


_TABLES: dict[str, PieceTable] = {}


def table_of(model_path: str) -> PieceTable:
    """One table per Python worker and model."""
    if model_path not in _TABLES:
        _TABLES[model_path] = PieceTable.load(model_path)
    return _TABLES[model_path]


def encode_documents(docs: DataFrame, model_path: str, text_column: str = "text", id_column: str = "doc_id") -> DataFrame:
    """doc_id, ids (with one end id), decoded text of every row.

    A null text counts as empty: its ids are the end id alone and its decoded text is
    empty. Only the two named columns are read; repeated rows give repeated rows.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = table_of(model_path)
        for pdf in batches:
            for a in range(0, len(pdf), ROWS_OUT):
                part = pdf.iloc[a : a + ROWS_OUT]
                found = list(table.encode_all(t or "" for t in part["text"]))
                ids = pd.Series([x for x, _ in found], dtype=object, index=part.index)
                yield pd.DataFrame({"doc_id": part["doc_id"].astype("Int64"), "ids": ids, "decoded": [x for _, x in found]})

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    return rows.mapInPandas(run, "doc_id long, ids array<int>, decoded string")


def digest_documents(docs: DataFrame, model_path: str, text_column: str = "text", id_column: str = "doc_id") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: the same, with digests instead of ids and text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = table_of(model_path)
        for pdf in batches:
            rows = []
            for n, joined, decoded in table.round_trip(t or "" for t in pdf["text"]):
                rows.append((n, hashlib.sha256(joined.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
            out = pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])
            out.insert(0, "doc_id", pdf["doc_id"].astype("Int64"))
            yield out

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    return rows.mapInPandas(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
