"""Token operators against the libraries."""

from __future__ import annotations

import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from fenland.llm.piece_tokens import PieceTable, digest_documents, encode_documents
from fenland.llm.token_counts import PrefixCounts, count_documents, prefix_counts

PIECES = public_tokenizers.path("piece_bpe_32k.model")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
PARTS = ["a", "b", "th", "ing", " ", "  ", "\n", "\t", "é", "ß", "▁", "<s>", "</s>", "<0x41>", "日本", "\U0001d4b3", "́", "00", "...", "//", "\x00", "�", "'s", "'re", "'ve", "　", "\xa0", "\r", "==", "<|endoftext|>", "<|endo", "\x1c", "\x85", "!!"]


def random_texts(seed: int, n: int, most: int) -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, most))) for _ in range(n)]


@pytest.fixture(scope="module")
def pieces():
    return PieceTable.load(PIECES), sentencepiece.SentencePieceProcessor(model_file=PIECES)


@pytest.fixture(scope="module")
def counts():
    return PrefixCounts.load(BYTES), Tokenizer.from_file(BYTES)


def test_piece_ids_and_text_equal_the_library(pieces):
    own, library = pieces
    for text in [*random_texts(1, 2000, 30), *(" " * k + "a" + " " * k for k in range(40)), "a" * 400]:
        ids = library.encode(text)
        assert own.encode(text) == ids, text
        assert own.decode([*ids, own.end]) == library.decode([*ids, own.end]), text


def test_decode_of_ids_out_of_order(pieces):
    own, library = pieces
    rng = random.Random(2)
    for _ in range(500):
        ids = [rng.choice([rng.randrange(3, 259), rng.randrange(259, 32_000), 0, 1, 2]) for _ in range(rng.randint(0, 12))]
        assert own.decode(ids) == library.decode(ids), ids


def test_counts_at_every_prefix_equal_the_library(counts):
    own, library = counts
    for text in random_texts(3, 1500, 14):
        want = [len(library.encode(text[:k], add_special_tokens=False).ids) for k in range(len(text) + 1)]
        assert own.prefixes(text) == want, text
        assert own.count(text) == want[-1]
        for limit in (0, 1, 3, 7):
            assert own.fitting(text, limit) == max(k for k, n in enumerate(want) if n <= limit), (text, limit)


def test_the_short_word_pattern_equals_the_long_one(counts):
    from fenland.llm import token_counts

    every = [chr(c) for c in range(0x250)]
    rng = random.Random(6)
    for text in [*("a" + c + "1" + c + c + " " + c for c in every), *("".join(rng.choice(every + [" ", "'", "s", "1"] * 40) for _ in range(60)) for _ in range(3000))]:
        assert token_counts._FAR.search(text) is None
        assert token_counts._NEAR.findall(text) == counts[0].pattern.findall(text), text


def test_neighbours_told_by_the_tree_equal_merging(pieces, counts):
    own, byte_table = pieces[0], counts[0]
    rng = random.Random(8)
    assert own.tree is not None and byte_table.tree is not None
    for _ in range(20_000):
        a, b = rng.choice(list_of(own)), rng.choice(list_of(own))
        left, right = own._text(a), own._text(b)
        assert own._compatible(a, b) == (own.merged(left + right) == [left, right])
        a, b = rng.choice(list_of(byte_table)), rng.choice(list_of(byte_table))
        left, right = byte_table.tokens[a], byte_table.tokens[b]
        assert byte_table._compatible(a, b) == (byte_table.merged(left + right) == [left, right])


def list_of(table, cache={}):  # noqa: B006
    return cache.setdefault(id(table), list(table.tree.rank))


def test_a_vocabulary_that_cuts_otherwise_is_refused(tmp_path):
    import json

    file = json.loads(open(BYTES, encoding="utf-8").read())
    for path, value in ((("pre_tokenizer", "add_prefix_space"), True), (("model", "ignore_merges"), True), (("model", "type"), "Unigram")):
        other = json.loads(json.dumps(file))
        other[path[0]][path[1]] = value
        (tmp_path / "v.json").write_text(json.dumps(other))
        with pytest.raises(ValueError, match="byte-level"):
            PrefixCounts.load(str(tmp_path / "v.json"))


def test_words_are_forgotten_beyond_the_bound():
    from fenland.llm.piece_tokens import Words

    words = Words(lambda new: list(map(len, new)), most_chars=100)
    for k in range(2000):
        words.meet([["often", str(k) * 5]])
        assert words["often"] == 5 and words[str(k) * 5] == len(str(k) * 5)
    assert sum(map(len, words)) <= 200 and len(words.old) <= 20
    assert words["x" * 1000] == 1000 and "x" * 1000 not in words


def test_words_encoded_together_equal_words_encoded_alone(pieces, counts):
    rng = random.Random(4)
    letters = "abcdefghijklmnopqrstuvwxyzABTéßñü0123.,-"
    words = list({"▁" * rng.randint(0, 3) + "".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(6000)} - {""})
    assert [tuple(x) for x in pieces[0]._encode_words(words)] == [pieces[0]._encode_word(w) for w in words]
    plain = [w.replace("▁", " ") + rng.choice(["", "日", "\x00"]) for w in words]
    assert counts[0]._totals_of(plain) == [counts[0]._byte_counts(w.encode())[-1] for w in plain]


def test_documents_with_odd_rows(spark, odd_docs, odd_rows, pieces, counts):
    want = sorted(
        (
            str(i),
            len(ids := [*pieces[1].encode(t or ""), 2]),
            hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
            hashlib.sha256(pieces[1].decode(ids).encode()).hexdigest(),
        )
        for i, t, *_ in odd_rows
    )
    got = digest_documents(odd_docs, PIECES).collect()
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == want
    lengths = [len(counts[1].encode(t or "", add_special_tokens=False).ids) for _, t, *_ in odd_rows]
    got = count_documents(odd_docs, BYTES, limit=30).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in got) == sorted(
        (str(i), len((t or "").encode()), n, n > 30) for (i, t, *_), n in zip(odd_rows, lengths, strict=True)
    )
    assert all(r.counts[0] == 0 for r in prefix_counts(odd_docs, BYTES).collect())


def test_no_rows(spark, odd_docs):
    none = odd_docs.limit(0)
    assert encode_documents(none, PIECES).count() == 0
    assert count_documents(none, BYTES).count() == 0
