"""Pair operators and decontamination against brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest

from fenland.llm import decontamination, jaccard_join, vector_dedup
from fenland.llm.common import components
from llm_brute import groups, sets_of


def test_components_of_chains_and_stars(spark):
    rng = random.Random(1)
    chain = list(range(100, 160))
    rng.shuffle(chain)
    edges = [*zip(chain, chain[1:], strict=False), *((1, k) for k in range(2, 40)), (50, 50), (7, 60), (61, 60)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {**{k: 100 for k in chain}, **{k: 1 for k in range(1, 40)}, 60: 1, 61: 1}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def near_texts(seed: int, n: int) -> list[str]:
    """Bases of several lengths with copies, some words of which are changed."""
    rng = random.Random(seed)
    word = lambda: rng.choice("alpha beta gamma delta eps zeta eta theta iota kappa".split()) + str(rng.randrange(60))
    bases = [[word() for _ in range(rng.choice([1, 3, 5, 8, 40, 120]))] for _ in range(n // 6)]
    out = []
    for _ in range(n):
        words = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 6])):
            words[rng.randrange(len(words))] = word()
        out.append(rng.choice([" ", "  ", "\n"]).join(words))
    return out


@pytest.mark.parametrize("block", [8, 256])
def test_jaccard_join_is_the_exact_join(spark, block):
    texts = near_texts(3, 300)
    sets = [sets_of(t) for t in texts]
    links = [(a, b) for a in range(300) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9]
    counts = np.bincount(np.array(links).reshape(-1), minlength=300)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in jaccard_join.near_copies(docs, block=block).collect()}
    assert [got[k].n_links for k in range(300)] == counts.tolist()
    assert [got[k].class_id for k in range(300)] == groups(300, links)
    kept = {r.doc_id for r in jaccard_join.keep_one(docs).collect()}
    assert kept == set(groups(300, links))


def test_the_prefix_is_as_long_as_the_recall_allows():
    for trees in (8, 24, 64):
        depth = jaccard_join.depth_for(0.8, trees, 0.999)
        chance = lambda d: 1 - (1 - 0.8**d) ** trees  # noqa: E731, B023
        assert depth == 1 or chance(depth) >= 0.999
        assert depth == jaccard_join.MOST_DEPTH or chance(depth + 1) < 0.999


def test_minhash_agrees_with_jaccard():
    rng = np.random.default_rng(4)
    forest = jaccard_join.Forest(64, 8)
    universe = rng.integers(0, 2**63, 1000, dtype=np.uint64)
    a, b = universe[:900], universe[100:]
    same = (forest.signature(a) == forest.signature(b)).mean()
    assert abs(same - 0.8) < 0.06


def test_near_copies_of_odd_rows(odd_docs, odd_rows):
    got = jaccard_join.near_copies(odd_docs).collect()
    assert len(got) == len(odd_rows)
    by_id = {}
    for r in got:
        by_id.setdefault(r.doc_id, []).append(r)
    assert [r.n_links for r in by_id[1]] == [2, 2] and by_id[2][0].class_id == 1 and not by_id[2][0].kept
    assert all(r.n_links == 0 and r.kept and r.class_id is None for r in by_id[None])
    assert all(by_id[k][0].kept and by_id[k][0].n_links == 0 for k in (4, 5, 6, 7, 8, 9))
    kept = jaccard_join.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(["1", "3", "3", "None", "None", "4", "5", "6", "7", "8", "9"])
    assert jaccard_join.near_copies(odd_docs.limit(0)).count() == 0


@pytest.mark.parametrize("block", [16, 8192])
def test_vector_links_are_exact(spark, block):
    rng = np.random.default_rng(8)
    base = rng.standard_normal((40, 24))
    rows = np.concatenate([base[rng.integers(0, 40, 160)] + rng.standard_normal((160, 24)) * rng.choice([0, 0.05, 0.2, 0.24], (160, 1)), base])
    unit = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    close = unit @ unit.T >= 0.95
    links = [(a, b) for a in range(200) for b in range(a) if close[a, b]]
    counts = close.sum(axis=1) - 1
    table = [(k, [float(x) for x in v]) for k, v in enumerate(rows)]
    odd = [(200, None), (201, []), (202, [0.0] * 24), (203, [float("nan")] * 24), (204, [None] * 24), (205, [float("inf"), *[1.0] * 23]), (None, table[0][1]), (206, [1.0, 2.0])]
    vectors = spark.createDataFrame([(*r, "x") for r in table + odd], "vec_id long, embedding array<double>, key string")
    got = {r.vec_id: r for r in vector_dedup.near_duplicates(vectors, block=block).collect()}
    assert [got[k].n_links for k in range(200)] == counts.tolist()
    assert [got[k].component_id for k in range(200)] == groups(200, links)
    assert all(got[k].n_links == 0 and got[k].component_id == k and got[k].kept for k in range(200, 207))
    assert got[None].n_links == 0 and got[None].component_id is None
    assert vector_dedup.near_duplicates(vectors.limit(0)).count() == 0


def test_the_bound_holds_for_every_pair():
    rng = np.random.default_rng(9)
    unit = rng.standard_normal((200, 33)) * rng.lognormal(0, 2, (200, 33))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    q, scale, error = vector_dedup.quantised(unit)
    near = (q.astype(float) * scale[:, None]) @ (q.astype(float) * scale[:, None]).T
    worst = 1 + 2 * error.max()
    assert (np.abs(near - unit @ unit.T) <= worst * (error[:, None] + error[None, :]) + 1e-12).all()


def edits(item: str, text: str) -> int:
    """Fewest edits between the item and any stretch of the text, by the full table."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


def test_items_within_the_budget_are_found():
    rng = random.Random(10)
    for _ in range(400):
        item = "".join(rng.choice("abcd ") for _ in range(rng.randint(1, 40))).strip() or "a"
        copy = list(item)
        for _ in range(rng.randint(0, 5)):
            k = rng.randrange(len(copy) + 1)
            copy[k : k + rng.randint(0, 1)] = rng.choice(["", "x", "a"])
        text = "".join(rng.choice("abcdef ") for _ in range(rng.randint(0, 30))) + "".join(copy) + "".join(rng.choice("abcd") for _ in range(20))
        least, budget = edits(item, text), len(item) // 6
        assert decontamination.Pattern(item).least(text, -1) == least
        assert decontamination.Matcher([(1, item)], 6).found(text) == ({1: least} if least <= budget else {})


def test_documents_with_items(spark, odd_docs, odd_rows, odd_folder):
    item = "The quick brown fox jumps over the lazy dog, and then it rests in the shade for an hour."
    benchmark = spark.createDataFrame([(1, item), (1, item), (2, "short"), (3, None), (None, "x"), (4, "")], "item_id long, text string")
    docs = spark.createDataFrame(
        [(1, "before " + item.upper() + " after"), (2, item.replace("quick", "quikc").replace(" ", "\n  ")), (3, item[:40]), (4, "a short text"), (5, None), (6, "")],
        "doc_id long, text string",
    )
    got = {r.doc_id: (r.contaminated, r.item_ids, r.edits) for r in decontamination.contamination(docs, benchmark).collect()}
    assert got == {1: (True, [1], 0), 2: (True, [1], 2), 3: (False, [], None), 4: (True, [2], 0), 5: (False, [], None), 6: (False, [], None)}
    assert [r.doc_id for r in decontamination.decontaminate(docs, benchmark).orderBy("doc_id").collect()] == [3, 5, 6]
    odd = spark.read.parquet(f"{odd_folder}/benchmark.parquet")
    assert decontamination.decontaminate(odd_docs, odd).count() == len(odd_rows)
    assert decontamination.contamination(odd_docs, odd.limit(0)).where("contaminated").count() == 0
    assert decontamination.contamination(odd_docs.limit(0), odd).count() == 0


def test_blocks_of_items_give_the_same(spark, monkeypatch):
    docs, items = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "benchmark"))
    whole = sorted((r.doc_id, r.item_ids) for r in decontamination.contamination(docs, items).collect())
    monkeypatch.setattr(decontamination, "BLOCK_CHARS", 3000)
    assert sorted((r.doc_id, r.item_ids) for r in decontamination.contamination(docs, items).collect()) == whole
    assert any(ids for _, ids in whole)
