"""The manifest against a plain tree over all leaves in memory, witnesses, appends, odd rows."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from fenland.llm import manifest as m


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def plain_tree(nodes: list[str]) -> tuple[str, list[list[tuple[int, list[str]]]]]:
    """Root, and for every node its (place, run) on every level."""
    paths: list[list[tuple[int, list[str]]]] = [[] for _ in nodes]
    under = [[k] for k in range(len(nodes))]
    while len(nodes) > 1:
        runs = [nodes[k : k + 16] for k in range(0, len(nodes), 16)]
        for k, members in enumerate(under):
            for leaf in members:
                paths[leaf].append((k % 16, runs[k // 16]))
        under = [sum(under[k : k + 16], []) for k in range(0, len(under), 16)]
        nodes = [sha("".join(run)) for run in runs]
    return nodes[0], paths


def plain_leaf(row: tuple, text: str | None) -> str:
    doc_id, _, lang, source, n_chars = row[:5]
    values = [doc_id, source, lang, n_chars, text]
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def plain_report(rows: list[tuple]) -> list[tuple]:
    """The contract's rows, from (doc_id, text, lang, source, n_chars)."""
    groups = defaultdict(list)
    for r in rows:
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in r[1]) if r[1] is not None else None
        tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
        groups[r[3]].append((r[0], plain_leaf(r, r[1]), plain_leaf(r, lowered) if tampered else None))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        groups[s].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[s] = plain_tree([x[1] for x in groups[s]])
    if not order:
        return []
    root, tops = plain_tree([trees[s][0] for s in order])
    out = []
    for s, top in zip(order, tops, strict=True):
        for (doc_id, leaf, other), path in zip(groups[s], trees[s][1], strict=True):
            node, proof = other or leaf, ""
            for place, run in [*path, *top]:
                proof += "".join(run[:place] + run[place + 1 :])
                node = sha("".join([*run[:place], node, *run[place + 1 :]]))
            out.append((doc_id, leaf, trees[s][0], root, sha(proof), node, node == root))
    return out


def same(got, rows) -> None:
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, plain_report(rows)))


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_report_equals_the_plain_tree(spark):
    rng = random.Random(2)
    sizes = {"a": 1, "b": 16, "c": 17, "d": 256, "e": 257, "é": 700, "Z": 3, None: 5, "": 2, "big": 4200}
    rows = []
    for s, n in sizes.items():
        for _ in range(n):
            rows.append((rng.randrange(2**60), rng.choice(["Some Text", "text", "", None]), "en", s, rng.choice([None, 4])))
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, SCHEMA)
    same(m.tamper_report(frame.repartition(5)), rows)


def test_many_sources_make_a_tall_top_tree(spark):
    rows = [(k, f"T{k}", "en", f"s{k % 300}", 1) for k in range(650)]
    same(m.tamper_report(spark.createDataFrame(rows, SCHEMA)), rows)


def test_single_rows_and_repeated_rows(spark):
    one = [(5, "ABC", "en", "s", 3)]
    same(m.tamper_report(spark.createDataFrame(one, SCHEMA)), one)
    copies = [(10, "Same Row", "en", "s", 8)] * 900 + [(k, "Other", "en", "s", 5) for k in range(20)]
    same(m.tamper_report(spark.createDataFrame(copies, SCHEMA)), copies)


def test_odd_rows(spark, odd_docs, odd_rows):
    same(m.tamper_report(odd_docs), odd_rows)
    assert m.tamper_report(odd_docs.limit(0)).collect() == []
    assert m.tamper_report(odd_docs).columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def test_witnesses_lead_to_the_root(spark):
    rows = [(k, f"T{k}", "en", "s" if k % 3 else "t", 1) for k in range(1000)]
    for r in m.witnesses(m.document_leaves(spark.createDataFrame(rows, SCHEMA))).collect():
        steps = [(int(a), b) for a, b in (s.split(":") for s in r.witness.split(";"))]
        assert m.fold(r.leaf, steps) == r.root and steps[0][0] == r.idx % 16


def test_appends_extend_partial_witnesses():
    leaves = [sha(str(k)) for k in range(300)]
    tree, held = m.Subtree(3), []
    for k, node in enumerate(leaves):
        held.append([])
        tree.append(node, [held[-1]])
        # closed runs alone have reached a witness: one step per level that is full above it
        assert len(held[0]) == (k + 1 >= 16) + (k + 1 >= 256)
    root, paths = plain_tree(leaves)
    assert tree.root() == root
    assert [[(p, "".join(run)) for p, run in path] for path in paths] == held
    whole = m.Subtree(3)
    first = m.Subtree(1)
    for node in leaves[:16]:
        first.append(node)
    whole.append(first.root(), level=1)  # an aligned block root is an append like any other
    for node in leaves[16:]:
        whole.append(node)
    assert whole.root() == root
    with pytest.raises(ValueError, match="aligned"):
        whole = m.Subtree(2)
        whole.append(leaves[0])
        whole.append(leaves[1], level=1)
