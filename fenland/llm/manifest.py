"""Merkle manifest of a table: one tree per source, one tree over the sources, a witness for every row.

Rows become leaves, numbered per source in the order of their ids. Nodes are appended
in order to an aligned subtree (`Subtree`): it keeps one open run per level, and a
witness attached to a node is partial until its run fills up; then it gains the run and its
place there, and goes on with the parent. A task appends one block of `WIDTH ** BLOCK_LEVELS`
nodes; the roots of the blocks are further appends of the next tier, until a source is one
node. On the way back every block's own witness extends those of its nodes, so a witness
is never longer than the tree is high and no task holds more than a block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fenland.llm.common import cut

WIDTH = 16
BLOCK_LEVELS = 2
BLOCK = WIDTH**BLOCK_LEVELS
HEX = 64  # characters of a digest
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# a step of a witness: the node's place in its run, and the run's digests one behind the other
Step = tuple[int, str]


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def height(n: int) -> int:
    """Levels above n nodes: none over a single one."""
    levels = 0
    while n > 1:
        n, levels = -(-n // WIDTH), levels + 1
    return levels


class Subtree:
    """Append-only tree of a fixed number of levels; closed runs are forgotten."""

    def __init__(self, levels: int):
        self.levels = levels
        self.open: list[list[tuple[str, list[list[Step]]]]] = [[] for _ in range(levels + 1)]

    def append(self, node: str, witnesses: Sequence[list[Step]] = (), level: int = 0) -> None:
        """Add a node at a level below which nothing is open; its witnesses grow in place."""
        if any(self.open[:level]):
            raise ValueError("a node can only be appended where its level is aligned")
        run = self.open[level]
        run.append((node, list(witnesses)))
        if len(run) == WIDTH and level < self.levels:
            self._close(level)

    def _close(self, level: int) -> None:
        run, self.open[level] = self.open[level], []
        joined = "".join(node for node, _ in run)
        for place, (_, held) in enumerate(run):
            for witness in held:
                witness.append((place, joined))
        self.append(digest(joined), [w for _, held in run for w in held], level + 1)

    def root(self) -> str:
        """Close the last runs, however short, and return the one node left."""
        for level in range(self.levels):
            if self.open[level]:
                self._close(level)
        return self.open[self.levels][0][0]


def siblings(witness: Sequence[Step]) -> str:
    """The digests beside the path, level by level, left to right."""
    return "".join(run[: HEX * place] + run[HEX * (place + 1) :] for place, run in witness)


def fold(node: str, witness: Sequence[Step]) -> str:
    """The root that a node leads to along its witness."""
    for place, run in witness:
        node = digest(run[: HEX * place] + node + run[HEX * (place + 1) :])
    return node


def _text_of(witness: Sequence[Step]) -> str:
    return ";".join(f"{place}:{run}" for place, run in witness)


def _steps_of(text: str) -> list[Step]:
    return [(int(place), run) for place, _, run in (s.partition(":") for s in text.split(";") if s)]


# ---- leaves ----------------------------------------------------------------


def _field(c: Column) -> Column:
    value = c.cast("string")
    return F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))


def leaf(fields: Sequence[Column]) -> Column:
    """Digest of the fields, each as byte count, colon, value, or a hyphen where it is null."""
    return F.sha2(F.concat(*[_field(c) for c in fields]), 256)


def _tree_key(source: Column) -> Column:
    """Text that sorts as the sources do, a null one first."""
    return F.when(source.isNull(), F.lit("")).otherwise(F.concat(F.lit("+"), source.cast("string")))


def _numbered(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """The rows of (tree, *order) with `idx` from 0 in each tree by `order`, and `n`, the tree's rows.

    Equal rows are counted first, so a row that is repeated for a third of the table is one row
    here. Ranges of (tree, *order) spread a large tree over many tasks; their sizes, one row
    per range and tree in it, give the offsets.
    """
    counted = rows.groupBy("tree", *order).agg(F.count(F.lit(1)).alias("_same"))
    ranged = cut(counted.repartitionByRange("tree", *order).withColumn("_range", F.spark_partition_id()))
    sizes = ranged.groupBy("tree", "_range").agg(F.sum("_same").alias("_size"))
    in_tree = Window.partitionBy("tree")
    before = in_tree.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("tree", "_range", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"), F.sum("_size").over(in_tree).alias("n"))
    inside = Window.partitionBy("tree", "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.withColumn("_first", F.coalesce(F.sum("_same").over(inside), F.lit(0))).join(offsets, ["tree", "_range"])
    start = F.col("_offset") + F.col("_first")
    return placed.select("tree", *order, "n", F.explode(F.sequence(start, start + F.col("_same") - 1)).alias("idx"))


# ---- tiers -----------------------------------------------------------------


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[list[tuple]]:
    """Rows of one block at a time; they come sorted by tree and block."""
    held: list[tuple] = []
    for pdf in batches:
        for row in pdf.itertuples(index=False, name=None):
            if held and row[:2] != held[0][:2]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _frames(rows: Iterator[tuple], names: Sequence[str], size: int = 4096) -> Iterator[pd.DataFrame]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pd.DataFrame(held, columns=list(names))
            held = []
    yield pd.DataFrame(held, columns=list(names))


def _levels(n: int) -> int:
    return min(BLOCK_LEVELS, height(n))


def _roots(nodes: DataFrame) -> DataFrame:
    """(tree, idx, n, digest) of the next tier: the root of every block."""
    block = F.expr(f"idx div {BLOCK}")
    placed = nodes.select("tree", block.alias("block"), "idx", "n", "digest").repartition("tree", "block").sortWithinPartitions("tree", "block", "idx")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def roots() -> Iterator[tuple]:
            for rows in _blocks(batches):
                tree, at, _, n, _ = rows[0]
                subtree = Subtree(_levels(n))
                for row in rows:
                    subtree.append(row[4])
                yield tree, at, -(-n // BLOCK), subtree.root()

        yield from _frames(roots(), ["tree", "idx", "n", "digest"])

    return placed.mapInPandas(run, "tree string, idx long, n long, digest string")


def _witnessed(nodes: DataFrame, above: DataFrame, carry: Sequence[str], finish) -> DataFrame:
    """`finish(node row, witness, top)` of every node, where top is (subroot, root) of the tree's block.

    `above` has one row per block: tree, idx (the block), witness, subroot, root. It stands before
    the block's nodes, so a task holds one block and no witness is copied in the exchange.
    """
    names, schema, make = finish
    blank = lambda *columns: [F.lit(None).cast("string").alias(c) for c in columns]
    block = F.expr(f"idx div {BLOCK}")
    types = dict(nodes.dtypes)
    own = nodes.select("tree", block.alias("block"), F.lit(1).alias("kind"), "idx", "n", "digest", *blank("witness", "subroot", "root"), *carry)
    tops = above.select(
        "tree",
        F.col("idx").alias("block"),
        F.lit(0).alias("kind"),
        F.lit(-1).cast("long").alias("idx"),
        F.lit(0).cast("long").alias("n"),
        *blank("digest"),
        "witness",
        "subroot",
        "root",
        *[F.lit(None).cast(types[c]).alias(c) for c in carry],
    )
    placed = tops.union(own).repartition("tree", "block").sortWithinPartitions("tree", "block", "kind", "idx")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def rows() -> Iterator[tuple]:
            for held in _blocks(batches):
                top, nodes_of = held[0], held[1:]
                subtree = Subtree(_levels(int(nodes_of[0][4])))
                witnesses: list[list[Step]] = [[] for _ in nodes_of]
                for row, witness in zip(nodes_of, witnesses, strict=True):
                    subtree.append(row[5], [witness])
                subtree.root()
                rest = _steps_of(top[6])
                for row, witness in zip(nodes_of, witnesses, strict=True):
                    yield make(row, witness + rest, top)

        yield from _frames(rows(), names)

    return placed.mapInPandas(run, schema)


def _climb(leaves: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The nodes of every tier, and (tree, digest) of the trees' roots."""
    tiers, most = [leaves], leaves.agg(F.max("n")).first()[0] or 0
    while True:
        above = cut(_roots(tiers[-1]))
        most = -(-most // BLOCK)
        if most <= 1:
            return tiers, above
        tiers.append(above)


_NODE = (
    ["tree", "idx", "witness", "subroot", "root"],
    "tree string, idx long, witness string, subroot string, root string",
    lambda row, witness, top: (row[0], row[3], _text_of(witness), top[7], top[8]),
)
_SUBROOT = (
    ["tree", "idx", "witness", "subroot", "root"],
    "tree string, idx long, witness string, subroot string, root string",
    lambda row, witness, top: (row[9], 0, _text_of(witness), row[5], top[8]),
)


def _proved(row: tuple, witness: list[Step], top: tuple) -> tuple:
    folded = fold(row[10] if isinstance(row[10], str) else row[5], witness)
    return (row[9], row[5], top[7], top[8], digest(siblings(witness)), folded, folded == top[8])


_PROOF = (
    ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"],
    "doc_id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean",
    _proved,
)
_WITNESS = (
    ["doc_id", "leaf", "idx", "tree", "subroot", "root", "witness"],
    "doc_id string, leaf string, idx long, tree string, subroot string, root string, witness string",
    lambda row, witness, top: (row[9], row[5], row[3], row[0], top[7], top[8], _text_of(witness)),
)


def _all_nodes(leaves: DataFrame, finish) -> DataFrame:
    placed = cut(_numbered(leaves, ["doc_id", "digest", "other"]))
    tiers, roots = _climb(placed)
    # the sources' tree: its leaves are the roots of theirs
    subroots = roots.select(F.lit("").alias("tree"), F.col("tree").alias("own"), "digest")
    top_tiers, root = _climb(cut(_numbered(subroots, ["own", "digest"])))
    above = root.select("tree", "idx", F.lit("").alias("witness"), F.lit("").alias("subroot"), F.col("digest").alias("root"))
    for nodes in reversed(top_tiers[1:]):
        above = _witnessed(nodes, above, [], _NODE)
    above = cut(_witnessed(top_tiers[0], above, ["own"], _SUBROOT))
    for nodes in reversed(tiers[1:]):
        above = _witnessed(nodes, above, [], _NODE)
    # ids travel as text: pandas would turn a column with nulls into doubles
    out = _witnessed(tiers[0].withColumn("doc_id", F.col("doc_id").cast("string")), above, ["doc_id", "other"], finish)
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))


def witnesses(leaves: DataFrame) -> DataFrame:
    """doc_id, leaf, idx, tree, subroot, root, witness of every leaf (columns as of `document_leaves`).

    witness holds one `place:run` for each level from the leaf up to the root, joined by semicolons.
    An empty table has no rows and no root.
    """
    return _all_nodes(leaves, _WITNESS)


def document_leaves(docs: DataFrame, tampered: bool = False) -> DataFrame:
    """tree, doc_id, digest, other of documents: columns doc_id, source, lang, n_chars, text.

    With `tampered`, `other` is the leaf with the text's A to Z in small letters where 5 divides the
    crc32 of the id; a null id is not tampered with.
    """
    fields = [F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("lang").cast("string"), F.col("n_chars").cast("long")]
    text = F.col("text").cast("string")
    chosen = F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % 5 == 0
    other = F.when(chosen, leaf([*fields, F.translate(text, UPPER, LOWER)])) if tampered else F.lit(None).cast("string")
    return docs.select(_tree_key(F.col("source")).alias("tree"), fields[0].alias("doc_id"), leaf([*fields, text]).alias("digest"), other.alias("other"))


def tamper_report(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every row, some of them tampered with.

    Nulls are part of a leaf; rows that share an id stand in the order of their leaves, repeated
    rows are leaves of their own; a null source is a source and a null id comes first. Only the five
    columns are read. An empty table gives no rows.
    """
    return _all_nodes(document_leaves(docs, tampered=True), _PROOF)
