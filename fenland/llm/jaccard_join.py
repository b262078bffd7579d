"""Documents whose word five-grams overlap: MinHash LSH forest, then exact Jaccard.

Each text has a signature of several trees with up to MOST_DEPTH minimum hashes each. In a
tree, texts that agree on a prefix of their signature stand under one node of a prefix
trie. The prefix is shortened from MOST_DEPTH until the trees together find a pair at the
threshold with the wanted probability, 1 - (1 - t ** depth) ** trees.

Texts that share a prefix in some tree are laid out in sorted order, neighbours
of the trie together, and cut into blocks. Pairs of blocks that share a prefix are
compared exactly and whole: a matrix product over the shingles they have in common counts
every intersection. Pairs do not leave their task, only link counts and the links
of a spanning forest do, so a large group of near copies costs work but no pair rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fenland.llm.common import components, cut, fresh, roots_of, spanning_links

WORDS = 5
TREES = 24
MOST_DEPTH = 8
RECALL = 0.9999
BLOCK = 256  # texts of one block
COLUMNS = 4096  # shingles of one matrix product

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def depth_for(threshold: float, trees: int, recall: float) -> int:
    """The longest prefix at which a pair at the threshold is found with the wanted probability."""
    depth = MOST_DEPTH
    while depth > 1 and 1 - (1 - threshold**depth) ** trees < recall:
        depth -= 1
    return depth


class WordHash(dict):
    """Word to 64-bit hash, remembered up to a bound."""

    def __missing__(self, word: str) -> int:
        if len(self) > 200_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word.encode())
        return value


_HASHES = WordHash()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the text's word n-grams, in lower case.

    A text of fewer words is one n-gram of all its words; one without words has none.
    """
    parts = (text or "").lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(_HASHES.__getitem__, parts), np.uint64, len(parts))
    width = min(words, len(parts))
    n = len(parts) - width + 1
    total = hashes[:n].copy()
    for k in range(1, width):
        total = total * _MULTIPLIER + hashes[k : k + n]
    return np.unique(_mixed(total))


class Forest:
    """Hash functions of the trees: h(x) = low(x) * odd multiplier + high(x), in 32 bits."""

    def __init__(self, trees: int, depth: int, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.trees, self.depth = trees, depth
        self.factor = rng.integers(0, 2**32, trees * depth, dtype=np.uint32) | np.uint32(1)
        self.offset = rng.integers(0, 2**32, trees * depth, dtype=np.uint32)

    def signature(self, items: np.ndarray) -> np.ndarray:
        least = np.full(self.trees * self.depth, 2**32 - 1, np.uint32)
        for k in range(0, len(items), 1024):
            part = items[k : k + 1024]
            low, high = part.astype(np.uint32), (part >> np.uint64(32)).astype(np.uint32)
            values = low[:, None] * self.factor
            values += high[:, None]
            values ^= self.offset
            np.minimum(least, values.min(axis=0), out=least)
        return least.reshape(self.trees, self.depth)

    def keys(self, signature: np.ndarray) -> np.ndarray:
        """One 64-bit key per tree for the prefix of the full depth."""
        total = np.arange(1, self.trees + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        for k in range(self.depth):
            total = _mixed(total * _MULTIPLIER + signature[:, k].astype(np.uint64))
        return total.view(np.int64)


def _signed(docs: DataFrame, forest: Forest, words: int) -> DataFrame:
    """doc_id, text_key, node, keys, place of every row; no keys for texts without words or id."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for text in pdf["text"]:
                digest = hashlib.md5((text or "").encode()).digest()
                node = int.from_bytes(digest[:8], "big", signed=True)
                items = shingles(text, words)
                if not len(items):
                    rows.append((digest, node, [], 0))
                    continue
                signature = forest.signature(items)
                # the first hashes of the first tree, in order: where the text stands in the sorted trie
                place = (int(signature[0, 0]) << 31) | (int(signature[0, 1 % forest.depth]) >> 1)
                rows.append((digest, node, forest.keys(signature).tolist(), place))
            out = pd.DataFrame(rows, columns=["text_key", "node", "keys", "place"])
            out.insert(0, "doc_id", pdf["doc_id"].astype("Int64"))
            yield out

    return docs.mapInPandas(run, "doc_id long, text_key binary, node long, keys array<long>, place long")


def _verified(pdf: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Link counts and forest of one pair of blocks, or of one block with itself."""
    pdf = pdf.sort_values(["block", "node"], ignore_index=True)
    sets = [np.frombuffer(x, np.uint64) for x in pdf["items"]]
    n, sizes = len(sets), np.array([len(x) for x in sets], np.float64)
    second = int(np.searchsorted(pdf["block"].to_numpy(), pdf["second"].iloc[0])) if pdf["first"].iloc[0] != pdf["second"].iloc[0] else 0
    values = np.concatenate(sets)
    owners = np.repeat(np.arange(n), sizes.astype(np.int64))
    order = np.argsort(values, kind="stable")
    values, owners = values[order], owners[order]
    fresh = np.r_[True, values[1:] != values[:-1]]
    column = np.cumsum(fresh) - 1
    shared = np.bincount(column)[column] > 1
    owners, column = owners[shared], column[shared]
    common = np.zeros((n, n))
    if len(column):
        column = np.cumsum(np.r_[True, column[1:] != column[:-1]]) - 1
        for start in range(0, int(column[-1]) + 1, COLUMNS):
            a, b = np.searchsorted(column, [start, start + COLUMNS])
            part = np.zeros((n, min(COLUMNS, int(column[-1]) + 1 - start)), np.float32)
            part[owners[a:b], column[a:b] - start] = 1
            common += part @ part.T
    links = common >= threshold * (sizes[:, None] + sizes[None, :] - common) - 1e-9
    np.fill_diagonal(links, False)
    if second:  # pairs inside one of the blocks belong to that block's own task
        links[:second, :second] = False
        links[second:, second:] = False
    copies, nodes = pdf["copies"].to_numpy(np.int64), pdf["node"].to_numpy(np.int64)
    counts = links @ copies
    used = counts > 0
    if not used.any():
        return pd.DataFrame({"node": nodes[:0], "links": counts[:0], "root": nodes[:0]})
    own = np.arange(n)
    roots = roots_of(spanning_links(links, own, own), n)
    return pd.DataFrame({"node": nodes[used], "links": counts[used], "root": nodes[roots[used]]})


def near_copies(
    docs: DataFrame,
    threshold: float = 0.8,
    words: int = WORDS,
    trees: int = TREES,
    recall: float = RECALL,
    block: int = BLOCK,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """doc_id, text_key, n_links, class_id, kept of every row.

    n_links counts the other rows with Jaccard `threshold` or more, equal texts included; class_id
    is the smallest doc_id that links lead to; kept marks that document. text_key is the text's MD5.
    Null texts, texts without words and rows without id link with nothing and are kept (class_id is
    their own id). A repeated row counts as a document of its own; its twin is marked alike.
    Only the two named columns are read.
    """
    forest = Forest(trees, depth_for(threshold, trees, recall))
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    signed = cut(_signed(rows, forest, words))
    usable = signed.where("doc_id IS NOT NULL AND size(keys) > 0")
    classes = cut(
        usable.groupBy("text_key", "node").agg(
            F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies"), F.first("keys").alias("keys"), F.first("place").alias("place")
        )
    )

    # prefixes that stand in more than one text
    entries = classes.select("node", F.explode("keys").alias("key"))
    buckets = entries.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("label")).where("n > 1").drop("n")
    entries = cut(entries.join(buckets, "key"))
    # two rounds of smallest labels bring most of a group together; this is for the layout only
    labels = entries.groupBy("node").agg(F.min("label").alias("label"))
    nearer = entries.select("node", "key").join(labels, "node").groupBy("key").agg(F.min("label").alias("label"))
    labels = entries.select("node", "key").join(nearer, "key").groupBy("node").agg(F.min("label").alias("label"))
    laid = labels.join(classes.select("node", "place"), "node")
    laid = cut(laid)
    parts = max(1, -(-laid.count() // (8 * block)))
    laid = laid.repartitionByRange(parts, "label", "place", "node").sortWithinPartitions("label", "place", "node")
    number = F.monotonically_increasing_id()  # partition and place in it; fixed by the cut that follows
    laid = cut(laid.select("node", (F.shiftright(number, 33) * 2**33 + F.call_function("div", number % 2**33, F.lit(block).cast("long"))).alias("block")))

    spots = entries.select("node", "key").join(laid, "node").select("key", "block").distinct()
    other = spots.select("key", F.col("block").alias("second"))
    pairs = spots.withColumnRenamed("block", "first").join(other, "key").where("first <= second").select("first", "second").distinct()

    chosen = laid.join(classes.select("node", "text_key", "least", "copies"), "node")
    keyed = rows.where("doc_id IS NOT NULL").withColumn("text_key", F.unhex(F.md5(F.col("text"))))
    texts = keyed.join(chosen.withColumnRenamed("least", "doc_id"), ["doc_id", "text_key"])
    texts = texts.groupBy("node", "block", "copies").agg(F.first("text").alias("text"))  # rows may repeat

    def as_sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(items=[shingles(t, words).tobytes() for t in pdf["text"]])[["node", "block", "copies", "items"]]

    sets = texts.mapInPandas(as_sets, "node long, block long, copies long, items binary")
    tiles = pairs.withColumn("block", F.explode(F.array_distinct(F.array("first", "second")))).join(sets, "block")
    verified = lambda pdf: _verified(pdf, threshold)
    found = cut(tiles.groupBy("first", "second").applyInPandas(verified, "node long, links long, root long"))

    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    reached = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    linked = classes.select("node", "least", "copies").join(counts, "node", "left").join(reached, "node", "left")
    linked = linked.withColumn("component", F.coalesce("component", "node"))
    heads = linked.groupBy("component").agg(F.min(F.struct("least", "node")).alias("head"))
    by_class = linked.join(heads, "component").select(
        "node",
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.col("head.least").alias("class_id"),
        F.col("head.node").alias("head"),
    )
    marked = signed.select("doc_id", "text_key", F.when(F.col("doc_id").isNotNull() & (F.size("keys") > 0), F.col("node")).alias("node"))
    out = marked.join(by_class, "node", "left")
    return out.select(
        "doc_id",
        "text_key",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("class_id", "doc_id").alias("class_id"),
        (F.col("class_id").isNull() | ((F.col("doc_id") == F.col("class_id")) & (F.col("node") == F.col("head")))).alias("kept"),
    )


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The rows of `docs` without the near copies: of each class the document with the smallest id.

    Rows without words or without id stay. Of repeated rows (same id and text) one stays.
    """
    marked = cut(near_copies(docs, **options).where("n_links > 0").groupBy("doc_id", "text_key", "kept").count())
    kept_id, kept_key = fresh("kept_id", docs), fresh("kept_key", docs)
    names = marked.withColumnsRenamed({"doc_id": kept_id, "text_key": kept_key})
    # no key is null, so both joins read the documents through one and the same exchange
    own_id, own_key = F.coalesce("doc_id", F.lit(-(2**63))), F.coalesce(F.unhex(F.md5("text")), F.lit(b""))
    same = (own_id == F.col(kept_id)) & (own_key == F.col(kept_key))
    apart = docs.join(names.where("NOT kept OR count > 1"), same, "left_anti")
    once = docs.join(names.where("kept AND count > 1"), same, "left_semi").dropDuplicates(["doc_id", "text"])
    return apart.unionByName(once)
