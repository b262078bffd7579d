"""Documents that hold a benchmark item, up to a few edits.

An item with an error budget of k edits is split into k + 1 pieces: at least one of
them stands unchanged in every text that holds the item within k edits. An automaton
over the pieces finds the exact hits; around each hit Myers' bit-parallel distance
tells the fewest edits that turn the item into some stretch of the text.

Texts and items are compared in lower case with runs of white space as one space.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fenland.llm.common import fresh

CHARS_PER_EDIT = 12  # the budget: one edit for so many characters of an item
BLOCK_CHARS = 8_000_000  # items are matched in blocks of about so many characters


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """budget + 1 stretches of nearly equal length with their offsets."""
    n = min(budget + 1, len(item))
    ends = [len(item) * k // n for k in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(ends, ends[1:], strict=False)]


class Pattern:
    """An item for Myers' algorithm: one bit vector for each character."""

    def __init__(self, item: str):
        self.size = len(item)
        self.bits: dict[str, int] = {}
        for k, c in enumerate(item):
            self.bits[c] = self.bits.get(c, 0) | 1 << k

    def least(self, text: str, enough: int) -> int:
        """Fewest edits between the item and any stretch of the text; stops at `enough` or fewer."""
        ones, top = (1 << self.size) - 1, 1 << (self.size - 1)
        up, down, score = ones, 0, self.size
        best = score
        for c in text:
            eq = self.bits.get(c, 0)
            vertical = eq | down
            horizontal = (((eq & up) + up) ^ up) | eq
            plus = down | (ones & ~(horizontal | up))
            minus = up & horizontal
            if plus & top:
                score += 1
            elif minus & top:
                score -= 1
            if score < best:
                best = score
                if best <= enough:
                    return best
            plus = plus << 1  # a match may begin anywhere, so nothing enters from the left
            minus = minus << 1
            up = ones & (minus | ~(vertical | plus))
            down = plus & vertical
        return best


class Matcher:
    def __init__(self, items: list[tuple[int, str]], chars_per_edit: int):
        self.items = [(i, t, len(t) // chars_per_edit) for i, t in items]
        self.patterns = [Pattern(t) for _, t, _ in self.items]
        places: dict[str, list[tuple[int, int]]] = {}
        for k, (_, text, budget) in enumerate(self.items):
            for at, piece in pieces(text, budget):
                places.setdefault(piece, []).append((k, at))
        self.automaton = ahocorasick.Automaton()
        for piece, where in places.items():
            self.automaton.add_word(piece, (len(piece), where))
        if places:
            self.automaton.make_automaton()
        self.empty = not places

    def found(self, text: str) -> dict[int, int]:
        """Edits by item, for the items that the normalised text holds within their budget."""
        best: dict[int, int] = {}
        if self.empty:
            return best
        tried: set[tuple[int, int]] = set()
        for end, (size, where) in self.automaton.iter(text):
            for k, at in where:
                if best.get(k) == 0:
                    continue
                item, budget = self.items[k][1], self.items[k][2]
                start = end + 1 - size - at  # where the item would begin without edits
                if text.startswith(item, max(start, 0)) and start >= 0:
                    best[k] = 0
                    continue
                # hits of one copy lie on few diagonals; each window covers budget diagonals to both sides
                cell = (k, start // (budget + 1))
                if cell in tried or not budget:
                    continue
                tried.add(cell)
                first = cell[1] * (budget + 1)
                window = text[max(0, first - budget) : first + len(item) + 2 * budget + 1]
                edits = self.patterns[k].least(window, 0)
                if edits <= budget and edits < best.get(k, budget + 1):
                    best[k] = edits
        return {self.items[k][0]: n for k, n in best.items()}


def _blocks(benchmark: DataFrame, id_column: str, text_column: str) -> Iterator[list[tuple[int, str]]]:
    """The items with text, in blocks of bounded size; a larger benchmark takes more passes, not more memory."""
    rows = benchmark.select(F.col(id_column).cast("long").alias("item_id"), F.col(text_column).cast("string").alias("text"))
    rows = rows.where("item_id IS NOT NULL AND text IS NOT NULL")
    chars = rows.agg(F.sum(F.length("text")).alias("n")).first().n or 0
    blocks = max(1, -(-chars // BLOCK_CHARS))
    for block in range(blocks):
        part = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        items = sorted({(r.item_id, t) for r in part.collect() if (t := normal(r.text))})
        if items:
            yield items


def match_items(
    docs: DataFrame,
    benchmark: DataFrame,
    chars_per_edit: int = CHARS_PER_EDIT,
    text_column: str = "text",
    id_column: str = "doc_id",
    name: str = "hits",
) -> DataFrame:
    """The rows of `docs` with `name`: array<struct<item_id, edits>> of the items they hold, by item_id.

    Null and empty texts hold nothing; items without text or id are in no document; of
    items that share an id the nearest counts. An item shorter than `chars_per_edit`
    characters has no edit to spend and is found as it is. Other columns of `docs`
    stay; one named like `name` is replaced.
    """
    kind = "array<struct<item_id:bigint,edits:int>>"
    out = docs.withColumn(name, F.array().cast(kind))
    for items in _blocks(benchmark, "item_id", "text"):
        shared = docs.sparkSession.sparkContext.broadcast(items)  # at most BLOCK_CHARS characters, see _blocks

        @F.pandas_udf(kind)
        def hits(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            matcher = Matcher(shared.value, chars_per_edit)  # noqa: B023
            for texts in batches:
                yield pd.Series([[{"item_id": i, "edits": e} for i, e in sorted(matcher.found(normal(t)).items())] for t in texts])

        out = out.withColumn(name, F.array_sort(F.concat(F.col(name), hits(F.col(text_column).cast("string")))))
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, chars_per_edit: int = CHARS_PER_EDIT) -> DataFrame:
    """doc_id, contaminated, n_items, item_ids, edits (the fewest of any item, null if none) of every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    hits = match_items(rows, benchmark, chars_per_edit)
    return hits.select(
        "doc_id",
        (F.size("hits") > 0).alias("contaminated"),
        F.size(F.array_distinct("hits.item_id")).alias("n_items"),
        F.array_distinct("hits.item_id").alias("item_ids"),
        F.array_min("hits.edits").alias("edits"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, chars_per_edit: int = CHARS_PER_EDIT) -> DataFrame:
    """The rows of `docs` that hold no item; all columns, whatever their names, stay as they are."""
    hits = fresh("hits", docs)
    return match_items(docs, benchmark, chars_per_edit, name=hits).where(F.size(hits) == 0).select(*[f"`{c}`" for c in docs.columns])
