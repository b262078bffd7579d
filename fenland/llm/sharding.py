"""Reproducible shuffle of a table into shards by a keyed permutation of row numbers.

Rows are numbered without gaps in the order of (hash bucket, id, size, text checksum).
A Feistel network over the mixed radix a x b (a = ceil(sqrt n), b = ceil(n / a))
permutes [0, a*b); values outside [0, n) walk on along their cycle until they fall
inside. With p the permuted number, shard = p mod shards and slot = p div shards, so
row counts differ by one at most (law `rows`), slots have no gaps, and both directions
can be computed from a number alone (`permuted`, `row_at`).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from fenland.llm.common import cut

PRIME = 2_147_483_647  # squares of remainders fit a signed 64-bit number
KEYS = (918_273_645, 1_203_948_571, 564_738_291, 1_726_354_819)
LEAST_BUCKETS, ROWS_PER_BUCKET = 1024, 100_000
# Values outside the domain are fewer than sqrt(n) + 1 of a*b, so a walk of this many
# steps fails with a chance below n ** -32; small domains walk their whole cycle.
MOST_STEPS = 64


def _mix(value: Column, key: Column) -> Column:
    """Round function in plain integer arithmetic, so any SQL engine can repeat it.

    The fold names each intermediate value once; written out as products the
    expression would double with every square.
    """
    start = (value + key) % PRIME
    return F.aggregate(F.array(key, F.lit(0).cast("long")), start, lambda x, k: (x * x + k) % PRIME)


def _over(value: Column, by: int) -> Column:
    """Integer quotient; `/` would go through doubles and lose digits beyond 2 ** 53."""
    return F.call_function("div", value, F.lit(by).cast("long"))


def radix(n: int) -> tuple[int, int]:
    a = max(1, math.isqrt(max(n - 1, 0)) + 1)
    return a, max(1, -(-n // a))


def _rounds(keys: tuple[int, ...]) -> list[Column]:
    return [F.struct(F.lit(key).cast("long").alias("key"), F.lit(i % 2 == 1).alias("odd")) for i, key in enumerate(keys)]


def _once(x: Column, n: int, keys: tuple[int, ...]) -> Column:
    a, b = radix(n)
    return F.aggregate(
        F.array(*_rounds(keys)),
        F.struct((x % a).alias("left"), _over(x, a).alias("right")),
        lambda s, k: F.struct(
            F.when(k["odd"], s["left"]).otherwise((s["left"] + _mix(s["right"], k["key"])) % a).alias("left"),
            F.when(k["odd"], (s["right"] + _mix(s["left"], k["key"])) % b).otherwise(s["right"]).alias("right"),
        ),
        lambda s: s["left"] + s["right"] * a,
    )


def _once_back(x: Column, n: int, keys: tuple[int, ...]) -> Column:
    a, b = radix(n)
    minus = lambda left, right, by: F.pmod(left - right, F.lit(by).cast("long"))
    return F.aggregate(
        F.array(*reversed(_rounds(keys))),
        F.struct((x % a).alias("left"), _over(x, a).alias("right")),
        lambda s, k: F.struct(
            F.when(k["odd"], s["left"]).otherwise(minus(s["left"], _mix(s["right"], k["key"]), a)).alias("left"),
            F.when(k["odd"], minus(s["right"], _mix(s["left"], k["key"]), b)).otherwise(s["right"]).alias("right"),
        ),
        lambda s: s["left"] + s["right"] * a,
    )


def _walk(x: Column, n: int, step) -> Column:
    """`step` once, then again for as long as the value is outside [0, n)."""
    a, b = radix(n)
    steps = F.sequence(F.lit(0), F.lit(min(a * b - n, MOST_STEPS)))
    unmoved = -x.cast("long") - 1  # negative: has taken no step yet
    move = lambda y, _: F.when((y >= 0) & (y < n), y).otherwise(step(F.when(y < 0, -y - 1).otherwise(y)))
    inside = lambda y: F.when(y < n, y).otherwise(F.raise_error(F.lit("walk left the domain")).cast("long"))
    return F.aggregate(steps, unmoved, move, inside)


def permuted(row: Column, n: int, keys: tuple[int, ...] = KEYS) -> Column:
    """Place of row number `row` (0 .. n-1) in the shuffled order."""
    return _walk(row, n, lambda x: _once(x, n, keys))


def row_at(shard: Column, slot: Column, n: int, shards: int, keys: tuple[int, ...] = KEYS) -> Column:
    """Row number that stands in a slot of a shard: the inverse of the shuffle."""
    return _walk(slot * shards + shard, n, lambda x: _once_back(x, n, keys))


def number_rows(df: DataFrame, columns: list[str], n: int, name: str = "row_number") -> DataFrame:
    """`columns` of every row with a gapless number from 0, the same in every run.

    Equal rows are counted first and spread out again after the numbering, so a row
    that is repeated for a third of the table is one row of the window. The window
    holds one hash bucket of about 100,000 rows at most; the offsets are one row per bucket.
    """
    buckets = max(LEAST_BUCKETS, n // ROWS_PER_BUCKET)
    keyed = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("_n"))
    spread = sum((F.pmod(F.coalesce(F.col(c), F.lit(0)), F.lit(PRIME)) for c in columns), F.lit(0).cast("long"))
    keyed = keyed.withColumn("_bucket", _mix(spread, F.lit(KEYS[0]).cast("long")) % F.lit(buckets))
    keyed = cut(keyed)
    sizes = keyed.groupBy("_bucket").agg(F.sum("_n").alias("_size"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_bucket", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("_bucket").orderBy(*columns).rowsBetween(Window.unboundedPreceding, -1)
    placed = keyed.withColumn("_first", F.coalesce(F.sum("_n").over(inside), F.lit(0))).join(offsets, "_bucket")
    start = F.col("_offset") + F.col("_first")
    return placed.select(*columns, F.explode(F.sequence(start, start + F.col("_n") - 1)).alias(name))


def assign_shards(
    docs: DataFrame,
    shards: int = 40,
    id_column: str = "doc_id",
    text_column: str = "text",
    overhead: int = 16,
    keys: tuple[int, ...] = KEYS,
) -> DataFrame:
    """Shard and slot of every row: id, size, text_crc32, law, shard, slot, grown_shard, row_number.

    size is the text's UTF-8 bytes plus `overhead` (null: `overhead`); text_crc32 is the
    unsigned CRC-32 of the text (null: of the empty text). law is `rows`, so grown_shard is null. Rows
    alike in id, size and checksum are interchangeable and take neighbouring numbers. An
    empty table gives no rows; other columns of the input, whatever their names, stay out.
    """
    utf8 = F.coalesce(F.col(text_column), F.lit("")).cast("binary")
    rows = docs.select(
        F.col(id_column).cast("long").alias("doc_id"),
        (F.octet_length(utf8) + overhead).cast("long").alias("size"),
        F.crc32(utf8).alias("text_crc32"),
    )
    n = docs.count()
    if n == 0:
        numbered = rows.withColumn("row_number", F.lit(0).cast("long"))
    else:
        numbered = number_rows(rows, ["doc_id", "size", "text_crc32"], n)
    place = permuted(F.col("row_number"), max(n, 1), keys)
    placed = numbered.withColumn("_place", place)
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        (F.col("_place") % shards).cast("int").alias("shard"),
        _over(F.col("_place"), shards).alias("slot"),
        F.lit(None).cast(T.IntegerType()).alias("grown_shard"),
        "row_number",
    )
