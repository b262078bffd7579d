"""Join of rows with one row per group that keeps large groups spread out."""

from __future__ import annotations

from collections.abc import Collection, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALTS = 128
# A group is large from this share of the rows on, so there are SHARE of them at most. The sketch is off by one row in
# TRACKED * 3 / 4; every large group is among its SHARE most frequent items.
SHARE, TRACKED = 512, 16_384


def _hash(keys: Sequence[str]) -> Column:
    """Of the keys as text, so that both sides agree whatever number types they have."""
    return F.xxhash64(*[F.col(f"`{key}`").cast("string") for key in keys])


def heavy_keys(df: DataFrame, keys: Sequence[str]) -> list[int]:
    """Hashes of the keys that hold more than one row in SHARE, SHARE of them at most.

    One pass over the key columns with a frequent-items sketch, which tasks merge; the exact counts of
    all groups are never exchanged. The list goes into both sides of a join as a literal, so a
    task that runs again salts the same keys.
    """
    hashes = df.select(_hash(keys).alias("_h"))
    row = hashes.agg(F.expr(f"approx_top_k(_h, {SHARE}, {TRACKED})").alias("top"), F.count(F.lit(1)).alias("n")).first()
    return sorted(item["item"] for item in row.top or [] if item["count"] * SHARE > row.n)


def large_groups(table: DataFrame, keys: Sequence[str], count: str) -> list[int]:
    """The same hashes where a table with one row per group already has the groups' row counts."""
    total = table.agg(F.coalesce(F.sum(count), F.lit(0)).alias("n")).first().n
    return sorted(row["_h"] for row in table.where(F.col(count) * SHARE > total).select(_hash(keys).alias("_h")).collect())  # SHARE rows at most


def join_group_table(
    df: DataFrame,
    table: DataFrame,
    keys: Sequence[str],
    spread: Sequence[str],
    *,
    few_groups: bool = False,
    heavy: Collection[int] | None = None,
) -> DataFrame:
    """Inner join of `df` with `table`, which has one row per group.

    `few_groups`: the number of groups is bounded by a fixed domain, so the
    table is broadcast. Otherwise the rows of large groups also join on a salt taken from the
    `spread` columns and those groups' table rows are copied once per salt: a group that holds
    a third of all rows then fills many tasks, and an aggregation by group
    afterwards still combines map-side first. All other groups have one salt and one row. The salt depends on
    the row's content only, so a task that runs again gives the same rows. `heavy` are the large
    groups where the caller has looked for them already (`heavy_keys`).
    """
    if few_groups:
        return df.join(F.broadcast(table), list(keys))
    large = _hash(keys).isin(list(heavy_keys(df, keys) if heavy is None else heavy))
    zero = F.lit(0)
    salted = df.withColumn("_salt", F.when(large, F.pmod(F.xxhash64(*spread), F.lit(SALTS)).cast("int")).otherwise(zero))
    copies = table.withColumn("_salt", F.explode(F.when(large, F.sequence(zero, F.lit(SALTS - 1))).otherwise(F.array(zero))))
    return salted.join(copies, [*keys, "_salt"]).drop("_salt")


def value_counts(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Rows per group and distinct value (`_v`, `_k`); repeated values combine map-side."""
    return df.select(*keys, F.col(value).alias("_v")).groupBy(*keys, "_v").agg(F.count("*").alias("_k"))
