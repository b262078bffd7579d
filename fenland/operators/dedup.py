"""Duplicate removal."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def distinct_rows(df: DataFrame, *columns: str) -> DataFrame:
    """Distinct rows, of the named columns if any are given."""
    return (df.select(*columns) if columns else df).distinct()


def distinct_first(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """Distinct rows of the columns outside `order`, each with the smallest `order` it occurs at.

    A position lives through the removal of duplicates this way, so a later step can still take
    the row that came first. The minimum is combined map-side like the grouping itself; a minimum over
    a struct is grouped by sorting, and the hash in front settles almost every comparison of the sort.
    """
    content = [c for c in df.columns if c not in order]
    grouped = df.groupBy(F.xxhash64(*content).alias("_hash"), *content)
    return grouped.agg(F.min(F.struct(*order)).alias("_at")).select(*content, "_at.*")


def first_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key in the declared order.

    The order must be total up to equal rows. A minimum over a struct is
    combined map-side, so a key that holds a large part of the rows sends one
    row per task instead of filling one window partition.
    """
    rest = [c for c in df.columns if c not in keys]
    ordered = [c for c in order if c not in keys]
    tail = [c for c in rest if c not in ordered]
    first = df.groupBy(*keys).agg(F.min(F.struct(*ordered, *tail)).alias("_first"))
    return first.select(*keys, "_first.*").select(*df.columns)


def top_row(df: DataFrame, keys: Sequence[str], weight: str, tie_break: Sequence[str]) -> DataFrame:
    """The row of each key with the greatest weight; ties go to the smallest `tie_break`."""
    rest = [c for c in df.columns if c not in (*keys, weight, *tie_break)]
    best = df.groupBy(*keys).agg(
        F.min(F.struct((-F.col(weight)).alias("_w"), *tie_break, weight, *rest)).alias("_best")
    )
    return best.select(*keys, "_best.*").select(*df.columns)


def duplicate_count(df: DataFrame, *keys: str) -> DataFrame:
    """Number of rows that repeat an earlier key; counts per key combine before the shuffle."""
    per_key = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    return per_key.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).cast("long").alias("duplicates"))


def distinct_count(df: DataFrame, *columns: str, name: str = "n_distinct", approximate: bool = False) -> DataFrame:
    if approximate:
        value = columns[0] if len(columns) == 1 else F.struct(*columns)
        return df.agg(F.approx_count_distinct(value).alias(name))
    return df.agg(F.count_distinct(*columns).alias(name))
