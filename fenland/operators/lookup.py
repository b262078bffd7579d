"""Lookups, key checks, set operations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def attach(df: DataFrame, lookup: DataFrame, column: str, lookup_column: str, *, fixed_size: bool = False) -> DataFrame:
    """Left join on keys of different names; the lookup key is dropped.

    `fixed_size` states that the lookup is one of the fixed tables (counties,
    districts, towns, months) and may be broadcast.
    """
    right = lookup.withColumnRenamed(lookup_column, "_key")
    right = F.broadcast(right) if fixed_size else right
    return df.join(right, df[column] == right["_key"], "left").drop("_key")


def keep_known(df: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """Rows whose key occurs in `keys`."""
    return df.join(keys.select(column).distinct(), column, "left_semi")


def orphan_count(fact: DataFrame, dim: DataFrame, key: str, dim_key: str | None = None) -> DataFrame:
    """Number of fact rows without a dimension row; a null key has none.

    Rows are counted per key first, so the anti join sees each key once and a
    frequent key cannot overload one task.
    """
    per_key = fact.groupBy(F.col(key).alias("_key")).agg(F.count("*").alias("_n"))
    known = dim.select(F.col(dim_key or key).alias("_key"))
    return per_key.join(known, "_key", "left_anti").agg(
        F.coalesce(F.sum("_n"), F.lit(0)).cast("long").alias("orphans")
    )


def orphan_counts(checks: Mapping[str, tuple[DataFrame, DataFrame, str]], name: str) -> DataFrame:
    """(name, orphans) of several checks label -> (fact, dimension, key): fact rows without a dimension row.

    All facts' keys are counted in one exchange and meet the keys of all dimensions in one join, each
    dimension read once however many facts refer to it; a null key has no dimension row, and
    a frequent key is one row. A fact without rows has 0.
    """
    dims: dict[tuple[int, str], DataFrame] = {}
    counts, bases = [], []
    for label, (fact, dim, key) in checks.items():
        place = next((k for k, (other, column) in enumerate(dims.values()) if other is dim and column == key), len(dims))
        dims.setdefault((place, key), (dim, key))
        row = [F.lit(label).alias(name), F.lit(place).alias("_dim"), F.col(key).cast("string").alias("_key"), F.lit(1).cast("long").alias("_n")]
        counts.append(fact.select(*row))
        bases.append(label)
    keys = [dim.select(F.lit(place).alias("_dim"), F.col(key).cast("string").alias("_key")) for (place, _), (dim, key) in dims.items()]
    known = union_by_name(*keys).where("_key IS NOT NULL").distinct().withColumn("_known", F.lit(True))
    met = union_by_name(*counts).groupBy(name, "_dim", "_key").agg(F.sum("_n").alias("_n")).join(known, ["_dim", "_key"], "left")
    lost = F.coalesce(F.sum(F.when(F.col("_known").isNull(), F.col("_n"))), F.lit(0)).cast("long")
    found = met.groupBy(name).agg(lost.alias("_lost"))
    labels = known.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, bases))).alias(name))
    return labels.join(found, name, "left").select(name, F.coalesce("_lost", F.lit(0).cast("long")).alias("orphans"))


def match_rate(df: DataFrame, column: str) -> DataFrame:
    """Rows with a value, and all rows."""
    return df.agg(F.count_if(F.col(column).isNotNull()).alias("matched"), F.count("*").alias("total"))


def union_by_name(*frames: DataFrame) -> DataFrame:
    """All rows of all frames; columns a frame lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def common_values(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """Values present on both sides, each once.

    `intersect` alone joins all rows of a value in one task and removes duplicates afterwards; so each
    side is reduced to its values first, map-side.
    """
    return a.select(column).distinct().intersect(b.select(column).distinct())


def sorted_values(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*columns).distinct().orderBy(*columns)


def preview(df: DataFrame, order: Sequence[str], n: int = 10) -> DataFrame:
    """First rows in a declared order (a top-n plan, not a full sort)."""
    return df.orderBy(*order).limit(n)
