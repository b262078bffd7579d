"""Wide, long and completed forms."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALTS = 64


def to_long(df: DataFrame, ids: Sequence[str], columns: Mapping[str, str], name: str, value: str) -> DataFrame:
    """One row per id and column; `columns` maps column -> label."""
    labelled = df.select(*ids, *[F.col(c).alias(label) for c, label in columns.items()])
    return labelled.unpivot(list(ids), list(columns.values()), name, value)


def to_wide(df: DataFrame, ids: Sequence[str], name: str, value: str, labels: Sequence[str]) -> DataFrame:
    """One column per label, in the given order; a missing combination is null."""
    wide = df.groupBy(*ids).pivot(name, list(labels)).agg(F.first(value, ignorenulls=True))
    return wide.select(*ids, *labels)


def complete(df: DataFrame, group: str, domain: str) -> DataFrame:
    """Add the missing (group, domain value) combinations with nulls elsewhere.

    The domain is a calendar (years present). The rows themselves are not moved: their pairs are
    counted map-side in one exchange, which also gives the groups and the domain, and only the pairs that
    no row has are added. All pairs come from an equi-join on a salt, for which every domain
    value is copied once per salt, so many groups are spread over many tasks.
    """
    # the count keeps the pairs an aggregate of its own, so all three readers share its exchange
    met = df.groupBy(group, domain).agg(F.count(F.lit(1)).alias("_n")).where("_n > 0")
    groups = met.select(group).distinct().withColumn("_salt", F.pmod(F.xxhash64(group), F.lit(SALTS)))
    copies = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("_salt")
    values = met.select(domain).distinct().select(domain, copies)
    pairs = groups.join(values, "_salt").select(F.col(group).alias("_group"), F.col(domain).alias("_value"))
    same = F.col("_group").eqNullSafe(F.col(group)) & F.col("_value").eqNullSafe(F.col(domain))
    missing = pairs.join(met, same, "left_anti")
    kinds = dict(df.dtypes)
    blank = [F.col("_group").alias(c) if c == group else F.col("_value").alias(c) if c == domain else F.lit(None).cast(kinds[c]).alias(c) for c in df.columns]
    return df.union(missing.select(*blank))


def frequency(df: DataFrame, *columns: str, name: str = "n") -> DataFrame:
    """Rows per value combination."""
    return df.groupBy(*columns).agg(F.count("*").alias(name))


def cross_tab(df: DataFrame, row: str, column: str, labels: Sequence[str]) -> DataFrame:
    """Counts of row value x column label; zero where a combination is missing."""
    cells = [F.count_if(F.col(column) == label).alias(label) for label in labels]
    return df.groupBy(row).agg(*cells)


def with_bounds_rows(df: DataFrame, key: str, columns: Sequence[str], headroom: float = 1.1) -> DataFrame:
    """The frame and two rows more: axis maximum (`ceil(max * headroom)`) and zero; an empty frame has no rows.

    Rows and maximum come from one pass: the grouping sets (row) and (), both combined map-side.
    """
    sets = df.select(F.col(key).cast("string").alias(key), *[F.col(c).cast("double").alias(c) for c in columns])
    tops = [F.max(c).alias(f"_top{k}") for k, c in enumerate(columns)]
    found = sets.groupingSets([[key, *columns], []], key, *columns).agg(F.grouping_id().alias("_set"), F.count(F.lit(1)).alias("_same"), *tops)

    def row(label: str, value: Column) -> Column:
        return F.struct(F.lit(label).alias(key), *[value.alias(c) for c in columns])

    top = F.ceil(F.greatest(F.lit(None).cast("double"), *[F.col(f"_top{k}") for k in range(len(columns))]) * headroom).cast("double")
    ends = F.array(row("axis_max", top), row("axis_min", F.lit(0.0)))
    same = F.array_repeat(F.struct(key, *columns), F.col("_same").cast("int"))
    return found.select(F.explode(F.when(F.col("_set") == 0, same).otherwise(ends)).alias("_row")).select("_row.*")
