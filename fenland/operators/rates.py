"""Rates and shares."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fenland.functions.numbers import rate_per_100k, safe_ratio


def two_level_rate(
    counts: DataFrame, population: DataFrame, area: str, keys: Sequence[str], count: str, total: str, rate: str
) -> DataFrame:
    """Events per 100,000 people of each group of areas.

    `counts` holds one row per area with its event count and the group `keys`;
    only areas with events and a positive population enter the denominator.
    """
    return (
        counts.join(population.select(area, "population"), area, "left")
        .where("population > 0")
        .groupBy(*keys)
        .agg(F.sum(count).alias(total), F.sum("population").alias("total_population"))
        .withColumn(rate, rate_per_100k(F.col(total), F.col("total_population")))
    )


def all_area_rate(
    counts: DataFrame, population_by_group: DataFrame, keys: Sequence[str], count: str, total: str, rate: str
) -> DataFrame:
    """Like `two_level_rate`, over the population of all areas of a group, with or without events."""
    return (
        counts.groupBy(*keys)
        .agg(F.sum(count).alias(total))
        .join(population_by_group, list(keys), "left")
        .where("total_population > 0")
        .withColumn(rate, rate_per_100k(F.col(total), F.col("total_population")))
    )


def share_of_total(df: DataFrame, value: str, name: str) -> DataFrame:
    """Percentage of the column total; the total is a scalar sub-query, no one-partition window."""
    total = df.agg(F.sum(value)).scalar()
    return df.withColumn(name, safe_ratio(F.col(value), total) * 100.0)
