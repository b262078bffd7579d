"""Group statistics, box statistics, quantile trim."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fenland.operators.group_join import join_group_table, large_groups
from fenland.operators.quantiles import box_counts, first_pass, group_quantiles, small_group_quantiles, wanted_ranks


def mean_and_count(df: DataFrame, keys: Sequence[str], value: str, mean: str, count: str) -> DataFrame:
    """Mean of the present values and number of all rows per group."""
    return df.groupBy(*keys).agg(F.avg(value).alias(mean), F.count("*").alias(count))


def group_statistics(
    df: DataFrame, keys: Sequence[str], value: str, suffix: str, *, few_groups: bool = False, small_groups: bool = False
) -> DataFrame:
    """mean, median, standard deviation (n - 1), minimum, maximum and row count per group."""
    extra = [
        F.avg(value).alias(f"mean_{suffix}"),
        F.stddev_samp(value).alias(f"sd_{suffix}"),
        F.min(value).alias(f"min_{suffix}"),
        F.max(value).alias(f"max_{suffix}"),
        F.count("*").alias("n"),
    ]
    median = {f"median_{suffix}": 0.5}
    stats = _quantiles(df, keys, value, median, extra, few_groups, small_groups)
    names = ("mean", "median", "sd", "min", "max")
    return stats.select(*keys, *[f"{name}_{suffix}" for name in names], "n")


def rounded_statistics(df: DataFrame, keys: Sequence[str], value: str, *, few_groups: bool = False) -> DataFrame:
    """Mean, median, maximum and minimum, rounded half to even to two digits."""
    stats = group_statistics(df, keys, value, "value", few_groups=few_groups)
    names = {"mean_value": "mean", "median_value": "median", "max_value": "maximum", "min_value": "minimum"}
    return stats.select(*keys, *[F.bround(old, 2).alias(new) for old, new in names.items()])


def box_statistics(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    *,
    min_rows: int = 0,
    few_groups: bool = False,
    small_groups: bool = False,
) -> DataFrame:
    """Quartiles, whiskers (most extreme values within 1.5 box lengths), outlier count, row count.

    Groups of fewer than `min_rows` rows are left out. The rows are read twice, once for the
    brackets and once for quartiles, fences and whiskers together.
    """
    quartiles = [("q1", 0.25), ("median", 0.5), ("q3", 0.75)]
    if small_groups:
        return _small_boxes(df, keys, value, dict(quartiles), min_rows)
    first = first_pass(df, keys, value, [p for _, p in quartiles], [F.count(F.lit(1)).alias("n")])
    counted = box_counts(df, keys, value, first, few_groups=few_groups)
    boxes = wanted_ranks(counted.select(*keys, "_cell", "_v", "_k"), keys, quartiles).join(first.select(*keys, "n"), list(keys))
    boxes = _with_fences(boxes, min_rows)
    heavy = None if few_groups else large_groups(first, keys, "_rows")
    near = "_v >= low_fence AND _v <= high_fence"
    inside = f"_region = 2 OR (_region IN (1, 3) AND {near})"
    return (
        join_group_table(counted.where("_region IS NOT NULL"), boxes, keys, ["_cell", "_v"], few_groups=few_groups, heavy=heavy)
        .groupBy(*keys, "q1", "median", "q3", "n")
        .agg(
            F.expr(f"min(CASE WHEN {inside} THEN _lo END)").alias("lower_whisker"),
            F.expr(f"max(CASE WHEN {inside} THEN _hi END)").alias("upper_whisker"),
            F.expr(f"coalesce(sum(CASE WHEN NOT ({inside}) THEN _k END), 0L)").alias("outliers"),
        )
        .select(*keys, "lower_whisker", "q1", "median", "q3", "upper_whisker", "outliers", "n")
    )


def _with_fences(boxes: DataFrame, min_rows: int) -> DataFrame:
    if min_rows:
        boxes = boxes.where(F.col("n") >= min_rows)
    return boxes.where("q1 IS NOT NULL").withColumns(
        {"low_fence": F.expr("q1 - 1.5 * (q3 - q1)"), "high_fence": F.expr("q3 + 1.5 * (q3 - q1)")}
    )


def _small_boxes(df: DataFrame, keys: Sequence[str], value: str, quartiles: dict[str, float], min_rows: int) -> DataFrame:
    """The same with the built-in aggregate, for groups of provably few rows."""
    boxes = _with_fences(small_group_quantiles(df, keys, value, quartiles, [F.count("*").alias("n")]), min_rows)
    near = f"`{value}` >= low_fence AND `{value}` <= high_fence"
    return (
        join_group_table(df.select(*keys, value), boxes, keys, [value], few_groups=True)
        .groupBy(*keys, "q1", "median", "q3", "n")
        .agg(
            F.expr(f"min(CASE WHEN {near} THEN `{value}` END)").alias("lower_whisker"),
            F.expr(f"max(CASE WHEN {near} THEN `{value}` END)").alias("upper_whisker"),
            F.expr(f"count_if(NOT ({near}))").alias("outliers"),
        )
        .select(*keys, "lower_whisker", "q1", "median", "q3", "upper_whisker", "outliers", "n")
    )


def box_outliers(
    df: DataFrame, keys: Sequence[str], value: str, boxes: DataFrame, *, few_groups: bool = False
) -> DataFrame:
    """The rows beyond the whiskers of `boxes`, the points a box plot draws one by one."""
    limits = boxes.select(*keys, "lower_whisker", "upper_whisker")
    joined = join_group_table(df.select(*keys, value), limits, keys, [value], few_groups=few_groups)
    beyond = (F.col(value) < F.col("lower_whisker")) | (F.col(value) > F.col("upper_whisker"))
    return joined.where(beyond).select(*keys, value)


def trim_top(df: DataFrame, value: str, p: float = 0.99) -> DataFrame:
    """Rows with a positive value below the p-quantile.

    The quantile is taken over all rows, also those that are not positive.
    """
    cut = group_quantiles(df, [], value, {"_cut": p}).first()
    # one number: as a literal it reaches the scan of every later reader
    return df.where((F.col(value) > 0) & (F.col(value) < F.lit(cut["_cut"] if cut else None).cast("double")))


def _quantiles(df, keys, value, probs, extra, few_groups, small_groups):
    if small_groups:
        return small_group_quantiles(df, keys, value, probs, extra)
    return group_quantiles(df, keys, value, probs, extra, few_groups=few_groups)
