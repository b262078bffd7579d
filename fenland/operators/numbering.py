"""Surrogate row numbers without a one-partition window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# A bucket is sorted by one task: at 10^12 rows it holds a million. Empty buckets cost nothing, so a small table pays
# for the buckets it fills; the offsets are one row per filled bucket, 2^20 at most.
BUCKETS = 2**20


def hash_bucket(*columns: str, buckets: int = BUCKETS) -> Column:
    """Even spread of distinct rows, always the same bucket for the same row."""
    return F.pmod(F.xxhash64(*columns), F.lit(buckets)).cast("int")


def number_rows(df: DataFrame, name: str, bucket: Column, order: Sequence[str], *, repeated: bool = False) -> DataFrame:
    """Dense numbers from 1 in the order (bucket, *order, the other columns).

    Rows go through one exchange by bucket; a window numbers them there, and the largest number of
    every bucket, taken from the same exchange, gives the offsets (Spark picks the join by their
    measured size). So the input is read once. The bucket depends on the row's content only: a
    task that runs again after a lost executor gives the same numbers. `repeated` is for tables in
    which a row may occur many times: equal rows are counted first and numbered as one.
    """
    columns = df.columns
    if repeated:
        df = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("_same"))
    else:
        df = df.withColumn("_same", F.lit(1).cast("long"))
    # every column orders the window and the bucket is never null, so both readers of the exchange ask for the same rows and share it
    rest = [c for c in columns if c not in order]
    inside = Window.partitionBy("_bucket").orderBy(*order, *rest).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = df.withColumn("_bucket", F.coalesce(bucket, F.lit(0))).withColumn("_last", F.sum("_same").over(inside))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy("_bucket")
        .agg(F.max("_last").alias("_n"))
        .select("_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    )
    last = F.col("_offset") + F.col("_last")
    number = F.explode(F.sequence(last - F.col("_same") + 1, last)) if repeated else last
    return placed.join(offsets, "_bucket").select(number.cast("long").alias(name) if not repeated else number.alias(name), *columns)
