"""Data profiling and checks; each is a DataFrame or a job that raises."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from fenland.operators.quantiles import group_quantiles


def missing_counts(df: DataFrame, *columns: str) -> DataFrame:
    """Number of nulls per column, from one pass."""
    names = list(columns or df.columns)
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in names])
    return counts.unpivot([], names, "column_name", "missing")


def column_summary(df: DataFrame, *columns: str) -> DataFrame:
    """Minimum, quartiles, mean, maximum and null count per numeric column."""
    doubles = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    stacked = doubles.unpivot([], list(columns), "column_name", "value")
    extra = [
        F.min("value").alias("minimum"),
        F.avg("value").alias("mean"),
        F.max("value").alias("maximum"),
        F.count_if(F.col("value").isNull()).alias("missing"),
    ]
    quartiles = {"q1": 0.25, "median": 0.5, "q3": 0.75}
    # one group per column of the frame: few by construction
    out = group_quantiles(stacked, ["column_name"], "value", quartiles, extra, few_groups=True)
    return out.select("column_name", "minimum", "q1", "median", "mean", "q3", "maximum", "missing")


def shape(df: DataFrame) -> DataFrame:
    """Row and column counts."""
    return df.agg(F.count("*").alias("row_count")).withColumn("column_count", F.lit(len(df.columns)).cast("long"))


def table_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Row count of every table."""
    counts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n") for name, df in tables.items()]
    out = counts[0]
    for more in counts[1:]:
        out = out.union(more)
    return out


def unparsed_sample(df: DataFrame, raw: str, parsed: str, n: int = 5) -> DataFrame:
    """Up to n distinct raw values that did not parse."""
    return df.where(F.col(parsed).isNull()).select(raw).distinct().orderBy(raw).limit(n)


def unparsed_count(df: DataFrame, parsed: str) -> DataFrame:
    return df.agg(F.count_if(F.col(parsed).isNull()).alias("unparsed"), F.count("*").alias("total"))


def counted(df: DataFrame, name: str, **conditions: Column) -> tuple[DataFrame, Observation]:
    """The frame with counters on it, read after the job that uses it; no extra pass."""
    watch = Observation(name)
    counters = [F.count_if(condition).alias(label) for label, condition in conditions.items()]
    return df.observe(watch, F.count("*").alias("rows"), *counters), watch


def require_values(df: DataFrame, column: str, message: str) -> DataFrame:
    """The frame; reading a row with a null in `column` fails the job."""
    checked = F.when(F.col(column).isNull(), F.raise_error(F.lit(message)).cast("string")).otherwise(F.col(column))
    return df.withColumn(column, checked)


def require_columns(found: Sequence[str], wanted: Mapping[str, str | None], where: str) -> None:
    """Raise when a required column has no header name in the file."""
    lacking = [name for name, header in wanted.items() if header is None]
    if lacking:
        raise ValueError(f"{where} has no column for {', '.join(lacking)}; it has {', '.join(found)}")
