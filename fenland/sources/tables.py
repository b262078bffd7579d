"""Parquet tables and published warehouse versions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fenland.functions import dates
from fenland.operators import clustering
from fenland.plans.tables import Warehouse
from fenland.schemas import CLEAN, WAREHOUSE

# Partition column of a table, and the columns its files are clustered by: one column sorts them, several
# share a Z-order, so that a filter on any of them skips row groups by their minimum and maximum.
PARTITIONS = {"fact_house_price": "year", "fact_crime": "year", "fact_education": "academic_year"}
CLUSTERED_BY = {
    "fact_house_price": ["district_id", "postcode", "price"],
    "fact_crime": ["crime_type", "lsoa_code", "crime_date"],
    "fact_broadband": ["county_id", "postcode"],
    "fact_education": ["estab"],
    "fact_population": ["lsoa_code"],
    "dim_lsoa": ["county_id", "lsoa_code"],
    "dim_school": ["county_id", "estab"],
}
# Columns that are looked up by one value: row groups whose Bloom filter lacks it are skipped.
LOOKED_UP = {
    "fact_house_price": ["postcode"],
    "fact_crime": ["lsoa_code"],
    "fact_broadband": ["postcode"],
    "fact_education": ["estab"],
    "fact_population": ["lsoa_code"],
    "dim_lsoa": ["lsoa_code"],
    "dim_school": ["estab", "postcode"],
}


def write_table(
    df: DataFrame,
    path: str,
    partition: str | None = None,
    cluster: Sequence[str] = (),
    looked_up: Sequence[str] = (),
    *,
    row_group_rows: int | None = None,
) -> None:
    """Overwrite a Parquet table.

    Ranges of (partition value, cluster key) are the files, so a value that holds a large part of the
    rows is written by many tasks and each file covers a small part of the key. Without a
    cluster column the rebalance hint sizes the files alike.
    """
    first = [partition] if partition else []
    if len(cluster) > 1:
        columns = df.columns
        keyed = df.withColumn("_z", clustering.z_key(df, cluster))
        df = keyed.repartitionByRange(*first, "_z").sortWithinPartitions(*first, "_z", *cluster).select(*columns)
    elif cluster:
        df = df.repartitionByRange(*first, *cluster).sortWithinPartitions(*first, *cluster)
    elif partition:
        df = df.hint("rebalance", partition)
    writer = df.write.mode("overwrite")
    for column in looked_up:
        writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
    if row_group_rows:
        writer = writer.option("parquet.block.row.count.limit", row_group_rows)
    (writer.partitionBy(partition) if partition else writer).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """Overwrite a folder of CSV files with headers; dates as yyyy-MM-dd, nulls as NA."""
    days = {f.name: dates.iso_text(F.col(f"`{f.name}`")) for f in df.schema if isinstance(f.dataType, T.DateType)}
    df.withColumns(days).write.mode("overwrite").option("header", True).option("nullValue", "NA").option("escape", '"').csv(path)


def read_clean(spark: SparkSession, base: str, name: str) -> DataFrame:
    return spark.read.schema(CLEAN[name]).parquet(f"{base}/{name}")


def write_clean(df: DataFrame, base: str, name: str) -> None:
    df.select(*CLEAN[name].names).write.mode("overwrite").parquet(f"{base}/{name}")


def write_warehouse(tables: Mapping[str, DataFrame], base: str, version: int) -> None:
    """Write every table of a new version, then mark it published.

    Readers take the greatest published version, so they never see a half
    written one and a failed build leaves the old version in place.
    """
    for name in WAREHOUSE:
        write_table(tables[name], f"{base}/data/{version}/{name}", PARTITIONS.get(name), CLUSTERED_BY.get(name, ()), LOOKED_UP.get(name, ()))
    spark = next(iter(tables.values())).sparkSession
    mark = spark.range(1).select(F.lit(version).cast("long").alias("version"))
    mark.coalesce(1).write.mode("append").parquet(f"{base}/published")


def published_version(spark: SparkSession, base: str) -> int:
    marks = spark.read.schema("version LONG").parquet(f"{base}/published")
    return marks.agg(F.max("version")).first()[0]


def open_warehouse(spark: SparkSession, base: str, version: int | None = None) -> Warehouse:
    """The published warehouse; tables are read when used, with their declared schemas."""
    chosen = published_version(spark, base) if version is None else version

    def load(name: str) -> DataFrame:
        columns = WAREHOUSE[name].names
        return spark.read.schema(WAREHOUSE[name]).parquet(f"{base}/data/{chosen}/{name}").select(*columns)

    return Warehouse(load)
