"""The two batch jobs a user schedules: clean the raw files, build the warehouse."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from fenland.operators import profile
from fenland.plans import building, cleaning
from fenland.plans.tables import Warehouse
from fenland.schemas import CRIME_COLUMNS, POSITION, schema
from fenland.sources import tables


@dataclass(frozen=True)
class RawInput:
    """Where the raw files are."""

    prices: str
    broadband: Sequence[str]
    crime: str
    schools: Mapping[str, str]
    population: str


def clean_all(spark: SparkSession, raw: RawInput, base: str) -> dict[str, tuple[int, int]]:
    """Write the six clean tables and both forces' merged raw crime rows below `base`.

    The answer has the rows read and the rows kept of each table, counted by the jobs that write them.
    """
    counts: dict[str, tuple[int, int]] = {}

    def write(name: str, rows: DataFrame, clean: Callable[[DataFrame], DataFrame]) -> None:
        read, before = profile.counted(rows, f"{name} read")
        kept, after = profile.counted(clean(read), f"{name} kept")
        tables.write_clean(kept, base, name)
        counts[name] = (before.get["rows"], after.get["rows"])

    write("house_price_clean", cleaning.read_house_price(spark, raw.prices), cleaning.clean_house_price)
    write("broadband_clean", cleaning.read_broadband(spark, raw.broadband), cleaning.clean_broadband)
    for force in ("norfolk", "suffolk"):
        merged = f"{base}/{force}_all"
        cleaning.read_crime(spark, raw.crime, force).write.mode("overwrite").parquet(merged)
        rows = spark.read.schema(schema(**dict.fromkeys(CRIME_COLUMNS.values(), "string"), **POSITION)).parquet(merged)
        write(f"{force}_clean", rows, cleaning.clean_crime)
    write("education_clean", cleaning.read_education(spark, raw.schools), cleaning.clean_education)
    write("population_clean", cleaning.read_population(spark, raw.population), cleaning.clean_population)
    return counts


def build_and_publish(spark: SparkSession, clean_base: str, base: str, version: int, **options) -> Warehouse:
    """Build all nine tables from the clean ones, publish them as a version, return the published tables."""
    built = building.build_warehouse(spark, lambda name: tables.read_clean(spark, clean_base, name), **options)
    tables.write_warehouse(built.tables(), base, version)
    return tables.open_warehouse(spark, base)


def load_education_years(spark: SparkSession, files: Mapping[str, str], base: str) -> None:
    """Write the multi-year school table; the warehouse's own school facts stay as they are."""
    tables.write_table(
        cleaning.load_education_years(spark, files), f"{base}/education_all_years", "academic_year", ["estab"]
    )
