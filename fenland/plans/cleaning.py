"""Raw files -> clean tables.

Every `read_*` returns the raw rows as text, every `clean_*` is a function from
a raw frame to a clean frame.
"""

from __future__ import annotations

import re
import warnings
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fenland import schemas
from fenland.fixed_values import (
    ACADEMIC_YEAR_PATTERN,
    COUNTIES,
    PRICE_FILES,
    SCHOOL_COLUMN_NAMES,
    SCHOOL_FILES,
    SCHOOL_RECORD_TYPES,
    SUPPRESSED_PUPILS,
    SUPPRESSED_SCORES,
)
from fenland.functions import dates, geography, text
from fenland.functions.numbers import to_number
from fenland.operators import dedup, lookup, profile
from fenland.sources import csv_files

# ---- house prices --------------------------------------------------------


def read_house_price(spark: SparkSession, folder: str, glob: str = PRICE_FILES) -> DataFrame:
    """All yearly price files of a folder in one scan."""
    return csv_files.read_plain(spark, folder, schemas.PRICE_RAW, glob)


def clean_house_price(raw: DataFrame) -> DataFrame:
    """Typed, trimmed, covered counties only, without duplicates.

    The transaction id is left out before duplicates are removed, so sales that
    agree in every kept column count once.
    """
    # any letter case of a covered county; on the raw column, before the costly text work, which would be done twice otherwise
    counties = [name.lower() for _, name in COUNTIES]
    return (
        raw.where(F.lower("county").isin(*counties) & F.col("district").isNotNull())
        .where(text.not_blank(F.col("postcode")))
        .select(
            dates.iso_date(F.col("date")).alias("date"),
            text.trim_all(F.upper("postcode")).alias("postcode"),
            text.title_case(F.col("town")).alias("town"),
            text.title_case(F.col("district")).alias("district"),
            text.title_case(F.col("county")).alias("county"),
            to_number(F.col("price")).alias("price"),
        )
        .withColumn("year", F.year("date"))
        .where("price IS NOT NULL AND date IS NOT NULL")
        .distinct()
    )


# ---- broadband -----------------------------------------------------------


def read_broadband(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    return csv_files.read_by_name(spark, paths, schemas.SPEED_COLUMNS)


def clean_broadband(raw: DataFrame) -> DataFrame:
    """Postcodes of the covered areas with both speeds, without duplicate rows; each with its first position."""
    postcode = text.squish(F.upper("postcode"))
    rows = (
        raw.select(
            postcode.alias("postcode"),
            to_number(F.col("avg_speed")).alias("avg_speed"),
            to_number(F.col("max_speed")).alias("max_speed"),
            *csv_files.FILE_ORDER,
        )
        .withColumn("county", geography.county_of_postcode(F.col("postcode")))
        .where("county IS NOT NULL AND avg_speed IS NOT NULL AND max_speed IS NOT NULL")
        .where(text.has_text(F.col("postcode")))
    )
    return dedup.distinct_first(rows, csv_files.FILE_ORDER)


# ---- crime ---------------------------------------------------------------


def read_crime(spark: SparkSession, folder: str, force: str) -> DataFrame:
    """All monthly files of one force, from any depth below the folder."""
    paths = csv_files.list_files(spark, folder, f"*{force}*.csv", recursive=True)
    return csv_files.read_by_name(spark, paths, schemas.CRIME_COLUMNS)


def clean_crime(raw: DataFrame) -> DataFrame:
    """Typed, trimmed, with place and type, without duplicates; each with its first position.

    Events carry no id, so equal rows count once.
    """
    # the filters test the raw text: each is equal to testing the cleaned value, without computing it twice
    usable = dates.is_month(F.col("month"))
    for name in ("lsoa_code", "lsoa_name", "crime_type"):
        usable = usable & text.not_blank(F.col(name))
    rows = (
        raw.where(usable)
        .select(
            dates.month_start(F.col("month")).alias("month"),
            text.squish(F.col("reported_by")).alias("reported_by"),
            text.squish(F.col("police_force")).alias("police_force"),
            F.upper(text.trim_all(F.col("lsoa_code"))).alias("lsoa_code"),
            text.squish(F.col("lsoa_name")).alias("lsoa_name"),
            text.title_case(text.squish(F.col("crime_type"))).alias("crime_type"),
            text.or_default(F.col("outcome"), "Unknown").alias("outcome"),
            *csv_files.FILE_ORDER,
        )
        .withColumn("year", F.year("month"))
    )
    return dedup.distinct_first(rows, csv_files.FILE_ORDER)


# ---- schools -------------------------------------------------------------


def read_education(spark: SparkSession, folders: Mapping[str, str]) -> DataFrame:
    """School result files of each county (county -> folder), with county and academic year."""
    frames = []
    for county, folder in folders.items():
        paths = csv_files.list_files(spark, folder, SCHOOL_FILES[county])
        if paths:
            frames.append(read_education_files(spark, paths, county))
    if not frames:
        raise ValueError("no school file found")
    return lookup.union_by_name(*frames)


def read_education_files(spark: SparkSession, paths: Sequence[str], county: str) -> DataFrame:
    """School files given by path; the academic year comes from each file name."""
    unnamed = [path for path in paths if not re.match(ACADEMIC_YEAR_PATTERN, path.rsplit("/", 1)[-1])]
    if unnamed:
        raise ValueError(f"no academic year in the file name: {', '.join(unnamed)}")
    year = F.regexp_substr(csv_files.file_name(), F.lit(ACADEMIC_YEAR_PATTERN))
    raw = csv_files.read_by_name(spark, paths, schemas.SCHOOL_COLUMNS)
    raw = raw.withColumns({"county": F.lit(county), "academic_year": year})
    return profile.require_values(raw, "academic_year", "no academic year in the file name")


def clean_education(raw: DataFrame) -> DataFrame:
    """School rows with name and town; the first row in file order per school, county and year."""
    rows = raw.select(
        "lea_code",
        "estab",
        text.trim_all(F.col("school_name")).alias("school_name"),
        text.trim_all(F.col("town")).alias("town"),
        text.trim_all(F.col("postcode")).alias("postcode"),
        to_number(text.null_if_any(F.col("total_pupils"), *SUPPRESSED_PUPILS)).alias("total_pupils"),
        to_number(text.null_if_any(F.col("att8_score"), *SUPPRESSED_SCORES)).alias("att8_score"),
        "county",
        "academic_year",
        "rectype",
        *csv_files.FILE_ORDER,
    )
    kept = (
        rows.where(F.col("rectype").isin(*SCHOOL_RECORD_TYPES))
        .where(text.has_text(F.col("school_name")) & text.has_text(F.col("town")))
        .drop("rectype")
    )
    first = dedup.first_rows(kept, ["estab", "county", "academic_year"], csv_files.FILE_ORDER)
    return first.drop(*csv_files.FILE_ORDER)


# ---- population ----------------------------------------------------------


def read_population(spark: SparkSession, path: str, banner_lines: int = 3) -> DataFrame:
    """CSV export of the population sheet."""
    return csv_files.read_below_banner(spark, path, schemas.POPULATION_COLUMNS, banner_lines)


def clean_population(raw: DataFrame) -> DataFrame:
    """One row per area with a numeric population; the first in file order."""
    rows = raw.select(
        text.trim_all(F.col("lsoa_code")).alias("lsoa_code"),
        text.trim_all(F.col("lsoa_name")).alias("lsoa_name"),
        to_number(F.col("population")).alias("population"),
        *csv_files.FILE_ORDER,
    ).where(text.has_text(F.col("lsoa_code")) & F.col("population").isNotNull())
    return dedup.first_rows(rows, ["lsoa_code"], csv_files.FILE_ORDER).drop(*csv_files.FILE_ORDER)


# ---- yearly school files with changing headers ---------------------------


def read_education_year(spark: SparkSession, path: str, academic_year: str) -> DataFrame | None:
    """One year's file; each column under the first known header name, null where the file has none."""
    if not csv_files.exists(spark, path):
        warnings.warn(f"no file for {academic_year}: {path}, year left out", stacklevel=2)
        return None
    header = csv_files.header_of(spark, path)
    scan = csv_files.reader(spark, header=True).schema(schemas.text_schema(*header)).csv(path)
    return education_year_rows(scan, academic_year, path)


def education_year_rows(scan: DataFrame, academic_year: str, where: str) -> DataFrame:
    """Rows with a score under the known names, whatever names the scan's columns have among those of any year."""
    header = scan.columns
    found = {name: csv_files.first_present(header, known) for name, known in SCHOOL_COLUMN_NAMES.items()}
    profile.require_columns(header, {name: found[name] for name in ("estab", "att8_score")}, where)
    columns = [F.col(f"`{raw}`").alias(name) if raw else F.lit(None).cast("string").alias(name) for name, raw in found.items()]
    return (
        scan.select(*columns)
        .withColumn("att8_score", to_number(F.col("att8_score")))
        .withColumn("academic_year", F.lit(academic_year))
        .where("att8_score IS NOT NULL")
    )


def load_education_years(spark: SparkSession, files: Mapping[str, str]) -> DataFrame:
    """All years that have a file (academic year -> path), schools of the covered counties only."""
    years = [read_education_year(spark, path, year) for year, path in files.items()]
    years = [df for df in years if df is not None]
    if not years:
        raise ValueError("no school file found")
    return merge_education_years(years)


def merge_education_years(years: Sequence[DataFrame]) -> DataFrame:
    """All years' rows with their county, those of other counties left out."""
    rows = lookup.union_by_name(*years)
    rows = rows.withColumn("county_name", geography.county_of_authority(F.col("la_name")))
    return rows.where("county_name IS NOT NULL").select(*schemas.EDUCATION_ALL_YEARS.names)
