"""Clean tables -> warehouse tables, and the checks on them."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fenland import literal_tables
from fenland.functions import dates, geography
from fenland.operators import dedup, lookup, numbering, profile
from fenland.plans.tables import Warehouse
from fenland.schemas import WAREHOUSE
from fenland.sources.csv_files import FILE_ORDER

# Day/month/year orders tried for a crime month that is still text; the values of the column rank them.
MONTH_ORDERS = {"Norfolk": ["mdy", "ymd", "dmy"], "Suffolk": ["ymd", "mdy", "dmy"]}


def dated_crime(clean: DataFrame, county: str) -> DataFrame:
    """Crime rows of one force with `crime_date` (null where the month text does not parse)."""
    month = F.col("month")
    if isinstance(clean.schema["month"].dataType, T.StringType):
        month = dates.mixed_date(month, dates.trained_orders(clean, "month", MONTH_ORDERS[county]))
    return clean.withColumns({"crime_date": month.cast("date"), "source_county": F.lit(county)})


def combined_crime(norfolk: DataFrame, suffolk: DataFrame) -> DataFrame:
    """Both forces' rows with a date, the district in the area name and the boundary flag."""
    rows = lookup.union_by_name(dated_crime(norfolk, "Norfolk"), dated_crime(suffolk, "Suffolk"))
    return (
        rows.where("crime_date IS NOT NULL")
        .drop("month")
        .withColumn("year", F.year("crime_date"))
        .withColumn("lsoa_district", geography.lsoa_district(F.col("lsoa_name")))
        .withColumn("in_boundary", geography.inside_boundary(F.col("source_county"), F.col("lsoa_district")))
    )


def build_warehouse(
    spark: SparkSession,
    clean: Callable[[str], DataFrame],
    *,
    school_code: str = "estab",
    postcode_order: Sequence[str] = FILE_ORDER,
    buckets: int = numbering.BUCKETS,
) -> Warehouse:
    """The nine tables from the six clean ones (`clean(name)` returns a clean table).

    `school_code` says what identifies a school. `estab` alone is used in both
    counties, and dim_school then keeps the first county; `lea_estab` puts the
    authority code in front and keeps such schools apart. Of several spellings of a
    postcode and several names of an area the first in raw file order stays. `buckets` spreads the
    numbering of the facts; a bucket is sorted by one task. A clean table is asked for when a table needs it.
    """
    if school_code not in ("estab", "lea_estab"):
        raise ValueError(f"unknown school code: {school_code}")
    counties = literal_tables.county_table(spark)
    districts = literal_tables.district_table(spark)

    @cache
    def crime() -> DataFrame:
        return combined_crime(clean("norfolk_clean"), clean("suffolk_clean"))

    def with_county_id(df: DataFrame, county: str) -> DataFrame:
        return lookup.attach(df, counties, county, "county_name", fixed_size=True)

    def keyed(df: DataFrame) -> DataFrame:
        return df.withColumn("postcode_key", geography.postcode_key(F.col("postcode")))

    def schools_and_scores() -> DataFrame:
        rows = keyed(clean("education_clean"))
        if school_code == "lea_estab":
            rows = rows.withColumn("estab", F.concat("lea_code", "estab"))
        return rows

    def dim_lsoa() -> DataFrame:
        names = crime().select("lsoa_code", "lsoa_name", "source_county", *FILE_ORDER)
        return with_county_id(dedup.first_rows(names, ["lsoa_code"], ["source_county", *FILE_ORDER]), "source_county")

    def dim_school() -> DataFrame:
        schools = schools_and_scores().select(
            "estab", "school_name", "town", F.col("postcode_key").alias("postcode"), "county", "academic_year"
        )
        order = ["county", "academic_year", "school_name", "town", "postcode"]
        return with_county_id(dedup.first_rows(schools, ["estab"], order), "county")

    def fact_population() -> DataFrame:
        # dim_lsoa has exactly the area codes of the crime rows
        return lookup.keep_known(clean("population_clean"), crime(), "lsoa_code")

    def fact_house_price() -> DataFrame:
        sales = lookup.attach(
            keyed(clean("house_price_clean")),
            districts.select("district_id", "district_name"),
            "district",
            "district_name",
            fixed_size=True,
        ).where("district_id IS NOT NULL")
        numbered = numbering.number_rows(
            sales,
            "transaction_pk",
            numbering.hash_bucket("date", "postcode", "town", "district", "price", buckets=buckets),
            ["date", "postcode", "town", "district", "price"],
        )
        return numbered.withColumn("postcode", F.col("postcode_key"))

    def fact_broadband() -> DataFrame:
        speeds = dedup.first_rows(keyed(clean("broadband_clean")), ["postcode_key"], list(postcode_order))
        return with_county_id(speeds, "county").withColumn("postcode", F.col("postcode_key"))

    def fact_crime() -> DataFrame:
        content = ["crime_date", "lsoa_code", "lsoa_name", "crime_type", "outcome", "reported_by", "police_force", "source_county"]
        return numbering.number_rows(crime().drop(*FILE_ORDER), "crime_pk", numbering.hash_bucket(*content, buckets=buckets), content)

    def fact_education() -> DataFrame:
        content = ["county", "academic_year", "estab"]
        return numbering.number_rows(schools_and_scores(), "education_pk", numbering.hash_bucket(*content, buckets=buckets), content)

    makers = {
        "dim_county": lambda: counties,
        "dim_district": lambda: districts,
        "dim_lsoa": dim_lsoa,
        "dim_school": dim_school,
        "fact_population": fact_population,
        "fact_house_price": fact_house_price,
        "fact_broadband": fact_broadband,
        "fact_crime": fact_crime,
        "fact_education": fact_education,
    }
    return Warehouse(lambda name: makers[name]().select(*WAREHOUSE[name].names))


# ---- checks --------------------------------------------------------------


def orphan_report(w: Warehouse) -> DataFrame:
    """Fact rows without a dimension row, per checked fact."""
    checks = {
        "fact_house_price": (w.fact_house_price, w.dim_district, "district_id"),
        "fact_crime": (w.fact_crime, w.dim_lsoa, "lsoa_code"),
        "fact_population": (w.fact_population, w.dim_lsoa, "lsoa_code"),
        "fact_education": (w.fact_education, w.dim_school, "estab"),
    }
    return lookup.orphan_counts(checks, "fact")


def size_report(w: Warehouse) -> DataFrame:
    return profile.table_counts(w.tables())


def school_orphans(all_years: DataFrame, w: Warehouse) -> DataFrame:
    """Rows of the multi-year school table that a join to dim_school would lose."""
    return lookup.orphan_count(all_years, w.dim_school, "estab")


def unmatched_districts(clean_prices: DataFrame) -> DataFrame:
    """Sales whose district name is not in the district table, per name."""
    spark = clean_prices.sparkSession
    names = literal_tables.district_table(spark).select(F.col("district_name").alias("district"))
    counts = clean_prices.groupBy("district").agg(F.count("*").alias("n"))
    return counts.join(F.broadcast(names), "district", "left_anti")


def boundary_counts(crime: DataFrame) -> DataFrame:
    return crime.agg(
        F.count_if(F.col("in_boundary")).alias("inside"), F.count_if(~F.col("in_boundary")).alias("outside")
    )


def unparsed_months(clean: DataFrame, county: str) -> tuple[DataFrame, DataFrame]:
    """Count of month texts that do not parse, and up to five of them."""
    dated = dated_crime(clean, county)
    return profile.unparsed_count(dated, "crime_date"), profile.unparsed_sample(dated, "month", "crime_date")
