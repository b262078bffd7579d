"""Reports: each returns the DataFrame behind one table or chart.

Facts are aggregated by their own key before a dimension is joined wherever the
measure allows it, so a join moves one row per key, not one per fact row, and a
key that holds a large part of the facts is combined map-side. Only the fixed
tables (counties, districts, months) carry a broadcast hint.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fenland import literal_tables
from fenland.fixed_values import SPAN_MONTHS
from fenland.functions import dates, geography, labels, text
from fenland.functions.numbers import rate_per_100k
from fenland.operators import aggregates, rates, reshape
from fenland.operators.group_join import join_group_table
from fenland.plans.tables import Warehouse


# ---- shared pieces -------------------------------------------------------


def with_district(df: DataFrame, w: Warehouse) -> DataFrame:
    """Add district and county names by `district_id`."""
    named = w.dim_district.join(F.broadcast(w.dim_county), "county_id").drop("county_id")
    return df.join(F.broadcast(named), "district_id")


def with_county(df: DataFrame, w: Warehouse, county: str | None = None) -> DataFrame:
    """Add the county name by `county_id`, of one county only if given."""
    counties = w.dim_county if county is None else w.dim_county.where(F.col("county_name") == county)
    return df.join(F.broadcast(counties), "county_id")


def sums(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Sum, present-value count and row count per key: the parts of a mean."""
    return df.groupBy(*keys).agg(
        F.sum(value).alias("part_sum"), F.count(value).alias("part_count"), F.count("*").alias("part_rows")
    )


def mean_of_sums() -> Column:
    return F.try_divide(F.sum("part_sum"), F.sum("part_count"))


def crime_counts(
    w: Warehouse,
    crime_type: str,
    buckets: dict[str, Column] | None = None,
    *,
    in_boundary: bool = False,
    where: Column | None = None,
    years: DataFrame | None = None,
) -> DataFrame:
    """Events of one type per LSOA (and bucket), with LSOA and county names.

    `in_boundary` keeps rows inside the reporting county only; `years` is a
    table of years to keep (a calendar, so it may be broadcast).
    """
    rows = w.fact_crime.where(F.col("crime_type") == crime_type)
    if in_boundary:
        rows = rows.where("in_boundary")
    if where is not None:
        rows = rows.where(where)
    if years is not None:
        rows = rows.join(F.broadcast(years), "year", "left_semi")
    buckets = buckets or {}
    counts = rows.withColumns(buckets) if buckets else rows
    counts = counts.groupBy("lsoa_code", *buckets).agg(F.count("*").alias("crime_count"))
    return with_county(counts.join(w.dim_lsoa, "lsoa_code"), w)


def population_by_county(w: Warehouse) -> DataFrame:
    areas = w.fact_population.join(w.dim_lsoa, "lsoa_code")
    return (
        areas.groupBy("county_id")
        .agg(F.sum("population").alias("total_population"))
        .join(F.broadcast(w.dim_county), "county_id")
        .select("county_id", "county_name", "total_population")
    )


# ---- house prices --------------------------------------------------------


def in_year(df: DataFrame, year: int, date: str) -> DataFrame:
    """Rows of one year, by the year column (partitions) and as a date range (row groups)."""
    return df.where((F.col("year") == year) & dates.in_span(F.col(date), f"{year}-01-01", f"{year + 1}-01-01"))


def price_distribution(w: Warehouse, year: int = 2025) -> DataFrame:
    """Price statistics per county for one year."""
    prices = with_district(in_year(w.fact_house_price, year, "date"), w)
    return aggregates.group_statistics(prices, ["county_name"], "price", "price", few_groups=True)


def price_boxes(w: Warehouse, year: int = 2025, p: float = 0.99) -> DataFrame:
    """Box statistics per county for one year, the top of the prices cut off."""
    kept = aggregates.trim_top(in_year(w.fact_house_price, year, "date"), "price", p)
    return aggregates.box_statistics(with_district(kept, w), ["county_name"], "price", few_groups=True)


def price_average(w: Warehouse, max_year: int = 2025) -> DataFrame:
    """Mean price and sale count per county over full years."""
    parts = sums(w.fact_house_price.where(F.col("year") <= max_year), ["district_id"], "price")
    return (
        with_district(parts, w)
        .groupBy("county_name")
        .agg(mean_of_sums().alias("avg_price"), F.sum("part_rows").alias("n"))
    )


def price_trend(w: Warehouse, max_year: int | None = None) -> DataFrame:
    """Mean price and sale count per county and year."""
    prices = w.fact_house_price
    if max_year is not None:
        prices = prices.where(F.col("year") <= max_year)
    return (
        with_district(sums(prices, ["district_id", "year"], "price"), w)
        .groupBy("county_name", "year")
        .agg(mean_of_sums().alias("avg_price"), F.sum("part_rows").alias("n"))
        .orderBy("county_name", "year")
    )


# ---- broadband -----------------------------------------------------------


def speed_by_area(w: Warehouse, county: str, min_rows: int = 20, mode: str = "greedy") -> DataFrame:
    """Download-speed boxes per postcode district of a county, slowest median first."""
    areas = _area_speeds(w, county, mode)
    # two letters and two digits at most are a fixed domain; outward codes are free text
    few = mode == "greedy"
    boxes = aggregates.box_statistics(areas, ["town_code"], "avg_speed", min_rows=min_rows, few_groups=few)
    return boxes.orderBy("median", "town_code")


def area_sizes(w: Warehouse, county: str, mode: str = "greedy") -> DataFrame:
    """Postcodes per postcode district, largest first."""
    return reshape.frequency(_area_speeds(w, county, mode), "town_code").orderBy(F.desc("n"), "town_code")


def _area_speeds(w: Warehouse, county: str, mode: str) -> DataFrame:
    speeds = with_county(w.fact_broadband, w, county)
    code = geography.postcode_district(F.col("postcode"), mode).alias("town_code")
    return speeds.select(code, "avg_speed").where("town_code IS NOT NULL")


def speed_summary(w: Warehouse) -> DataFrame:
    """Mean of the average and of the maximum speed per county, one row each."""
    means = with_county(
        w.fact_broadband.groupBy("county_id").agg(F.avg("avg_speed").alias("avg"), F.avg("max_speed").alias("max")), w
    )
    # fixed values: display names
    names = {"avg": "Average Speed", "max": "Maximum Speed"}
    return reshape.to_long(means, ["county_name"], names, "speed_type", "speed_value")


# ---- crime ---------------------------------------------------------------


def crime_months(w: Warehouse, crime_type: str, year: int) -> DataFrame:
    """Events per month and county of one type in one year."""
    span = dates.in_span(F.col("crime_date"), f"{year}-01-01", f"{year + 1}-01-01")
    counts = crime_counts(
        w, crime_type, {"year_month": dates.year_month(F.col("crime_date"))}, where=(F.col("year") == year) & span
    )
    return counts.groupBy("year_month", "county_id", "county_name").agg(F.sum("crime_count").alias("crime_count"))


def crime_month_boxes(w: Warehouse, crime_type: str = "Violence And Sexual Offences", year: int = 2024) -> DataFrame:
    """Box statistics of the monthly counts per county (twelve values each at most)."""
    return aggregates.box_statistics(
        crime_months(w, crime_type, year), ["county_name"], "crime_count", small_groups=True
    )


def crime_rate_by_month(
    w: Warehouse, crime_type: str = "Vehicle Crime", first: str = "2024-05-01", until: str = "2025-05-01"
) -> DataFrame:
    """Events per 100,000 people, month by month over a twelve-month span."""
    counts = crime_counts(
        w,
        crime_type,
        {"month_num": dates.month_number(F.col("crime_date"))},
        where=dates.in_span(F.col("crime_date"), first, until),
    )
    months = literal_tables.span_months(w.dim_county.sparkSession)
    return (
        counts.groupBy("month_num", "county_name")
        .agg(F.sum("crime_count").alias("crime_count"))
        .join(F.broadcast(population_by_county(w)), "county_name", "left")
        .withColumn("rate_per_100k", rate_per_100k(F.col("crime_count"), F.col("total_population")))
        .join(F.broadcast(months), "month_num")
        .select("month_order", "month_num", "month_name", "county_name", "crime_count", "rate_per_100k")
        .orderBy("month_order", "county_name")
    )


def crime_rate_wide(w: Warehouse, *args: str, **kwargs: str) -> DataFrame:
    """The monthly rates with one row per county and one column per month, May to April."""
    months = [name for _, name, _ in SPAN_MONTHS]
    return reshape.to_wide(crime_rate_by_month(w, *args, **kwargs), ["county_name"], "month_name", "rate_per_100k", months)


def crime_rate_radar(w: Warehouse, *args: str, **kwargs: str) -> DataFrame:
    """The wide rates below an axis-maximum row and a zero row."""
    months = [name for _, name, _ in SPAN_MONTHS]
    return reshape.with_bounds_rows(crime_rate_wide(w, *args, **kwargs), "county_name", months)


def crime_rate_by_district(
    w: Warehouse,
    crime_type: str = "Robbery",
    *,
    years: DataFrame | None = None,
    in_boundary: bool = True,
    denominator: str = "event_areas",
) -> DataFrame:
    """Events per 100,000 people per district.

    `event_areas` divides by the population of the areas with at least one
    event; `all_areas` by the population of every area of the district.
    """
    counts = crime_counts(w, crime_type, in_boundary=in_boundary, years=years)
    counts = counts.withColumn("district_name", geography.lsoa_district(F.col("lsoa_name")))
    keys = ["county_name", "district_name"]
    if denominator == "event_areas":
        return rates.two_level_rate(
            counts, w.fact_population, "lsoa_code", keys, "crime_count", "total_crimes", "rate_per_100k"
        )
    if denominator == "all_areas":
        people = with_county(w.fact_population.join(w.dim_lsoa, "lsoa_code"), w)
        people = people.withColumn("district_name", geography.lsoa_district(F.col("lsoa_name")))
        people = people.groupBy(*keys).agg(F.sum("population").alias("total_population"))
        return rates.all_area_rate(counts, people, keys, "crime_count", "total_crimes", "rate_per_100k")
    raise ValueError(f"unknown denominator: {denominator}")


def crime_share_by_district(w: Warehouse, crime_type: str = "Robbery", **kwargs) -> DataFrame:
    """District rates with their share of the sum of rates and display labels."""
    shares = rates.share_of_total(crime_rate_by_district(w, crime_type, **kwargs), "rate_per_100k", "pct")
    return shares.withColumns(
        {
            "label": labels.named_value(F.col("district_name"), F.col("rate_per_100k"), 1),
            "pct_label": labels.percent(F.col("pct"), 1),
        }
    ).orderBy(F.desc("district_name"))


def crime_rate_by_year(w: Warehouse, crime_type: str = "Drugs", max_year: int | None = None) -> DataFrame:
    """Events per 100,000 people per year and county."""
    where = None if max_year is None else F.col("year") <= max_year
    counts = crime_counts(w, crime_type, {"year": F.col("year")}, where=where)
    return (
        counts.groupBy("year", "county_name")
        .agg(F.sum("crime_count").alias("crime_count"))
        .join(F.broadcast(population_by_county(w)), "county_name", "left")
        .withColumn("rate_per_100k", rate_per_100k(F.col("crime_count"), F.col("total_population")))
        .select("year", "county_name", "crime_count", "rate_per_100k")
        .orderBy("year", "county_name")
    )


# ---- education -----------------------------------------------------------


def attainment_stats(w: Warehouse) -> DataFrame:
    """Attainment statistics per county over all years, county in capitals."""
    stats = aggregates.group_statistics(_county_scores(w), ["county_name"], "att8_score", "att8", few_groups=True)
    return stats.select("county_name", "mean_att8", "median_att8", "sd_att8", F.col("n").alias("n_records"))


def attainment_boxes(w: Warehouse) -> DataFrame:
    return aggregates.box_statistics(_county_scores(w), ["county_name"], "att8_score", few_groups=True)


def attainment_outliers(w: Warehouse) -> DataFrame:
    """The scores beyond the whiskers of their county's box."""
    return aggregates.box_outliers(_county_scores(w), ["county_name"], "att8_score", attainment_boxes(w), few_groups=True)


def _county_scores(w: Warehouse) -> DataFrame:
    scores = w.fact_education.where("att8_score IS NOT NULL").select("estab", "att8_score")
    # a school that holds a third of the scores fills many tasks
    rows = with_county(join_group_table(scores, w.dim_school.select("estab", "county_id"), ["estab"], ["att8_score"]), w)
    return rows.select(F.upper("county_name").alias("county_name"), "att8_score")


def attainment_by_town_year(w: Warehouse, county: str) -> DataFrame:
    """Mean attainment per town and academic year, gaps kept as rows with a null mean."""
    parts = sums(w.fact_education.where("att8_score IS NOT NULL"), ["estab", "academic_year"], "att8_score")
    schools = with_county(w.dim_school.select("estab", "town", "county_id"), w, county)
    means = (
        parts.join(schools, "estab")
        .withColumn("town", text.blank_to(F.col("town"), "NA"))
        .groupBy("town", "academic_year")
        .agg(mean_of_sums().alias("avg_att8"))
    )
    return reshape.complete(means, "town", "academic_year").orderBy("town", "academic_year")
