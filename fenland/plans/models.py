"""Cross-dataset regressions: the model frames and their fits."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fenland import literal_tables
from fenland.functions import geography, labels
from fenland.operators import dedup, lookup, regression
from fenland.plans import reports
from fenland.plans.tables import Warehouse


# ---- parts of the model frames -------------------------------------------


def common_years(w: Warehouse) -> DataFrame:
    """Years present in both the price and the crime facts."""
    return lookup.common_values(w.fact_house_price, w.fact_crime, "year")


def drug_rate(
    w: Warehouse, years: DataFrame | None = None, denominator: str = "event_areas", crime_type: str = "Drugs"
) -> DataFrame:
    """Drug offences per 100,000 people per district."""
    rate = reports.crime_rate_by_district(w, crime_type, years=years, denominator=denominator)
    return rate.withColumnsRenamed({"total_crimes": "total_drug_offences", "rate_per_100k": "drug_rate_per_100k"})


def district_prices(w: Warehouse, years: DataFrame) -> DataFrame:
    """Mean price per district over the given years (a calendar, so it may be broadcast)."""
    kept = w.fact_house_price.join(F.broadcast(years), "year", "left_semi")
    return reports.with_district(
        kept.groupBy("district_id").agg(F.avg("price").alias("avg_house_price")), w
    ).select("district_name", "county_name", "avg_house_price")


def town_parts(df: DataFrame, keys: list[str], value: str, towns: DataFrame, mode: str = "greedy") -> DataFrame:
    """Sums per postcode district (and `keys`) with the town name, null where the lookup has none."""
    district = geography.postcode_district(F.col("postcode"), mode)
    parts = reports.sums(df.withColumn("district", district), [*keys, "district"], value)
    return parts.join(towns, "district", "left")


def town_means(parts: DataFrame, mean: str, count: str) -> DataFrame:
    return (
        parts.where("town IS NOT NULL")
        .groupBy("town")
        .agg(reports.mean_of_sums().alias(mean), F.sum("part_rows").alias(count))
    )


def town_match_rate(parts: DataFrame) -> DataFrame:
    """Fact rows whose postcode has a town, and all fact rows."""
    matched = F.sum(F.when(F.col("town").isNotNull(), F.col("part_rows")).otherwise(0))
    return parts.agg(
        F.coalesce(matched, F.lit(0)).alias("matched"), F.coalesce(F.sum("part_rows"), F.lit(0)).alias("total")
    )


def majority_county(parts: DataFrame) -> DataFrame:
    """The county with most rows of each town; ties go to the first name."""
    counts = parts.where("town IS NOT NULL").groupBy("town", "county_name").agg(F.sum("part_rows").alias("n"))
    return dedup.top_row(counts, ["town"], "n", ["county_name"]).select("town", "county_name")


def price_parts(w: Warehouse, towns: DataFrame | None = None, mode: str = "greedy") -> DataFrame:
    parts = town_parts(w.fact_house_price, ["district_id"], "price", _towns(w, towns), mode)
    return reports.with_district(parts, w)


def speed_parts(w: Warehouse, towns: DataFrame | None = None, mode: str = "greedy") -> DataFrame:
    return reports.with_county(town_parts(w.fact_broadband, ["county_id"], "avg_speed", _towns(w, towns), mode), w)


def score_parts(w: Warehouse, towns: DataFrame | None = None, mode: str = "greedy") -> DataFrame:
    # one row per school first: the join to the schools then moves one row per school
    scores = reports.sums(w.fact_education.where("att8_score IS NOT NULL"), ["estab"], "att8_score")
    schools = w.dim_school.select("estab", "postcode")
    district = geography.postcode_district(F.col("postcode"), mode)
    return (
        scores.join(schools, "estab")
        .withColumn("district", district)
        .groupBy("district")
        .agg(*[F.sum(c).alias(c) for c in ("part_sum", "part_count", "part_rows")])
        .join(_towns(w, towns), "district", "left")
    )


def _towns(w: Warehouse, towns: DataFrame | None) -> DataFrame:
    """The caller's table as it is; the fixed lookup (131 rows) with a broadcast hint."""
    return towns if towns is not None else F.broadcast(literal_tables.town_lookup(w.dim_county.sparkSession))


# ---- model frames --------------------------------------------------------


def price_by_drug_rate(w: Warehouse, ignore_case: bool = False, **kwargs) -> DataFrame:
    """District frame over the common years.

    District names are compared as they are; with `ignore_case` a district
    spelled differently in the two sources is kept.
    """
    years = common_years(w)
    prices, rate = district_prices(w, years), drug_rate(w, years, **kwargs)
    if not ignore_case:
        return prices.join(rate, ["district_name", "county_name"])
    low = F.lower("district_name").alias("_district")
    rate = rate.select(low, *[c for c in rate.columns if c != "district_name"])
    return prices.select("*", low).join(rate, ["_district", "county_name"]).drop("_district")


def price_by_speed(w: Warehouse, towns: DataFrame | None = None, mode: str = "greedy") -> DataFrame:
    prices = price_parts(w, towns, mode)
    frame = town_means(prices, "avg_house_price", "hp_n").join(
        town_means(speed_parts(w, towns, mode), "avg_download_speed", "bb_n"), "town"
    )
    return frame.join(majority_county(prices), "town", "left")


def price_by_attainment(w: Warehouse, towns: DataFrame | None = None, mode: str = "greedy") -> DataFrame:
    prices = price_parts(w, towns, mode)
    frame = town_means(prices, "avg_house_price", "hp_n").join(
        town_means(score_parts(w, towns, mode), "avg_att8", "edu_n"), "town"
    )
    return frame.join(majority_county(prices), "town", "left")


def attainment_by_drug_rate(w: Warehouse, **kwargs) -> DataFrame:
    """District rates beside their county's mean attainment."""
    scores = reports.sums(w.fact_education.where("att8_score IS NOT NULL"), ["estab"], "att8_score")
    schools = reports.with_county(w.dim_school.select("estab", "county_id"), w)
    means = (
        scores.join(schools, "estab")
        .groupBy("county_name")
        .agg(reports.mean_of_sums().alias("avg_att8"), F.sum("part_rows").alias("n_schools"))
    )
    return drug_rate(w, **kwargs).join(F.broadcast(means), "county_name", "left")


def speed_by_drug_rate(w: Warehouse, **kwargs) -> DataFrame:
    """District rates beside their county's mean download speed."""
    means = reports.with_county(
        w.fact_broadband.groupBy("county_id").agg(
            F.avg("avg_speed").alias("avg_download_speed"), F.count("*").alias("n_postcodes")
        ),
        w,
    ).drop("county_id")
    return drug_rate(w, **kwargs).join(F.broadcast(means), "county_name", "left")


def speed_by_attainment(w: Warehouse, towns: DataFrame | None = None, mode: str = "greedy") -> DataFrame:
    speeds = speed_parts(w, towns, mode)
    frame = town_means(speeds, "avg_download_speed", "bb_n").join(
        town_means(score_parts(w, towns, mode), "avg_att8", "edu_n"), "town"
    )
    return frame.join(majority_county(speeds), "town", "left")


# ---- the six models ------------------------------------------------------


@dataclass(frozen=True)
class Model:
    """y ~ x on one model frame."""

    frame: Callable[..., DataFrame]
    x: str
    y: str
    slope_digits: int


MODELS = {
    "lm_01": Model(price_by_drug_rate, "drug_rate_per_100k", "avg_house_price", 2),
    "lm_02": Model(price_by_speed, "avg_download_speed", "avg_house_price", 2),
    "lm_03": Model(price_by_attainment, "avg_att8", "avg_house_price", 2),
    "lm_04": Model(attainment_by_drug_rate, "drug_rate_per_100k", "avg_att8", 4),
    "lm_05": Model(speed_by_drug_rate, "drug_rate_per_100k", "avg_download_speed", 6),
    "lm_06": Model(speed_by_attainment, "avg_att8", "avg_download_speed", 4),
}


def model_frame(w: Warehouse, name: str, **kwargs) -> DataFrame:
    return MODELS[name].frame(w, **kwargs)


def model_fit(w: Warehouse, name: str, **kwargs) -> DataFrame:
    """Fit of one model: all summary numbers, the number of different y values, display text."""
    model = MODELS[name]
    frame = model_frame(w, name, **kwargs)
    fit = regression.fit_line(frame, model.x, model.y, extra={"distinct_y": F.count_distinct(model.y)})
    return fit.withColumns(
        {
            "slope_text": F.format_string(f"%.{model.slope_digits}f", F.bround("slope", model.slope_digits)),
            "r_squared_text": F.format_string("%.4f", F.bround("r_squared", 4)),
            "p_text": labels.p_value_text(F.col("p_slope"), 4),
        }
    )


def model_residuals(w: Warehouse, name: str, **kwargs) -> DataFrame:
    """Residual minimum, quartiles and maximum (frames have one row per district or town)."""
    model = MODELS[name]
    frame = model_frame(w, name, **kwargs)
    fit = regression.fit_line(frame, model.x, model.y)
    return regression.residual_quantiles(frame, fit, model.x, model.y, small_groups=True)


def model_band(w: Warehouse, name: str, **kwargs) -> DataFrame:
    """Fitted line and 95 % band."""
    model = MODELS[name]
    return regression.confidence_band(regression.fit_line(model_frame(w, name, **kwargs), model.x, model.y))


def model_caption(w: Warehouse, name: str, **kwargs) -> DataFrame:
    """`n = ...` with R squared and p, the text under a scatter plot; lm_01 names its year range."""
    fit = model_fit(w, name, **kwargs)
    # fixed values: the texts in front
    if name == "lm_01":
        years = common_years(w).agg(F.concat_ws("-", F.min("year").cast("string"), F.max("year").cast("string")))
        prefix = F.concat(F.lit("District-level average, "), years.scalar())
    elif name in ("lm_04", "lm_05"):
        prefix = F.format_string("District-level (n = %d)", F.col("n"))
    else:
        prefix = F.format_string("Town-level average (n = %d towns)", F.col("n"))
    return fit.select(labels.fit_caption(prefix, F.col("r_squared"), F.col("p_slope")).alias("caption"))
