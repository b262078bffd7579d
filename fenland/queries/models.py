"""Regressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from fenland.plans import models
from fenland.queries.registry import query
from fenland.queries.standin import TABLES_SQL, rounded, town_lookup, warehouse

_FRAMES = """, years AS (SELECT DISTINCT year FROM fact_house_price INTERSECT SELECT DISTINCT year FROM fact_crime),
district_prices AS (
  SELECT district_name, county_name, avg(price) AS avg_house_price FROM prices
  WHERE year IN (SELECT year FROM years) GROUP BY ALL),
areas AS (
  SELECT trim(regexp_replace(lsoa_name, '\\s+[A-Za-z0-9]+$', '')) AS district_name, county_name, lsoa_code, year
  FROM crimes WHERE crime_type = 'R' AND in_boundary),
per_area_common AS (
  SELECT district_name, county_name, lsoa_code, count(*) AS k FROM areas
  WHERE year IN (SELECT year FROM years) GROUP BY ALL),
drug_common AS (
  SELECT district_name, county_name, sum(k) / sum(population) * 100000 AS drug_rate_per_100k
  FROM per_area_common a JOIN fact_population p ON a.lsoa_code = p.lsoa_code WHERE population > 0 GROUP BY ALL),
per_area AS (SELECT district_name, county_name, lsoa_code, count(*) AS k FROM areas GROUP BY ALL),
drug AS (
  SELECT district_name, county_name, sum(k) / sum(population) * 100000 AS drug_rate_per_100k
  FROM per_area a JOIN fact_population p ON a.lsoa_code = p.lsoa_code WHERE population > 0 GROUP BY ALL),
price_towns AS (
  SELECT p.*, t.town FROM prices p
  LEFT JOIN town_lookup t ON regexp_extract(p.postcode, '^[A-Z]{1,2}[0-9]{1,2}') = t.district),
speed_towns AS (
  SELECT s.*, t.town FROM speeds s
  LEFT JOIN town_lookup t ON regexp_extract(s.postcode, '^[A-Z]{1,2}[0-9]{1,2}') = t.district),
score_towns AS (
  SELECT s.* EXCLUDE (town), t.town FROM scores s
  LEFT JOIN town_lookup t ON regexp_extract(s.postcode, '^[A-Z]{1,2}[0-9]{1,2}') = t.district),
town_price AS (
  SELECT town, avg(price) AS avg_house_price, count(*) AS hp_n FROM price_towns WHERE town IS NOT NULL GROUP BY town),
town_speed AS (
  SELECT town, avg(avg_speed) AS avg_download_speed, count(*) AS bb_n
  FROM speed_towns WHERE town IS NOT NULL GROUP BY town),
town_score AS (
  SELECT town, avg(att8_score) AS avg_att8, count(*) AS edu_n FROM score_towns WHERE town IS NOT NULL GROUP BY town),
county_score AS (SELECT county_name, avg(att8_score) AS avg_att8 FROM scores GROUP BY county_name),
county_speed AS (SELECT county_name, avg(avg_speed) AS avg_download_speed FROM speeds GROUP BY county_name),
lm_01 AS (
  SELECT drug_rate_per_100k AS x, avg_house_price AS y
  FROM district_prices JOIN drug_common USING (district_name, county_name)),
lm_02 AS (SELECT avg_download_speed AS x, avg_house_price AS y FROM town_price JOIN town_speed USING (town)),
lm_03 AS (SELECT avg_att8 AS x, avg_house_price AS y FROM town_price JOIN town_score USING (town)),
lm_04 AS (SELECT drug_rate_per_100k AS x, avg_att8 AS y FROM drug LEFT JOIN county_score USING (county_name)),
lm_05 AS (SELECT drug_rate_per_100k AS x, avg_download_speed AS y FROM drug LEFT JOIN county_speed USING (county_name)),
lm_06 AS (SELECT avg_att8 AS x, avg_download_speed AS y FROM town_speed JOIN town_score USING (town))
"""

# Finite series of the t distribution function, terms written as products of logs.
_P_VALUE = """CASE WHEN nu % 2 = 1 THEN
    1 - 2 / pi() * (theta + sin(theta) * cos(theta) * list_sum(list_transform(range(1, CAST((nu - 1) / 2 AS BIGINT) + 1),
      lambda i: exp(coalesce(list_sum(list_transform(range(1, i), lambda j: ln(c2 * 2 * j / (2 * j + 1)))), 0)))))
  ELSE
    1 - sin(theta) * list_sum(list_transform(range(1, CAST(nu / 2 AS BIGINT) + 1),
      lambda i: exp(coalesce(list_sum(list_transform(range(1, i), lambda j: ln(c2 * (2 * j - 1) / (2 * j)))), 0))))
  END"""


def _fit_sql(name: str) -> str:
    return (
        TABLES_SQL
        + _FRAMES
        + f""", f AS (
  SELECT CAST(regr_count(y, x) AS BIGINT) AS n, regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept, regr_r2(y, x) AS r2,
         regr_sxx(y, x) AS sxx, regr_syy(y, x) AS syy, regr_sxy(y, x) AS sxy, avg(x) AS mx,
         CAST(count(DISTINCT y) AS BIGINT) AS distinct_y FROM {name}),
g AS (SELECT *, n - 2 AS nu, sqrt((syy - sxy * sxy / sxx) / (n - 2)) AS sigma FROM f),
h AS (SELECT *, sigma / sqrt(sxx) AS se, slope / (sigma / sqrt(sxx)) AS t FROM g),
k AS (SELECT *, atan(abs(t) / sqrt(nu)) AS theta, pow(cos(atan(abs(t) / sqrt(nu))), 2) AS c2 FROM h)
SELECT CAST(n AS BIGINT) AS n, round(slope, 6) AS slope, round(intercept, 4) AS intercept, round(r2, 6) AS r_squared,
       round(1 - (1 - r2) * (n - 1) / (n - 2), 6) AS adj_r_squared, round(se, 6) AS se_slope,
       round(sigma * sqrt(1.0 / n + mx * mx / sxx), 4) AS se_intercept, round(t, 6) AS t_slope,
       round({_P_VALUE}, 6) AS p_slope, round(t * t, 6) AS f_statistic, round(sigma, 4) AS sigma, distinct_y
FROM k"""
    )


def _fit(name: str):
    def run(spark, sf_dir):
        fit = models.model_fit(warehouse(spark, sf_dir), name, **_arguments(spark, name))
        fit = rounded(fit, 6, "slope", "r_squared", "adj_r_squared", "se_slope", "t_slope", "p_slope", "f_statistic")
        return rounded(fit, 4, "intercept", "se_intercept", "sigma").select(
            "n", "slope", "intercept", "r_squared", "adj_r_squared", "se_slope", "se_intercept", "t_slope",
            "p_slope", "f_statistic", "sigma", "distinct_y",
        )

    return run


def _arguments(spark, name):
    if name in ("lm_02", "lm_03", "lm_06"):
        return {"towns": town_lookup(spark)}
    return {"crime_type": "R"}


for _name, _title in {
    "lm_01": "lm_district",
    "lm_02": "lm_town",
    "lm_03": "lm_town_score",
    "lm_04": "lm_county_on_district",
    "lm_05": "lm_county_speed_on_district",
    "lm_06": "lm_town_speed_score",
}.items():
    query(_title, _fit_sql(_name))(_fit(_name))


@query(
    "lm_band",
    TABLES_SQL
    + _FRAMES
    + f""", f AS (
  SELECT CAST(regr_count(y, x) AS BIGINT) AS n, regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept, regr_sxx(y, x) AS sxx,
         regr_syy(y, x) AS syy, regr_sxy(y, x) AS sxy, avg(x) AS mx, min(x) AS lo, max(x) AS hi FROM lm_01),
g AS (SELECT *, CAST(n - 2 AS BIGINT) AS nu, sqrt((syy - sxy * sxy / sxx) / (n - 2)) AS sigma FROM f),
tries AS (
  WITH RECURSIVE half(step, low, high, nu) AS (
    SELECT 0, CAST(0 AS DOUBLE), CAST(1000 AS DOUBLE), nu FROM g
    UNION ALL
    SELECT step + 1, CASE WHEN p > 0.05 THEN mid ELSE low END, CASE WHEN p > 0.05 THEN high ELSE mid END, nu
    FROM (SELECT *, {_P_VALUE} AS p
          FROM (SELECT *, (low + high) / 2 AS mid, atan((low + high) / 2 / sqrt(nu)) AS theta,
                       pow(cos(atan((low + high) / 2 / sqrt(nu))), 2) AS c2 FROM half WHERE step < 60)))
  SELECT (low + high) / 2 AS crit FROM half WHERE step = 60),
grid AS (
  SELECT CAST(step AS INT) AS step, lo + step * (hi - lo) / 79 AS x, g.*, crit
  FROM g, tries, range(80) r(step))
SELECT step, round(x, 4) AS x, round(intercept + slope * x, 4) AS fitted,
       round(intercept + slope * x - crit * sigma * sqrt(1.0 / n + (x - mx) * (x - mx) / sxx), 4) AS lower,
       round(intercept + slope * x + crit * sigma * sqrt(1.0 / n + (x - mx) * (x - mx) / sxx), 4) AS upper
FROM grid""",
)
def lm_band(spark, sf_dir):
    band = models.model_band(warehouse(spark, sf_dir), "lm_01", crime_type="R")
    return rounded(band, 4, "x", "fitted", "lower", "upper")


def _text_sql(name: str) -> str:
    """Fit of a model with its numbers as display text; p-values here are 0.001 or more."""
    return (
        TABLES_SQL
        + _FRAMES
        + f""", f AS (
  SELECT CAST(regr_count(y, x) AS BIGINT) AS n, regr_slope(y, x) AS slope, regr_r2(y, x) AS r2,
         regr_sxx(y, x) AS sxx, regr_syy(y, x) AS syy, regr_sxy(y, x) AS sxy FROM {name}),
g AS (SELECT *, n - 2 AS nu, sqrt((syy - sxy * sxy / sxx) / (n - 2)) AS sigma FROM f),
h AS (SELECT *, slope / (sigma / sqrt(sxx)) AS t FROM g),
k AS (SELECT *, atan(abs(t) / sqrt(nu)) AS theta, pow(cos(atan(abs(t) / sqrt(nu))), 2) AS c2 FROM h),
v AS (SELECT *, {_P_VALUE} AS p FROM k)
SELECT """
    )


@query(
    "model_text",
    _text_sql("lm_03")
    + "format('{:.2f}', round_even(slope, 2)) AS slope_text, format('{:.4f}', round_even(r2, 4)) AS r_squared_text, "
    "format('{:.4g}', p) AS p_text FROM v",
)
def model_text(spark, sf_dir):
    fit = models.model_fit(warehouse(spark, sf_dir), "lm_03", towns=town_lookup(spark))
    return fit.select("slope_text", "r_squared_text", "p_text")


@query(
    "model_caption",
    _text_sql("lm_03") + "format('Town-level average (n = {} towns) | R² = {:.3f}, p = {:.3g}', n, r2, p) AS caption FROM v",
)
def model_caption(spark, sf_dir):
    return models.model_caption(warehouse(spark, sf_dir), "lm_03", towns=town_lookup(spark))


@query(
    "lm_residuals",
    TABLES_SQL
    + _FRAMES
    + """, f AS (SELECT regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept FROM lm_02),
r AS (SELECT y - (intercept + slope * x) AS e FROM lm_02, f)
SELECT round(min(e), 4) AS minimum, round(quantile_cont(e, 0.25), 4) AS q1, round(quantile_cont(e, 0.5), 4) AS median,
       round(quantile_cont(e, 0.75), 4) AS q3, round(max(e), 4) AS maximum FROM r""",
)
def lm_residuals(spark, sf_dir):
    out = models.model_residuals(warehouse(spark, sf_dir), "lm_02", towns=town_lookup(spark))
    return rounded(out, 4, "minimum", "q1", "median", "q3", "maximum")


@query(
    "lm_town_frame",
    TABLES_SQL
    + _FRAMES
    + """, counts AS (SELECT town, county_name, count(*) AS n FROM price_towns WHERE town IS NOT NULL GROUP BY ALL),
top AS (SELECT town, county_name FROM counts
        QUALIFY row_number() OVER (PARTITION BY town ORDER BY n DESC, county_name) = 1)
SELECT town, county_name, round(avg_house_price, 4) AS avg_house_price,
       round(avg_download_speed, 4) AS avg_download_speed, hp_n, bb_n
FROM town_price JOIN town_speed USING (town) LEFT JOIN top USING (town)""",
)
def lm_town_frame(spark, sf_dir):
    frame = models.model_frame(warehouse(spark, sf_dir), "lm_02", towns=town_lookup(spark))
    return rounded(frame, 4, "avg_house_price", "avg_download_speed")


@query(
    "lm_district_frame",
    TABLES_SQL
    + _FRAMES
    + """SELECT district_name, county_name, round(avg_house_price, 4) AS avg_house_price,
       round(drug_rate_per_100k, 6) AS drug_rate_per_100k
FROM district_prices JOIN drug_common USING (district_name, county_name)""",
)
def lm_district_frame(spark, sf_dir):
    frame = models.model_frame(warehouse(spark, sf_dir), "lm_01", crime_type="R")
    frame = frame.select("district_name", "county_name", "avg_house_price", "drug_rate_per_100k")
    return rounded(rounded(frame, 4, "avg_house_price"), 6, "drug_rate_per_100k")


@query(
    "majority_county",
    TABLES_SQL
    + _FRAMES
    + """, counts AS (SELECT town, county_name, count(*) AS n FROM price_towns WHERE town IS NOT NULL GROUP BY ALL)
SELECT town, county_name FROM counts
QUALIFY row_number() OVER (PARTITION BY town ORDER BY n DESC, county_name) = 1""",
)
def majority_county(spark, sf_dir):
    return models.majority_county(models.price_parts(warehouse(spark, sf_dir), town_lookup(spark)))


@query(
    "match_rate",
    TABLES_SQL
    + _FRAMES
    + """SELECT CAST(count(town) AS BIGINT) AS matched, count(*) AS total FROM price_towns""",
)
def match_rate(spark, sf_dir):
    return models.town_match_rate(models.price_parts(warehouse(spark, sf_dir), town_lookup(spark)))


@query(
    "common_years",
    TABLES_SQL
    + _FRAMES
    + """SELECT district_name, county_name, round(avg_house_price, 4) AS avg_house_price FROM district_prices""",
)
def common_years(spark, sf_dir):
    w = warehouse(spark, sf_dir)
    return rounded(models.district_prices(w, models.common_years(w)), 4, "avg_house_price")


@query(
    "year_range",
    TABLES_SQL + _FRAMES + "SELECT min(year) AS first_year, max(year) AS last_year FROM years",
)
def year_range(spark, sf_dir):
    years = models.common_years(warehouse(spark, sf_dir))
    return years.agg(F.min("year").alias("first_year"), F.max("year").alias("last_year"))
