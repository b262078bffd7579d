"""Crime reports."""

from __future__ import annotations

from fenland.fixed_values import SPAN_MONTHS
from fenland.plans import reports
from fenland.queries.registry import query
from fenland.queries.standin import TABLES_SQL, rounded, warehouse

_MONTHS = [name for _, name, _ in SPAN_MONTHS]
_SPAN = {"crime_type": "R", "first": "1998-05-01", "until": "1999-05-01"}

_MONTHLY = """, monthly AS (
  SELECT strftime(crime_date, '%Y-%m') AS year_month, county_id, county_name, count(*) AS crime_count
  FROM crimes WHERE crime_type = 'R' AND year = 1998 GROUP BY ALL)
"""

_RATES = """, span AS (
  SELECT strftime(crime_date, '%m') AS month_num, county_name, count(*) AS crime_count
  FROM crimes WHERE crime_type = 'R' AND (
    (year(crime_date) = 1998 AND month(crime_date) >= 5) OR (year(crime_date) = 1999 AND month(crime_date) <= 4))
  GROUP BY ALL),
rates AS (
  SELECT month_num, s.county_name, crime_count, crime_count / total_population * 100000 AS rate
  FROM span s LEFT JOIN county_people p ON s.county_name = p.county_name)
"""

_WIDE = ", ".join(f"max(CASE WHEN month_num = '{num}' THEN rate END) AS \"{name}\"" for num, name, _ in SPAN_MONTHS)

_DISTRICT = """, per_area AS (
  SELECT lsoa_code, lsoa_name, county_name, count(*) AS crime_count
  FROM crimes WHERE crime_type = 'R' AND in_boundary GROUP BY ALL),
district_rates AS (
  SELECT county_name, trim(regexp_replace(lsoa_name, '\\s+[A-Za-z0-9]+$', '')) AS district_name,
         CAST(sum(crime_count) AS BIGINT) AS total_crimes, sum(population) AS total_population,
         sum(crime_count) / sum(population) * 100000 AS rate
  FROM per_area a LEFT JOIN fact_population p ON a.lsoa_code = p.lsoa_code
  WHERE population IS NOT NULL AND population > 0 GROUP BY ALL)
"""


@query("events_monthly", TABLES_SQL + _MONTHLY + "SELECT year_month, county_id, county_name, crime_count FROM monthly")
def events_monthly(spark, sf_dir):
    return reports.crime_months(warehouse(spark, sf_dir), "R", 1998)


@query(
    "events_monthly_box",
    TABLES_SQL
    + _MONTHLY
    + """, box AS (
  SELECT county_name, quantile_cont(crime_count, 0.25) AS q1, quantile_cont(crime_count, 0.5) AS median,
         quantile_cont(crime_count, 0.75) AS q3, count(*) AS n FROM monthly GROUP BY county_name)
SELECT b.county_name,
       min(CASE WHEN crime_count >= q1 - 1.5 * (q3 - q1) THEN crime_count END) AS lower_whisker,
       any_value(q1) AS q1, any_value(median) AS median, any_value(q3) AS q3,
       max(CASE WHEN crime_count <= q3 + 1.5 * (q3 - q1) THEN crime_count END) AS upper_whisker,
       count(CASE WHEN crime_count < q1 - 1.5 * (q3 - q1) OR crime_count > q3 + 1.5 * (q3 - q1) THEN 1 END) AS outliers,
       any_value(n) AS n
FROM monthly m JOIN box b ON m.county_name = b.county_name GROUP BY b.county_name""",
)
def events_monthly_box(spark, sf_dir):
    return reports.crime_month_boxes(warehouse(spark, sf_dir), "R", 1998)


@query(
    "rate_by_month",
    TABLES_SQL
    + _RATES
    + """SELECT CAST((CAST(month_num AS INT) + 7) % 12 + 1 AS INT) AS month_order, month_num,
       strftime(make_date(2000, CAST(month_num AS INT), 1), '%b') AS month_name, county_name, crime_count,
       round(rate, 6) AS rate_per_100k
FROM rates ORDER BY month_order, county_name""",
)
def rate_by_month(spark, sf_dir):
    return rounded(reports.crime_rate_by_month(warehouse(spark, sf_dir), **_SPAN), 6, "rate_per_100k")


@query(
    "rate_by_month_wide",
    TABLES_SQL
    + _RATES
    + f", wide AS (SELECT county_name, {_WIDE} FROM rates GROUP BY county_name) "
    + "SELECT county_name, "
    + ", ".join(f'round("{m}", 6) AS "{m}"' for m in _MONTHS)
    + " FROM wide",
)
def rate_by_month_wide(spark, sf_dir):
    return rounded(reports.crime_rate_wide(warehouse(spark, sf_dir), **_SPAN), 6, *_MONTHS)


@query(
    "rate_by_month_radar",
    TABLES_SQL
    + _RATES
    + f", wide AS (SELECT county_name, {_WIDE} FROM rates GROUP BY county_name), "
    + "top AS (SELECT ceil(max(rate) * 1.1) AS t FROM rates) "
    + "SELECT 'axis_max' AS county_name, "
    + ", ".join(f't AS "{m}"' for m in _MONTHS)
    + " FROM top UNION ALL SELECT 'axis_min', "
    + ", ".join("0.0" for _ in _MONTHS)
    + " UNION ALL SELECT county_name, "
    + ", ".join(f'round("{m}", 6)' for m in _MONTHS)
    + " FROM wide",
)
def rate_by_month_radar(spark, sf_dir):
    return rounded(reports.crime_rate_radar(warehouse(spark, sf_dir), **_SPAN), 6, *_MONTHS)


@query(
    "rate_by_district",
    TABLES_SQL
    + _DISTRICT
    + """SELECT county_name, district_name, total_crimes, round(total_population, 4) AS total_population,
       round(rate, 6) AS rate_per_100k, round(rate / sum(rate) OVER () * 100, 6) AS pct
FROM district_rates""",
)
def rate_by_district(spark, sf_dir):
    shares = reports.crime_share_by_district(warehouse(spark, sf_dir), "R").drop("label", "pct_label")
    return rounded(rounded(shares, 6, "rate_per_100k", "pct"), 4, "total_population")


@query(
    "district_labels",
    TABLES_SQL
    + _DISTRICT
    + """, shares AS (SELECT district_name, county_name, rate, rate / sum(rate) OVER () * 100 AS pct FROM district_rates)
SELECT county_name, district_name,
  district_name || ' (' || regexp_replace(format('{:.1f}', round_even(rate, 1)), '\\.?0+$', '') || ')' AS label,
  regexp_replace(format('{:.1f}', round_even(pct, 1)), '\\.?0+$', '') || '%' AS pct_label
FROM shares""",
)
def district_labels(spark, sf_dir):
    shares = reports.crime_share_by_district(warehouse(spark, sf_dir), "R")
    return shares.select("county_name", "district_name", "label", "pct_label")


@query(
    "rate_by_district_all_areas",
    TABLES_SQL
    + _DISTRICT
    + """, people AS (
  SELECT c.county_name, trim(regexp_replace(lsoa_name, '\\s+[A-Za-z0-9]+$', '')) AS district_name,
         sum(population) AS total_population
  FROM fact_population p JOIN dim_lsoa l ON p.lsoa_code = l.lsoa_code JOIN dim_county c ON c.county_id = l.county_id
  GROUP BY ALL),
events_per_district AS (
  SELECT county_name, trim(regexp_replace(lsoa_name, '\\s+[A-Za-z0-9]+$', '')) AS district_name,
         CAST(sum(crime_count) AS BIGINT) AS total_crimes
  FROM per_area GROUP BY ALL)
SELECT e.county_name, e.district_name, total_crimes, round(total_population, 4) AS total_population,
       round(total_crimes / total_population * 100000, 6) AS rate_per_100k
FROM events_per_district e JOIN people p ON e.county_name = p.county_name AND e.district_name = p.district_name
WHERE total_population > 0""",
)
def rate_by_district_all_areas(spark, sf_dir):
    rates = reports.crime_rate_by_district(warehouse(spark, sf_dir), "R", denominator="all_areas")
    return rounded(rounded(rates, 6, "rate_per_100k"), 4, "total_population")


@query(
    "rate_by_year",
    TABLES_SQL
    + """, yearly AS (SELECT year, county_name, count(*) AS crime_count FROM crimes WHERE crime_type = 'R' GROUP BY ALL)
SELECT year, y.county_name, crime_count, round(crime_count / total_population * 100000, 6) AS rate_per_100k
FROM yearly y LEFT JOIN county_people p ON y.county_name = p.county_name ORDER BY year, county_name""",
)
def rate_by_year(spark, sf_dir):
    return rounded(reports.crime_rate_by_year(warehouse(spark, sf_dir), "R"), 6, "rate_per_100k")


_VIEW_SQL = """SELECT county_name, year, count(*) AS events, count(DISTINCT lsoa_code) AS areas
FROM fact_crime JOIN dim_lsoa USING (lsoa_code) JOIN dim_county USING (county_id)
WHERE in_boundary = {flag} AND crime_type = {kind}
GROUP BY county_name, year"""


@query("sql_on_views", TABLES_SQL + _VIEW_SQL.format(kind="'N'", flag="true"))
def sql_on_views(spark, sf_dir):
    """SQL text over the warehouse's views, parameters by name."""
    warehouse(spark, sf_dir).create_views()
    return spark.sql(_VIEW_SQL.format(kind=":kind", flag=":flag"), args={"kind": "N", "flag": True})
