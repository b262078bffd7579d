"""Broadband reports."""

from __future__ import annotations

from fenland.operators import aggregates
from fenland.plans import reports
from fenland.queries.registry import query
from fenland.queries.standin import TABLES_SQL, rounded, warehouse

_AREAS = """, areas AS (
  SELECT regexp_extract(postcode, '^[A-Z]{1,2}[0-9]{1,2}') AS town_code, avg_speed
  FROM speeds WHERE county_name = 'ASIA')
"""


@query(
    "speed_by_area",
    TABLES_SQL
    + _AREAS
    + """, box AS (
  SELECT town_code, quantile_cont(avg_speed, 0.25) AS q1, quantile_cont(avg_speed, 0.5) AS median,
         quantile_cont(avg_speed, 0.75) AS q3, count(*) AS n
  FROM areas WHERE town_code <> '' GROUP BY town_code HAVING count(*) >= 5)
SELECT b.town_code,
       min(CASE WHEN avg_speed >= q1 - 1.5 * (q3 - q1) THEN avg_speed END) AS lower_whisker,
       round(any_value(q1), 4) AS q1, round(any_value(median), 4) AS median, round(any_value(q3), 4) AS q3,
       max(CASE WHEN avg_speed <= q3 + 1.5 * (q3 - q1) THEN avg_speed END) AS upper_whisker,
       count(CASE WHEN avg_speed < q1 - 1.5 * (q3 - q1) OR avg_speed > q3 + 1.5 * (q3 - q1) THEN 1 END) AS outliers,
       any_value(n) AS n
FROM areas a JOIN box b ON a.town_code = b.town_code GROUP BY b.town_code""",
)
def speed_by_area(spark, sf_dir):
    boxes = reports.speed_by_area(warehouse(spark, sf_dir), "ASIA", min_rows=5)
    return rounded(boxes, 4, "q1", "median", "q3")


@query(
    "area_sizes",
    TABLES_SQL
    + _AREAS
    + "SELECT town_code, count(*) AS n FROM areas WHERE town_code <> '' GROUP BY town_code ORDER BY n DESC, town_code",
)
def area_sizes(spark, sf_dir):
    return reports.area_sizes(warehouse(spark, sf_dir), "ASIA")


@query(
    "speed_summary_long",
    TABLES_SQL
    + """SELECT county_name, 'Average Speed' AS speed_type, round(avg(avg_speed), 4) AS speed_value
FROM speeds GROUP BY county_name
UNION ALL SELECT county_name, 'Maximum Speed', round(avg(max_speed), 4) FROM speeds GROUP BY county_name""",
)
def speed_summary_long(spark, sf_dir):
    return rounded(reports.speed_summary(warehouse(spark, sf_dir)), 4, "speed_value")


@query(
    "speed_rounded_stats",
    TABLES_SQL
    + """SELECT county_name, round_even(avg(avg_speed), 2) AS mean, round_even(quantile_cont(avg_speed, 0.5), 2) AS median,
       max(avg_speed) AS maximum, min(avg_speed) AS minimum FROM speeds GROUP BY county_name""",
)
def speed_rounded_stats(spark, sf_dir):
    w = warehouse(spark, sf_dir)
    return aggregates.rounded_statistics(
        reports.with_county(w.fact_broadband, w), ["county_name"], "avg_speed", few_groups=True
    )
