"""School-score reports."""

from __future__ import annotations

from fenland.plans import reports
from fenland.queries.registry import query
from fenland.queries.standin import TABLES_SQL, rounded, warehouse


@query(
    "score_stats",
    TABLES_SQL
    + """SELECT upper(county_name) AS county_name, round(avg(att8_score), 4) AS mean_att8,
       round(quantile_cont(att8_score, 0.5), 4) AS median_att8, round(stddev_samp(att8_score), 4) AS sd_att8,
       count(*) AS n_records
FROM scores GROUP BY 1""",
)
def score_stats(spark, sf_dir):
    return rounded(reports.attainment_stats(warehouse(spark, sf_dir)), 4, "mean_att8", "median_att8", "sd_att8")


@query(
    "box_stats",
    TABLES_SQL
    + """, box AS (
  SELECT county_name, quantile_cont(att8_score, 0.25) AS q1, quantile_cont(att8_score, 0.5) AS median,
         quantile_cont(att8_score, 0.75) AS q3, count(*) AS n FROM scores GROUP BY county_name)
SELECT b.county_name,
       min(CASE WHEN att8_score >= q1 - 1.5 * (q3 - q1) THEN att8_score END) AS lower_whisker,
       round(any_value(q1), 4) AS q1, round(any_value(median), 4) AS median, round(any_value(q3), 4) AS q3,
       max(CASE WHEN att8_score <= q3 + 1.5 * (q3 - q1) THEN att8_score END) AS upper_whisker,
       count(CASE WHEN att8_score < q1 - 1.5 * (q3 - q1) OR att8_score > q3 + 1.5 * (q3 - q1) THEN 1 END) AS outliers,
       any_value(n) AS n
FROM scores s JOIN box b ON s.county_name = b.county_name GROUP BY b.county_name""",
)
def box_stats(spark, sf_dir):
    return rounded(reports.attainment_boxes(warehouse(spark, sf_dir)), 4, "q1", "median", "q3")


@query(
    "score_by_town_year_complete",
    TABLES_SQL
    + """, means AS (
  SELECT CASE WHEN town IS NULL OR town = '' THEN 'NA' ELSE town END AS town, academic_year,
         avg(att8_score) AS avg_att8
  FROM scores WHERE county_name = 'ASIA' GROUP BY 1, 2)
SELECT t.town, y.academic_year, round(m.avg_att8, 8) AS avg_att8
FROM (SELECT DISTINCT town FROM means) t CROSS JOIN (SELECT DISTINCT academic_year FROM means) y
LEFT JOIN means m ON m.town = t.town AND m.academic_year = y.academic_year
ORDER BY town, academic_year""",
)
def score_by_town_year_complete(spark, sf_dir):
    return rounded(reports.attainment_by_town_year(warehouse(spark, sf_dir), "ASIA"), 8, "avg_att8")
