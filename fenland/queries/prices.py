"""House-price reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from fenland.operators import aggregates
from fenland.plans import reports
from fenland.queries.registry import query
from fenland.queries.standin import TABLES_SQL, rounded, warehouse


@query(
    "price_trend",
    TABLES_SQL
    + """SELECT county_name, year, round(avg(price), 2) AS avg_price, count(*) AS n
FROM prices GROUP BY county_name, year ORDER BY county_name, year""",
)
def price_trend(spark, sf_dir):
    return rounded(reports.price_trend(warehouse(spark, sf_dir)), 2, "avg_price").orderBy("county_name", "year")


@query(
    "price_average",
    TABLES_SQL
    + """SELECT county_name, round(avg(price), 4) AS avg_price, count(*) AS n
FROM prices WHERE year <= 2000 GROUP BY county_name""",
)
def price_average(spark, sf_dir):
    return rounded(reports.price_average(warehouse(spark, sf_dir), max_year=2000), 4, "avg_price")


@query(
    "price_distribution",
    TABLES_SQL
    + """SELECT county_name, round(avg(price), 2) AS mean_price, round(quantile_cont(price, 0.5), 4) AS median_price,
       round(stddev_samp(price), 4) AS sd_price, min(price) AS min_price, max(price) AS max_price, count(*) AS n
FROM prices WHERE year = 2000 GROUP BY county_name""",
)
def price_distribution(spark, sf_dir):
    stats = reports.price_distribution(warehouse(spark, sf_dir), year=2000)
    return rounded(rounded(stats, 2, "mean_price"), 4, "median_price", "sd_price")


@query(
    "price_trim_p99",
    TABLES_SQL
    + """, one_year AS (SELECT * FROM prices WHERE year = 2000),
cut AS (SELECT quantile_cont(price, 0.99) AS p99 FROM one_year)
SELECT county_name, count(*) AS n, max(price) AS max_price, round(avg(price), 2) AS avg_price
FROM one_year WHERE price > 0 AND price < (SELECT p99 FROM cut) GROUP BY county_name""",
)
def price_trim_p99(spark, sf_dir):
    w = warehouse(spark, sf_dir)
    kept = aggregates.trim_top(reports.in_year(w.fact_house_price, 2000, "date"), "price", 0.99)
    return (
        reports.with_district(kept, w)
        .groupBy("county_name")
        .agg(
            F.count("*").alias("n"),
            F.max("price").alias("max_price"),
            F.round(F.avg("price"), 2).alias("avg_price"),
        )
    )


@query(
    "price_boxes",
    TABLES_SQL
    + """, one_year AS (SELECT * FROM prices WHERE year = 2000),
kept AS (SELECT * FROM one_year WHERE price > 0 AND price < (SELECT quantile_cont(price, 0.99) FROM one_year)),
box AS (
  SELECT county_name, quantile_cont(price, 0.25) AS q1, quantile_cont(price, 0.5) AS median,
         quantile_cont(price, 0.75) AS q3, count(*) AS n FROM kept GROUP BY county_name)
SELECT b.county_name,
       min(CASE WHEN price >= q1 - 1.5 * (q3 - q1) THEN price END) AS lower_whisker,
       round(any_value(q1), 4) AS q1, round(any_value(median), 4) AS median, round(any_value(q3), 4) AS q3,
       max(CASE WHEN price <= q3 + 1.5 * (q3 - q1) THEN price END) AS upper_whisker,
       count(CASE WHEN price < q1 - 1.5 * (q3 - q1) OR price > q3 + 1.5 * (q3 - q1) THEN 1 END) AS outliers,
       any_value(n) AS n
FROM kept k JOIN box b ON k.county_name = b.county_name GROUP BY b.county_name""",
)
def price_boxes(spark, sf_dir):
    return rounded(reports.price_boxes(warehouse(spark, sf_dir), year=2000), 4, "q1", "median", "q3")
