"""Statistics over groups of many rows, and over many groups; sales lines play the measured values."""

from __future__ import annotations

from pyspark.sql import functions as F

from fenland.operators import aggregates, profile, regression
from fenland.plans import reports
from fenland.queries.registry import query
from fenland.queries.standin import TABLES_SQL, rounded, table, warehouse


def _stats_sql(key: str) -> str:
    return f"""SELECT {key}, round(avg(l_extendedprice), 2) AS mean_price, round(quantile_cont(l_extendedprice, 0.5), 4) AS median_price,
  round(stddev_samp(l_extendedprice), 2) AS sd_price, min(l_extendedprice) AS min_price, max(l_extendedprice) AS max_price,
  count(*) AS n FROM lineitem GROUP BY {key}"""


def _stats(spark, sf_dir, key: str, few_groups: bool):
    lines = table(spark, sf_dir, "lineitem")
    stats = aggregates.group_statistics(lines, [key], "l_extendedprice", "price", few_groups=few_groups)
    return rounded(rounded(stats, 2, "mean_price", "sd_price"), 4, "median_price")


@query("line_stats_broadcast", _stats_sql("l_returnflag"))
def line_stats_broadcast(spark, sf_dir):
    """Three groups of a third of all rows; the brackets are broadcast."""
    return _stats(spark, sf_dir, "l_returnflag", True)


@query("line_stats_salted", _stats_sql("l_returnflag"))
def line_stats_salted(spark, sf_dir):
    """The same groups through the salted join."""
    return _stats(spark, sf_dir, "l_returnflag", False)


@query("line_stats_by_supplier", _stats_sql("l_suppkey"))
def line_stats_by_supplier(spark, sf_dir):
    """Many small groups through the salted join."""
    return _stats(spark, sf_dir, "l_suppkey", False)


def _box_sql(source: str, key: str, value: str, least: int = 0) -> str:
    return f"""box AS (
  SELECT {key}, quantile_cont({value}, 0.25) AS q1, quantile_cont({value}, 0.5) AS median,
         quantile_cont({value}, 0.75) AS q3, count(*) AS n FROM {source} GROUP BY {key} HAVING count(*) >= {least})
SELECT b.{key},
       min(CASE WHEN {value} >= q1 - 1.5 * (q3 - q1) THEN {value} END) AS lower_whisker,
       round(any_value(q1), 4) AS q1, round(any_value(median), 4) AS median, round(any_value(q3), 4) AS q3,
       max(CASE WHEN {value} <= q3 + 1.5 * (q3 - q1) THEN {value} END) AS upper_whisker,
       count(CASE WHEN {value} < q1 - 1.5 * (q3 - q1) OR {value} > q3 + 1.5 * (q3 - q1) THEN 1 END) AS outliers,
       any_value(n) AS n
FROM {source} s JOIN box b ON s.{key} = b.{key} GROUP BY b.{key}"""


@query("line_boxes_by_supplier", "WITH " + _box_sql("lineitem", "l_suppkey", "l_extendedprice"))
def line_boxes_by_supplier(spark, sf_dir):
    boxes = aggregates.box_statistics(table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_extendedprice")
    return rounded(boxes, 4, "q1", "median", "q3")


@query(
    "speed_by_area_outward",
    TABLES_SQL
    + """, areas AS (
  SELECT CASE WHEN length(postcode) > 4 THEN substr(postcode, 1, length(postcode) - 3) END AS town_code, avg_speed
  FROM speeds WHERE county_name = 'ASIA'),
"""
    + _box_sql("areas", "town_code", "avg_speed", 5).replace("FROM areas GROUP", "FROM areas WHERE town_code IS NOT NULL GROUP"),
)
def speed_by_area_outward(spark, sf_dir):
    """Outward codes are an open domain, so no table of groups is broadcast by hint."""
    boxes = reports.speed_by_area(warehouse(spark, sf_dir), "ASIA", min_rows=5, mode="outward")
    return rounded(boxes, 4, "q1", "median", "q3")


@query(
    "score_outliers",
    TABLES_SQL
    + """, named AS (SELECT upper(county_name) AS county_name, att8_score FROM scores),
"""
    + _box_sql("named", "county_name", "att8_score").replace("\nSELECT b.", ",\nboxes AS (\nSELECT b.", 1)
    + """)
SELECT s.county_name, att8_score, count(*) AS n FROM named s JOIN boxes b ON s.county_name = b.county_name
WHERE att8_score < lower_whisker OR att8_score > upper_whisker GROUP BY ALL""",
)
def score_outliers(spark, sf_dir):
    """The points beyond the whiskers, equal ones counted together."""
    found = reports.attainment_outliers(warehouse(spark, sf_dir))
    return found.groupBy("county_name", "att8_score").agg(F.count("*").alias("n"))


# the finite series of the t distribution function, its terms as running sums of logs
_LARGE_P = """
even AS (SELECT sum(exp(coalesce(s, 0))) AS total FROM (
  SELECT sum(ln(c2 * (2 * j - 1) / (2 * j))) OVER (ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS s
  FROM k, range(1, CAST(nu // 2 AS BIGINT) + 1) r(j))),
odd AS (SELECT sum(exp(coalesce(s, 0))) AS total FROM (
  SELECT sum(ln(c2 * 2 * j / (2 * j + 1))) OVER (ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS s
  FROM k, range(1, CAST((nu - 1) // 2 AS BIGINT) + 1) r(j)))"""


@query(
    "lm_rows",
    f"""WITH f AS (
  SELECT CAST(regr_count(y, x) AS BIGINT) AS n, regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept,
         regr_sxx(y, x) AS sxx, regr_syy(y, x) AS syy, regr_sxy(y, x) AS sxy, avg(x) AS mx
  FROM (SELECT l_quantity AS x, l_tax AS y FROM lineitem)),
g AS (SELECT *, n - 2 AS nu, sqrt((syy - sxy * sxy / sxx) / (n - 2)) AS sigma FROM f),
h AS (SELECT *, slope / (sigma / sqrt(sxx)) AS t, intercept / (sigma * sqrt(1.0 / n + mx * mx / sxx)) AS ti FROM g),
k AS (SELECT *, atan(abs(t) / sqrt(nu)) AS theta, pow(cos(atan(abs(t) / sqrt(nu))), 2) AS c2 FROM h),
{_LARGE_P}
SELECT n, round(slope, 9) AS slope, round(intercept, 9) AS intercept, round(t, 6) AS t_slope, round(ti, 4) AS t_intercept,
  round(CASE WHEN nu % 2 = 1 THEN 1 - 2 / pi() * (theta + sin(theta) * cos(theta) * odd.total) ELSE 1 - sin(theta) * even.total END, 6) AS p_slope
FROM k, even, odd""",
)
def lm_rows(spark, sf_dir):
    """A line through raw rows, with far more than ten thousand degrees of freedom."""
    lines = table(spark, sf_dir, "lineitem")
    fit = regression.fit_line(lines, "l_quantity", "l_tax")
    fit = rounded(rounded(fit, 9, "slope", "intercept"), 6, "t_slope", "p_slope")
    return rounded(fit, 4, "t_intercept").select("n", "slope", "intercept", "t_slope", "t_intercept", "p_slope")


@query(
    "lm_intercepts",
    """WITH f AS (
  SELECT l_returnflag, count(*) AS n, regr_intercept(y, x) AS b, regr_sxx(y, x) AS sxx, regr_syy(y, x) AS syy, regr_sxy(y, x) AS sxy, avg(x) AS mx
  FROM (SELECT l_returnflag, l_discount AS x, l_extendedprice AS y FROM lineitem) GROUP BY l_returnflag)
SELECT l_returnflag, n, round(b / (sqrt((syy - sxy * sxy / sxx) / (n - 2)) * sqrt(1.0 / n + mx * mx / sxx)), 4) AS t_intercept,
  CAST(0 AS DOUBLE) AS p_intercept FROM f""",
)
def lm_intercepts(spark, sf_dir):
    """Intercept errors per group; prices lie so far from zero that the tail rounds to none."""
    fit = regression.fit_line(table(spark, sf_dir, "lineitem"), "l_discount", "l_extendedprice", ["l_returnflag"])
    return rounded(rounded(fit, 4, "t_intercept"), 9, "p_intercept").select("l_returnflag", "n", "t_intercept", "p_intercept")


@query(
    "table_shape",
    "SELECT 'lineitem' AS table_name, count(*) AS row_count, CAST(11 AS BIGINT) AS column_count FROM lineitem "
    "UNION ALL SELECT 'orders', count(*), CAST(6 AS BIGINT) FROM orders",
)
def table_shape(spark, sf_dir):
    shapes = [profile.shape(table(spark, sf_dir, t)).select(F.lit(t).alias("table_name"), "row_count", "column_count") for t in ("lineitem", "orders")]
    return shapes[0].unionByName(shapes[1])


@query(
    "unparsed_values",
    """SELECT DISTINCT 'x' || CAST(p_size AS VARCHAR) AS raw FROM part WHERE p_size % 7 = 3 ORDER BY raw LIMIT 5""",
)
def unparsed_values(spark, sf_dir):
    """The first five distinct raw values that did not parse."""
    raw = F.expr("CASE WHEN p_size % 7 = 3 THEN concat('x', p_size) ELSE string(p_size) END")
    rows = table(spark, sf_dir, "part").select(raw.alias("raw")).withColumn("parsed", F.expr("try_cast(raw AS DOUBLE)"))
    return profile.unparsed_sample(rows, "raw", "parsed", 5)
