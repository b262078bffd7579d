"""The warehouse tables expressed over the benchmark tables, in DataFrame and in SQL form.

region plays the county, nation the district, supplier the small area with its
population, lineitem the crime rows, orders the sales, customer the broadband
postcodes and the schools, events the school scores.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fenland import schemas
from fenland.literal_tables import literal_table
from fenland.plans.tables import Warehouse

# (district, town) rows for some of the stand-in postcode districts; the others stay unmatched.
TOWN_ROWS = [
    (f"{area}{number}", f"{area} town {number // 5}")
    for area in ("AU", "BU", "FU", "HO", "MA")
    for number in range(10, 31)
    if number % 7 != 0
]


# Column types are given, so no job reads a file footer while a plan is built.
_SCHEMAS = {
    "region": "r_regionkey INT, r_name STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING",
    "supplier": "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE",
    "part": "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, p_retailprice DOUBLE",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
    "o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE, "
    "l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_returnflag STRING, l_linestatus STRING, "
    "l_shipdate TIMESTAMP_NTZ",
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(_SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def town_lookup(spark: SparkSession) -> DataFrame:
    return literal_table(spark, TOWN_ROWS, schemas.TOWN_LOOKUP)


def postcode_text() -> Column:
    """`ho1 0aa`: a postcode made from a customer's segment and key."""
    return F.expr("concat(lower(substr(c_mktsegment, 1, 2)), c_custkey % 30 + 1, ' ', c_custkey % 10, 'aa')")


def warehouse(spark: SparkSession, sf_dir: str) -> Warehouse:
    def t(name: str) -> DataFrame:
        return table(spark, sf_dir, name)

    return Warehouse(lambda name: _VIEWS[name](t))


_PLACE = "concat(upper(substr(c_mktsegment, 1, 2)), c_custkey % 30 + 1, c_custkey % 10, 'AA')"


def _customers(t) -> DataFrame:
    # nation has a fixed 25 rows
    return t("customer").join(F.broadcast(t("nation")), F.expr("c_nationkey = n_nationkey"))


def _areas(t) -> DataFrame:
    return t("supplier").join(F.broadcast(t("nation")), F.expr("s_nationkey = n_nationkey"))


_VIEWS = {
    "dim_county": lambda t: t("region").selectExpr("r_regionkey AS county_id", "r_name AS county_name"),
    "dim_district": lambda t: t("nation").selectExpr(
        "n_nationkey AS district_id", "n_name AS district_name", "n_regionkey AS county_id"
    ),
    "dim_lsoa": lambda t: _areas(t).selectExpr(
        "s_suppkey AS lsoa_code", "concat(n_name, ' 001A') AS lsoa_name", "n_regionkey AS county_id"
    ),
    "dim_school": lambda t: _customers(t).selectExpr(
        "c_custkey AS estab",
        "c_name AS school_name",
        "CASE WHEN c_mktsegment = 'BUILDING' THEN '' ELSE concat(n_name, ' ', c_mktsegment) END AS town",
        f"{_PLACE} AS postcode",
        "n_regionkey AS county_id",
    ),
    "fact_population": lambda t: t("supplier").selectExpr("s_suppkey AS lsoa_code", "s_acctbal AS population"),
    "fact_house_price": lambda t: t("orders")
    .join(t("customer"), F.expr("o_custkey = c_custkey"))
    .selectExpr(
        "o_orderkey AS transaction_pk",
        "CAST(o_orderdate AS DATE) AS date",
        "year(o_orderdate) AS year",
        f"{_PLACE} AS postcode",
        "c_nationkey AS district_id",
        "o_totalprice AS price",
    ),
    "fact_broadband": lambda t: _customers(t).selectExpr(
        f"{_PLACE} AS postcode", "c_acctbal AS avg_speed", "c_acctbal * 2 AS max_speed", "n_regionkey AS county_id"
    ),
    "fact_crime": lambda t: t("lineitem").selectExpr(
        "CAST(l_shipdate AS DATE) AS crime_date",
        "year(l_shipdate) AS year",
        "l_suppkey AS lsoa_code",
        "l_returnflag AS crime_type",
        "l_linestatus = 'O' AS in_boundary",
    ),
    "fact_education": lambda t: t("events").selectExpr(
        "event_id AS education_pk",
        "user_id AS estab",
        "date_format(ts, 'yyyy-MM-dd') AS academic_year",
        "CASE WHEN event_type <> 'error' THEN value END AS att8_score",
    ),
}


_POSTCODE = (
    "upper(substr(c_mktsegment, 1, 2)) || CAST(c_custkey % 30 + 1 AS VARCHAR) || "
    "CAST(c_custkey % 10 AS VARCHAR) || 'AA'"
)

# The same tables as SQL; prefix of the SQL twins.
TABLES_SQL = f"""WITH
dim_county AS (SELECT r_regionkey AS county_id, r_name AS county_name FROM region),
dim_district AS (SELECT n_nationkey AS district_id, n_name AS district_name, n_regionkey AS county_id FROM nation),
dim_lsoa AS (
  SELECT s_suppkey AS lsoa_code, n_name || ' 001A' AS lsoa_name, n_regionkey AS county_id
  FROM supplier JOIN nation ON s_nationkey = n_nationkey),
dim_school AS (
  SELECT c_custkey AS estab, c_name AS school_name,
         CASE WHEN c_mktsegment = 'BUILDING' THEN '' ELSE n_name || ' ' || c_mktsegment END AS town,
         {_POSTCODE} AS postcode, n_regionkey AS county_id
  FROM customer JOIN nation ON c_nationkey = n_nationkey),
fact_population AS (SELECT s_suppkey AS lsoa_code, s_acctbal AS population FROM supplier),
fact_house_price AS (
  SELECT o_orderkey AS transaction_pk, CAST(o_orderdate AS DATE) AS date, CAST(year(o_orderdate) AS INT) AS year,
         {_POSTCODE} AS postcode, c_nationkey AS district_id, o_totalprice AS price
  FROM orders JOIN customer ON o_custkey = c_custkey),
fact_broadband AS (
  SELECT {_POSTCODE} AS postcode, c_acctbal AS avg_speed, c_acctbal * 2 AS max_speed, n_regionkey AS county_id
  FROM customer JOIN nation ON c_nationkey = n_nationkey),
fact_crime AS (
  SELECT CAST(l_shipdate AS DATE) AS crime_date, CAST(year(l_shipdate) AS INT) AS year, l_suppkey AS lsoa_code,
         l_returnflag AS crime_type, l_linestatus = 'O' AS in_boundary
  FROM lineitem),
fact_education AS (
  SELECT event_id AS education_pk, user_id AS estab, strftime(ts, '%Y-%m-%d') AS academic_year,
         CASE WHEN event_type <> 'error' THEN value END AS att8_score
  FROM events),
town_lookup(district, town) AS (VALUES {", ".join(f"('{d}', '{t}')" for d, t in TOWN_ROWS)}),
prices AS (
  SELECT f.*, d.district_name, c.county_name FROM fact_house_price f
  JOIN dim_district d USING (district_id) JOIN dim_county c USING (county_id)),
speeds AS (SELECT * FROM fact_broadband JOIN dim_county USING (county_id)),
crimes AS (
  SELECT * FROM fact_crime JOIN dim_lsoa USING (lsoa_code) JOIN dim_county USING (county_id)),
county_people AS (
  SELECT county_name, sum(population) AS total_population
  FROM fact_population JOIN dim_lsoa USING (lsoa_code) JOIN dim_county USING (county_id) GROUP BY county_name),
scores AS (
  SELECT * FROM fact_education JOIN dim_school USING (estab) JOIN dim_county USING (county_id)
  WHERE att8_score IS NOT NULL)
"""


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    """Round doubles so that the summation order does not show in comparisons."""
    return df.withColumns({c: F.round(c, digits) for c in columns})
