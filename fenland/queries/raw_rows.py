"""Raw rows with the faults the cleaners handle, made by Spark from the benchmark tables.

Each frame has the columns a raw file scan has; the SQL text beside it gives the
values a clean row must have.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fenland.fixed_values import CRIME_DISTRICTS, DISTRICTS
from fenland.queries.standin import table

# District names by n_nationkey % 13; the last is not a known district.
_NAMES = [name for _, name, _ in DISTRICTS] + ["Elsewhere"]
_CRIME_NAMES = [name for names in CRIME_DISTRICTS.values() for name in names] + ["Cambridge"]


def _sql_list(names: list[str]) -> str:
    return ", ".join("'" + name.replace("'", "''") + "'" for name in names)


def _spark_array(names: list[str]) -> str:
    quoted = ", ".join('"' + name + '"' for name in names)
    return f"array({quoted})"


def _join(spark, sf_dir, *names: str) -> DataFrame:
    df = table(spark, sf_dir, names[0])
    on = {
        ("orders", "customer"): "o_custkey = c_custkey",
        ("lineitem", "supplier"): "l_suppkey = s_suppkey",
        ("events", "customer"): "user_id = c_custkey",
    }
    return df.join(table(spark, sf_dir, names[1]), F.expr(on[names]))


# ---- house prices --------------------------------------------------------


def raw_prices(spark, sf_dir) -> DataFrame:
    """Every sale twice under two ids, in capitals, with blanks, missing postcodes and prices that are no number."""
    rows = _join(spark, sf_dir, "orders", "customer").selectExpr(
        "explode(array('a', 'b')) AS copy",
        "o_orderkey",
        "IF(o_orderkey % 17 = 0, 'abc', CAST(o_totalprice AS STRING)) AS price",
        "concat(date_format(o_orderdate, 'yyyy-MM-dd'), ' 00:00') AS date",
        "IF(o_orderkey % 19 = 0, '', concat(' nr', c_custkey % 30 + 1, ' ', c_custkey % 10, 'aa ')) AS postcode",
        "concat(c_mktsegment, '-ON-SEA') AS town",
        f"upper({_spark_array(_NAMES)}[c_nationkey % 13]) AS district",
        "array('NORFOLK', 'SUFFOLK', 'ESSEX')[c_nationkey % 3] AS county",
    )
    return rows.withColumn("transaction_id", F.concat("copy", F.col("o_orderkey").cast("string")))


CLEAN_PRICES_SQL = f"""SELECT DISTINCT CAST(o_orderdate AS DATE) AS date,
  'NR' || CAST(c_custkey % 30 + 1 AS VARCHAR) || ' ' || CAST(c_custkey % 10 AS VARCHAR) || 'AA' AS postcode,
  c_mktsegment[1] || lower(c_mktsegment[2:]) || '-On-Sea' AS town,
  [{_sql_list(_NAMES)}][c_nationkey % 13 + 1] AS district,
  ['Norfolk', 'Suffolk', 'Essex'][c_nationkey % 3 + 1] AS county,
  o_totalprice AS price, CAST(year(o_orderdate) AS INT) AS year
FROM orders JOIN customer ON o_custkey = c_custkey
WHERE c_nationkey % 3 < 2 AND o_orderkey % 17 <> 0 AND o_orderkey % 19 <> 0"""


# ---- broadband -----------------------------------------------------------


def raw_speeds(spark, sf_dir) -> DataFrame:
    """Postcodes in small letters with extra blanks, some without a speed, some outside the area."""
    return table(spark, sf_dir, "customer").selectExpr(
        "concat(' ', array('nr', 'ip', 'cb')[c_custkey % 3], c_custkey % 97, '   ', c_custkey % 10, 'aa') AS postcode",
        "IF(c_custkey % 7 = 0, NULL, CAST(c_acctbal AS STRING)) AS avg_speed",
        "CAST(c_acctbal * 2 AS STRING) AS max_speed",
        "'speeds' AS _file",
        "0L AS _block",
        "c_custkey AS _row",
    )


# `place` is the position of the first of equal rows
CLEAN_SPEEDS_SQL = """SELECT
  ['NR', 'IP'][c_custkey % 3 + 1] || CAST(c_custkey % 97 AS VARCHAR) || ' ' || CAST(c_custkey % 10 AS VARCHAR) || 'AA'
    AS postcode,
  c_acctbal AS avg_speed, c_acctbal * 2 AS max_speed, ['Norfolk', 'Suffolk'][c_custkey % 3 + 1] AS county, min(c_custkey) AS place
FROM customer WHERE c_custkey % 3 < 2 AND c_custkey % 7 <> 0 GROUP BY ALL"""


# ---- crime ---------------------------------------------------------------


def raw_crime(spark, sf_dir, force: str) -> DataFrame:
    """One force's events: bad months, missing places, two names of a place, mixed letter case, missing outcomes."""
    side = "s_nationkey < 13" if force == "norfolk" else "s_nationkey >= 13"
    name = force.capitalize()
    return (
        _join(spark, sf_dir, "lineitem", "supplier")
        .where(side)
        .selectExpr(
            "IF(l_orderkey % 23 = 0, '2024-13', date_format(l_shipdate, 'yyyy-MM')) AS month",
            f"' {name}  Constabulary' AS reported_by",
            f"'{name} Constabulary ' AS police_force",
            "IF(l_orderkey % 29 = 0, NULL, concat(' e', l_suppkey, ' ')) AS lsoa_code",
            f"concat({_spark_array(_CRIME_NAMES)}[s_nationkey % 13], IF(l_orderkey % 3 = 0, ' 001B', '   001A')) AS lsoa_name",
            "CASE l_returnflag WHEN 'A' THEN 'drugs' WHEN 'N' THEN '  violence  and SEXUAL offences' "
            "ELSE 'VEHICLE CRIME' END AS crime_type",
            "IF(l_linestatus = 'O', NULL, 'Under investigation') AS outcome",
            f"'{force}' AS _file",
            "0L AS _block",
            "l_orderkey * 100 + l_linenumber AS _row",
        )
    )


def clean_crime_sql(force: str) -> str:
    side = "s_nationkey < 13" if force == "norfolk" else "s_nationkey >= 13"
    name = force.capitalize()
    return f"""SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS month,
  '{name} Constabulary' AS reported_by, '{name} Constabulary' AS police_force, 'E' || CAST(l_suppkey AS VARCHAR) AS lsoa_code,
  [{_sql_list(_CRIME_NAMES)}][s_nationkey % 13 + 1] || CASE WHEN l_orderkey % 3 = 0 THEN ' 001B' ELSE ' 001A' END AS lsoa_name,
  CASE l_returnflag WHEN 'A' THEN 'Drugs' WHEN 'N' THEN 'Violence And Sexual Offences' ELSE 'Vehicle Crime' END AS crime_type,
  CASE WHEN l_linestatus = 'O' THEN 'Unknown' ELSE 'Under investigation' END AS outcome,
  CAST(year(l_shipdate) AS INT) AS year, min(l_orderkey * 100 + l_linenumber) AS place
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
WHERE {side} AND l_orderkey % 23 <> 0 AND l_orderkey % 29 <> 0 GROUP BY ALL"""


# ---- schools -------------------------------------------------------------


def raw_schools(spark, sf_dir) -> DataFrame:
    """School rows with suppressed numbers; one code may occur several times a day, rows ordered by event."""
    return _join(spark, sf_dir, "events", "customer").selectExpr(
        "CAST(900 + c_nationkey AS STRING) AS lea_code",
        "CAST(user_id % 500 AS STRING) AS estab",
        "concat('  ', c_name, ' ') AS school_name",
        "IF(event_id % 31 = 0, '', concat(c_mktsegment, ' ')) AS town",
        "concat('NR', c_custkey % 30 + 1, ' ', c_custkey % 10, 'AA') AS postcode",
        "CASE event_id % 5 WHEN 0 THEN 'NEW' WHEN 1 THEN 'SUPP' ELSE CAST(event_id % 200 AS STRING) END AS total_pupils",
        "CASE WHEN event_type = 'error' THEN 'NE' WHEN event_id % 11 = 0 THEN 'SUPP' ELSE CAST(value AS STRING) END AS att8_score",
        "IF(c_nationkey % 2 = 0, 'Norfolk', 'Suffolk') AS county",
        "date_format(ts, 'yyyy-MM-dd') AS academic_year",
        "CASE event_type WHEN 'signup' THEN '4' WHEN 'click' THEN '2' ELSE '1' END AS rectype",
        "'events' AS _file",
        "0L AS _block",
        "event_id AS _row",
    )


CLEAN_SCHOOLS_SQL = """SELECT CAST(900 + c_nationkey AS VARCHAR) AS lea_code, CAST(user_id % 500 AS VARCHAR) AS estab,
  c_name AS school_name, c_mktsegment AS town,
  'NR' || CAST(c_custkey % 30 + 1 AS VARCHAR) || ' ' || CAST(c_custkey % 10 AS VARCHAR) || 'AA' AS postcode,
  CASE WHEN event_id % 5 < 2 THEN NULL ELSE CAST(event_id % 200 AS DOUBLE) END AS total_pupils,
  CASE WHEN event_type = 'error' OR event_id % 11 = 0 THEN NULL ELSE value END AS att8_score,
  CASE WHEN c_nationkey % 2 = 0 THEN 'Norfolk' ELSE 'Suffolk' END AS county,
  strftime(ts, '%Y-%m-%d') AS academic_year
FROM events JOIN customer ON user_id = c_custkey
WHERE event_type <> 'signup' AND event_id % 31 <> 0
QUALIFY row_number() OVER (PARTITION BY user_id % 500, c_nationkey % 2, strftime(ts, '%Y-%m-%d') ORDER BY event_id) = 1"""


# ---- population ----------------------------------------------------------


def raw_population(spark, sf_dir) -> DataFrame:
    """Every area twice, the second time with another number; some numbers are text."""
    return table(spark, sf_dir, "supplier").selectExpr(
        "concat('E', s_suppkey, ' ') AS lsoa_code",
        "concat(' ', s_name) AS lsoa_name",
        "IF(s_suppkey % 13 = 0, 'n/a', CAST(s_acctbal AS STRING)) AS population",
        "'supplier' AS _file",
        "explode(array(1L, 0L)) AS _block",
        "s_suppkey AS _row",
    ).withColumn("population", F.expr("IF(_block = 1, '1', population)"))


CLEAN_POPULATION_SQL = """SELECT 'E' || CAST(s_suppkey AS VARCHAR) AS lsoa_code, s_name AS lsoa_name,
  CASE WHEN s_suppkey % 13 = 0 THEN 1 ELSE s_acctbal END AS population FROM supplier"""
