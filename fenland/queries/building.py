"""The cleaners and the warehouse build over raw rows made from the benchmark tables."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import cache

from pyspark.sql import functions as F

from fenland.functions import geography
from fenland.operators import reshape
from fenland.plans import building, cleaning
from fenland.plans.tables import Warehouse
from fenland.queries import raw_rows
from fenland.queries.registry import query
from fenland.queries.standin import TABLES_SQL, table, warehouse
from fenland.schemas import POSITION
from fenland.sources import scratch

CLEANERS = {
    "house_price_clean": lambda s, d: cleaning.clean_house_price(raw_rows.raw_prices(s, d)),
    "broadband_clean": lambda s, d: cleaning.clean_broadband(raw_rows.raw_speeds(s, d)),
    "norfolk_clean": lambda s, d: cleaning.clean_crime(raw_rows.raw_crime(s, d, "norfolk")),
    "suffolk_clean": lambda s, d: cleaning.clean_crime(raw_rows.raw_crime(s, d, "suffolk")),
    "education_clean": lambda s, d: cleaning.clean_education(raw_rows.raw_schools(s, d)),
    "population_clean": lambda s, d: cleaning.clean_population(raw_rows.raw_population(s, d)),
}

CLEAN_SQL = {
    "house_price_clean": raw_rows.CLEAN_PRICES_SQL,
    "broadband_clean": raw_rows.CLEAN_SPEEDS_SQL,
    "norfolk_clean": raw_rows.clean_crime_sql("norfolk"),
    "suffolk_clean": raw_rows.clean_crime_sql("suffolk"),
    "education_clean": raw_rows.CLEAN_SCHOOLS_SQL,
    "population_clean": raw_rows.CLEAN_POPULATION_SQL,
}

def _without_position(cleaner):
    return lambda spark, sf_dir: cleaner(spark, sf_dir).drop(*POSITION)


for _name, _cleaner in CLEANERS.items():
    _placed = _name in ("broadband_clean", "norfolk_clean", "suffolk_clean")
    query(_name, f"SELECT * EXCLUDE (place) FROM ({CLEAN_SQL[_name]})" if _placed else CLEAN_SQL[_name])(_without_position(_cleaner))


FORCES = ("norfolk_clean", "suffolk_clean")


def built(spark, sf_dir, together: Sequence[str] = FORCES) -> Warehouse:
    """The warehouse over clean tables that are written once, when a table first asks for them, as the job does.

    The tables `together` are written side by side, as each scans its own files: one job's last tasks leave no core idle.
    """

    def write(name):
        return scratch.written(CLEANERS[name](spark, sf_dir))

    @cache
    def side_by_side():
        with ThreadPoolExecutor(len(together)) as pool:
            return dict(zip(together, pool.map(write, together), strict=True))

    @cache
    def clean(name):
        return side_by_side()[name] if name in together else write(name)

    return building.build_warehouse(spark, clean)


_DISTRICT_ROWS = ", ".join(
    f"({i}, '{name.replace(chr(39), chr(39) * 2)}')" for i, name, _ in raw_rows.DISTRICTS
)
_INSIDE = " OR ".join(
    f"(source_county = '{county}' AND trim(regexp_replace(lsoa_name, '\\s+[A-Za-z0-9]+$', '')) IN ({raw_rows._sql_list(names)}))"
    for county, names in raw_rows.CRIME_DISTRICTS.items()
)
BUILT_SQL = (
    "WITH "
    + ",\n".join(f"{name} AS ({sql})" for name, sql in CLEAN_SQL.items())
    + f""", crime AS (
  SELECT *, 'Norfolk' AS source_county FROM norfolk_clean UNION ALL SELECT *, 'Suffolk' FROM suffolk_clean),
counties(county_id, county_name) AS (VALUES (1, 'Norfolk'), (2, 'Suffolk')),
districts(district_id, district_name) AS (VALUES {_DISTRICT_ROWS})
"""
)


@query(
    "built_dim_lsoa",
    BUILT_SQL
    + """SELECT lsoa_code, lsoa_name, county_id FROM crime JOIN counties ON source_county = county_name
QUALIFY row_number() OVER (PARTITION BY lsoa_code ORDER BY source_county, place) = 1""",
)
def built_dim_lsoa(spark, sf_dir):
    return built(spark, sf_dir).dim_lsoa


@query(
    "built_dim_school",
    BUILT_SQL
    + """SELECT estab, school_name, town, replace(upper(postcode), ' ', '') AS postcode, county_id
FROM education_clean JOIN counties ON county = county_name
QUALIFY row_number() OVER (PARTITION BY estab ORDER BY county, academic_year, school_name, town, postcode) = 1""",
)
def built_dim_school(spark, sf_dir):
    return built(spark, sf_dir).dim_school


@query(
    "built_fact_population",
    BUILT_SQL
    + "SELECT lsoa_code, population FROM population_clean WHERE lsoa_code IN (SELECT lsoa_code FROM crime)",
)
def built_fact_population(spark, sf_dir):
    return built(spark, sf_dir).fact_population


@query(
    "built_fact_house_price",
    BUILT_SQL
    + """, numbers AS (SELECT count(*) AS n FROM house_price_clean JOIN districts ON district = district_name)
SELECT date, year, replace(postcode, ' ', '') AS postcode, CAST(district_id AS INT) AS district_id, price,
  n AS last_key FROM house_price_clean JOIN districts ON district = district_name, numbers""",
)
def built_fact_house_price(spark, sf_dir):
    sales = scratch.written(built(spark, sf_dir).fact_house_price)
    # keys run from 1 to the row count; which row gets which is free
    last = sales.agg(F.max("transaction_pk")).scalar()
    return sales.withColumn("last_key", last).drop("transaction_pk")


@query(
    "built_fact_broadband",
    BUILT_SQL
    + """SELECT replace(postcode, ' ', '') AS postcode, avg_speed, max_speed, county_id
FROM broadband_clean JOIN counties ON county = county_name
QUALIFY row_number() OVER (PARTITION BY replace(postcode, ' ', '') ORDER BY place) = 1""",
)
def built_fact_broadband(spark, sf_dir):
    return built(spark, sf_dir).fact_broadband


def _with_key_counts(fact, key):
    """Largest key and number of different keys instead of the keys: which row gets which is free."""
    fact = scratch.written(fact)
    counts = fact.agg(F.max(key).alias("last_key"), F.count_distinct(key).alias("keys"))
    picked = counts.select(F.struct("*")).scalar()
    return fact.withColumn("_k", picked).select("*", "_k.*").drop("_k", key)


@query(
    "built_fact_crime",
    BUILT_SQL
    + f"""SELECT month AS crime_date, year, lsoa_code, crime_type, outcome, police_force, coalesce({_INSIDE}, false) AS in_boundary,
  (SELECT count(*) FROM crime) AS last_key, (SELECT count(*) FROM crime) AS keys FROM crime""",
)
def built_fact_crime(spark, sf_dir):
    return _with_key_counts(built(spark, sf_dir).fact_crime, "crime_pk")


@query(
    "built_fact_education",
    BUILT_SQL
    + """SELECT estab, academic_year, total_pupils, att8_score,
  (SELECT count(*) FROM education_clean) AS last_key, (SELECT count(*) FROM education_clean) AS keys FROM education_clean""",
)
def built_fact_education(spark, sf_dir):
    return _with_key_counts(built(spark, sf_dir).fact_education, "education_pk")


@query(
    "built_orphans",
    BUILT_SQL
    + """SELECT f AS fact, CAST(0 AS BIGINT) AS orphans
FROM (VALUES ('fact_house_price'), ('fact_crime'), ('fact_population'), ('fact_education')) AS facts(f)""",
)
def built_orphans(spark, sf_dir):
    # all clean tables but the speeds are read; the largest first
    return building.orphan_report(built(spark, sf_dir, (*FORCES, "house_price_clean", "education_clean", "population_clean")))


@query(
    "seeded_orphans",
    TABLES_SQL
    + """SELECT 'fact_house_price' AS fact, count(*) AS orphans FROM fact_house_price WHERE district_id % 7 = 0
UNION ALL SELECT 'fact_crime', count(*) FROM fact_crime WHERE lsoa_code % 7 = 0
UNION ALL SELECT 'fact_population', count(*) FROM fact_population WHERE lsoa_code % 7 = 0
UNION ALL SELECT 'fact_education', count(*) FROM fact_education WHERE estab % 7 = 0 OR estab NOT IN (SELECT estab FROM dim_school)""",
)
def seeded_orphans(spark, sf_dir):
    """The check over dimensions from which every seventh key is missing."""
    whole = warehouse(spark, sf_dir)
    keys = {"dim_district": "district_id", "dim_lsoa": "lsoa_code", "dim_school": "estab"}

    def without_sevenths(name):
        table = getattr(whole, name)
        return table.where(f"{keys[name]} % 7 <> 0") if name in keys else table

    return building.orphan_report(Warehouse(without_sevenths))


@query(
    "district_mismatch",
    BUILT_SQL
    + """SELECT district, count(*) AS n FROM house_price_clean
WHERE district NOT IN (SELECT district_name FROM districts) GROUP BY district""",
)
def district_mismatch(spark, sf_dir):
    return building.unmatched_districts(CLEANERS["house_price_clean"](spark, sf_dir))


@query(
    "boundary_counts",
    BUILT_SQL
    + f"""SELECT count(CASE WHEN {_INSIDE} THEN 1 END) AS inside, count(*) - count(CASE WHEN {_INSIDE} THEN 1 END) AS outside
FROM crime""",
)
def boundary_counts(spark, sf_dir):
    sides = [CLEANERS[f"{force}_clean"](spark, sf_dir) for force in ("norfolk", "suffolk")]
    return building.boundary_counts(building.combined_crime(*sides))


@query(
    "education_years",
    """SELECT CAST(user_id AS VARCHAR) AS estab, c_name AS school_name, CASE event_type WHEN 'click' THEN c_mktsegment END AS town,
  ['NORFOLK', 'West Suffolk', 'Ipswich'][c_nationkey % 4 + 1] AS la_name,
  CASE WHEN event_type <> 'view' THEN 'NR' || CAST(c_custkey % 30 + 1 AS VARCHAR) END AS postcode, value AS att8_score,
  CASE event_type WHEN 'click' THEN '2021-2022' WHEN 'view' THEN '2022-2023' ELSE '2023-2024' END AS academic_year,
  CASE WHEN c_nationkey % 4 = 0 THEN 'Norfolk' ELSE 'Suffolk' END AS county_name
FROM events JOIN customer ON user_id = c_custkey
WHERE event_type IN ('click', 'view', 'purchase') AND event_id % 11 <> 0 AND c_nationkey % 4 < 3""",
)
def education_years(spark, sf_dir):
    """Three years' rows under three sets of column names, some without a town or a postcode, some scores suppressed."""
    rows = table(spark, sf_dir, "events").join(table(spark, sf_dir, "customer"), F.expr("user_id = c_custkey"))
    rows = rows.withColumns(
        {
            "code": F.col("user_id").cast("string"),
            "la": F.expr("array('NORFOLK', 'West Suffolk', 'Ipswich', 'Essex')[c_nationkey % 4]"),
            "score": F.expr("IF(event_id % 11 = 0, 'SUPP', CAST(value AS STRING))"),
            "code_of_post": F.expr("concat('NR', c_custkey % 30 + 1)"),
        }
    )
    # column of the rows -> header name, per year
    headers = {
        "2021-2022": ("click", {"code": "URN", "c_name": "SCHNAME", "c_mktsegment": "TOWN", "la": "NEW_LA_NAME", "score": "ATT8SCR", "code_of_post": "PCODE"}),
        "2022-2023": ("view", {"code": "ESTAB", "c_name": "school_name", "la": "LEA_NAME", "score": "AVG_ATT8"}),
        "2023-2024": ("purchase", {"code": "LAESTAB", "c_name": "SCH_NAME", "la": "LA_NAME", "score": "att8_score", "code_of_post": "POSTCODE"}),
    }
    years = []
    for year, (kind, names) in headers.items():
        scan = rows.where(F.col("event_type") == kind).select(*[F.col(c).alias(header) for c, header in names.items()])
        years.append(cleaning.education_year_rows(scan, year, year))
    return cleaning.merge_education_years(years)


@query(
    "authority_years",
    """SELECT strftime(ts, '%Y-%m') AS academic_year, CASE WHEN c_nationkey % 4 = 0 THEN 'Norfolk' ELSE 'Suffolk' END AS county_name,
  count(*) AS n FROM events JOIN customer ON user_id = c_custkey
WHERE event_type <> 'error' AND c_nationkey % 4 < 3 GROUP BY ALL""",
)
def authority_years(spark, sf_dir):
    rows = table(spark, sf_dir, "events").join(table(spark, sf_dir, "customer"), F.expr("user_id = c_custkey"))
    rows = rows.where("event_type <> 'error'").selectExpr(
        "date_format(ts, 'yyyy-MM') AS academic_year",
        "array('NORFOLK', 'West Suffolk', 'Ipswich Borough', 'Essex')[c_nationkey % 4] AS la_name",
    )
    named = rows.withColumn("county_name", geography.county_of_authority(F.col("la_name")))
    return reshape.frequency(named.where("county_name IS NOT NULL"), "academic_year", "county_name")
