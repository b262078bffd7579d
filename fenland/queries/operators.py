"""Single operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from fenland.functions import dates, geography, labels, numbers, text
from fenland.operators import dedup, inference, lookup, numbering, profile, reshape
from fenland.queries.registry import query
from fenland.queries.standin import TABLES_SQL, postcode_text, rounded, table, warehouse

# ---- duplicates, keys ----------------------------------------------------


@query(
    "first_row_dedup",
    """SELECT o_custkey, o_orderkey, o_orderstatus, o_totalprice, CAST(o_orderdate AS DATE) AS o_orderdate FROM orders
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1""",
)
def first_row_dedup(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(
        "o_custkey", "o_orderkey", "o_orderstatus", "o_totalprice", F.col("o_orderdate").cast("date").alias("o_orderdate")
    )
    return dedup.first_rows(orders, ["o_custkey"], ["o_orderdate", "o_orderkey"])


@query("distinct_rows", "SELECT DISTINCT CAST(o_custkey % 50 AS BIGINT) AS grp, o_orderpriority FROM orders")
def distinct_rows(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return dedup.distinct_rows(orders.select((F.col("o_custkey") % 50).alias("grp"), "o_orderpriority"))


@query(
    "surrogate_keys",
    """SELECT row_number() OVER (ORDER BY o_orderkey % 4096, o_orderkey) AS transaction_pk, o_orderkey, o_totalprice
FROM orders""",
)
def surrogate_keys(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    bucket = F.pmod(F.col("o_orderkey"), F.lit(4096))
    return numbering.number_rows(orders, "transaction_pk", bucket, ["o_orderkey"])


@query(
    "duplicate_count",
    """SELECT CAST(count(*) - count(DISTINCT (o_custkey, o_orderpriority)) AS BIGINT) AS duplicates FROM orders""",
)
def duplicate_count(spark, sf_dir):
    return dedup.duplicate_count(table(spark, sf_dir, "orders"), "o_custkey", "o_orderpriority")


@query(
    "distinct_counts",
    TABLES_SQL
    + """SELECT 'sales' AS source, count(DISTINCT postcode) AS n_distinct FROM fact_house_price
UNION ALL SELECT 'broadband', count(DISTINCT postcode) FROM fact_broadband
UNION ALL SELECT 'schools', count(DISTINCT postcode) FROM dim_school""",
)
def distinct_counts(spark, sf_dir):
    w = warehouse(spark, sf_dir)
    sources = {"sales": w.fact_house_price, "broadband": w.fact_broadband, "schools": w.dim_school}
    counts = [dedup.distinct_count(df, "postcode").select(F.lit(n).alias("source"), "n_distinct") for n, df in sources.items()]
    return lookup.union_by_name(*counts)


# ---- joins, sets ---------------------------------------------------------


@query(
    "semi_population",
    TABLES_SQL
    + """SELECT lsoa_code, population FROM fact_population p
WHERE EXISTS (SELECT 1 FROM fact_crime c WHERE c.lsoa_code = p.lsoa_code AND c.year = 1995)""",
)
def semi_population(spark, sf_dir):
    w = warehouse(spark, sf_dir)
    return lookup.keep_known(w.fact_population, w.fact_crime.where("year = 1995"), "lsoa_code")


_SOME_DIMS = """, some_districts AS (SELECT * FROM dim_district WHERE county_id < 4),
some_areas AS (SELECT * FROM dim_lsoa WHERE county_id < 4), some_schools AS (SELECT * FROM dim_school WHERE county_id < 4)
"""


@query(
    "orphans",
    TABLES_SQL
    + _SOME_DIMS
    + """SELECT 'fact_house_price' AS fact, count(*) AS orphans FROM fact_house_price f
  LEFT JOIN some_districts d ON f.district_id = d.district_id WHERE d.district_id IS NULL
UNION ALL SELECT 'fact_crime', count(*) FROM fact_crime f
  LEFT JOIN some_areas d ON f.lsoa_code = d.lsoa_code WHERE d.lsoa_code IS NULL
UNION ALL SELECT 'fact_population', count(*) FROM fact_population f
  LEFT JOIN some_areas d ON f.lsoa_code = d.lsoa_code WHERE d.lsoa_code IS NULL
UNION ALL SELECT 'fact_education', count(*) FROM fact_education f
  LEFT JOIN some_schools d ON f.estab = d.estab WHERE d.estab IS NULL""",
)
def orphans(spark, sf_dir):
    w = warehouse(spark, sf_dir)
    areas = w.dim_lsoa.where("county_id < 4")
    checks = {
        "fact_house_price": (w.fact_house_price, w.dim_district.where("county_id < 4"), "district_id"),
        "fact_crime": (w.fact_crime, areas, "lsoa_code"),
        "fact_population": (w.fact_population, areas, "lsoa_code"),
        "fact_education": (w.fact_education, w.dim_school.where("county_id < 4"), "estab"),
    }
    return lookup.orphan_counts(checks, "fact")


@query(
    "left_lookup",
    """SELECT r_name AS county_name, count(*) AS n, round(avg(s_acctbal), 4) AS avg_acctbal
FROM supplier LEFT JOIN (SELECT * FROM nation WHERE n_regionkey < 4) n ON s_nationkey = n_nationkey
LEFT JOIN region ON n_regionkey = r_regionkey GROUP BY r_name""",
)
def left_lookup(spark, sf_dir):
    supplier = table(spark, sf_dir, "supplier").select("s_nationkey", "s_acctbal")
    nation = table(spark, sf_dir, "nation").where("n_regionkey < 4").select("n_nationkey", "n_regionkey")
    region = table(spark, sf_dir, "region").select("r_regionkey", F.col("r_name").alias("county_name"))
    named = lookup.attach(supplier, nation, "s_nationkey", "n_nationkey", fixed_size=True)
    named = lookup.attach(named, region, "n_regionkey", "r_regionkey", fixed_size=True)
    out = named.groupBy("county_name").agg(F.count("*").alias("n"), F.avg("s_acctbal").alias("avg_acctbal"))
    return rounded(out, 4, "avg_acctbal")


@query(
    "matched_lookup",
    """SELECT o_orderkey, o_totalprice, n_name AS district_name FROM orders JOIN customer ON o_custkey = c_custkey
JOIN (SELECT * FROM nation WHERE n_regionkey < 4) n ON c_nationkey = n_nationkey""",
)
def matched_lookup(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nation = table(spark, sf_dir, "nation").where("n_regionkey < 4")
    nation = nation.select("n_nationkey", F.col("n_name").alias("district_name"))
    named = lookup.attach(orders, customer, "o_custkey", "c_custkey")
    named = lookup.attach(named, nation, "c_nationkey", "n_nationkey", fixed_size=True)
    return named.where("district_name IS NOT NULL").select("o_orderkey", "o_totalprice", "district_name")


@query(
    "union_by_name",
    """SELECT 'customer' AS source, c_name AS name, c_acctbal AS acctbal, c_mktsegment AS segment FROM customer
UNION ALL SELECT 'supplier', s_name, s_acctbal, NULL FROM supplier""",
)
def union_by_name(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select(
        F.lit("customer").alias("source"),
        F.col("c_name").alias("name"),
        F.col("c_acctbal").alias("acctbal"),
        F.col("c_mktsegment").alias("segment"),
    )
    suppliers = table(spark, sf_dir, "supplier").select(
        F.col("s_acctbal").alias("acctbal"), F.col("s_name").alias("name"), F.lit("supplier").alias("source")
    )
    return lookup.union_by_name(customers, suppliers)


@query(
    "years_present",
    TABLES_SQL
    + """SELECT DISTINCT 'sales' AS fact, year FROM fact_house_price
UNION ALL SELECT DISTINCT 'crime' AS fact, year FROM fact_crime""",
)
def years_present(spark, sf_dir):
    w = warehouse(spark, sf_dir)
    facts = {"sales": w.fact_house_price, "crime": w.fact_crime}
    years = [lookup.sorted_values(df, "year").select(F.lit(n).alias("fact"), "year") for n, df in facts.items()]
    return lookup.union_by_name(*years)


# ---- filters, sorts ------------------------------------------------------


@query(
    "span_filter",
    """SELECT l_returnflag, count(*) AS n, round(sum(l_quantity), 2) AS sum_qty FROM lineitem
WHERE l_shipdate >= TIMESTAMP '1998-05-01' AND l_shipdate < TIMESTAMP '1999-05-01' GROUP BY l_returnflag""",
)
def span_filter(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").where(dates.in_span(F.col("l_shipdate"), "1998-05-01", "1999-05-01"))
    return lines.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("sum_qty"))


@query(
    "named_parameters",
    """SELECT strftime(l_shipdate, '%Y-%m') AS year_month, l_linestatus, count(*) AS crime_count FROM lineitem
WHERE l_returnflag = 'A' AND year(l_shipdate) = 1997 GROUP BY ALL""",
)
def named_parameters(spark, sf_dir):
    return spark.sql(
        """SELECT date_format(l_shipdate, 'yyyy-MM') AS year_month, l_linestatus, count(*) AS crime_count
FROM {lines} WHERE l_returnflag = :kind AND l_shipdate >= CAST(:first AS DATE) AND l_shipdate < CAST(:until AS DATE)
GROUP BY year_month, l_linestatus""",
        args={"kind": "A", "first": "1997-01-01", "until": "1998-01-01"},
        lines=table(spark, sf_dir, "lineitem"),
    )


@query(
    "top_prices",
    "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10",
)
def top_prices(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return lookup.preview(orders, [F.desc("o_totalprice"), F.col("o_orderkey")], 10)


# ---- reshape, frequency --------------------------------------------------


@query(
    "frequency_table",
    """SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY o_orderpriority ORDER BY n DESC, o_orderpriority""",
)
def frequency_table(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return reshape.frequency(orders, "o_orderpriority").orderBy(F.desc("n"), "o_orderpriority")


_STATUSES = ["F", "O", "P", "X"]


@query(
    "cross_tab",
    "SELECT o_orderpriority, "
    + ", ".join(f"count(CASE WHEN o_orderstatus = '{s}' THEN 1 END) AS \"{s}\"" for s in _STATUSES)
    + " FROM orders GROUP BY o_orderpriority",
)
def cross_tab(spark, sf_dir):
    return reshape.cross_tab(table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderstatus", _STATUSES)


# ---- profile -------------------------------------------------------------


@query(
    "null_profile",
    """SELECT 'p_brand' AS column_name, count(*) - count(nullif(p_brand, 'Brand#1')) AS missing FROM part
UNION ALL SELECT 'p_name', count(*) - count(p_name) FROM part
UNION ALL SELECT 'p_size', count(*) - count(nullif(p_size, 1)) FROM part""",
)
def null_profile(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(
        text.null_if_any(F.col("p_brand"), "Brand#1").alias("p_brand"),
        "p_name",
        F.nullif(F.col("p_size"), F.lit(1)).alias("p_size"),
    )
    return profile.missing_counts(part)


def _summary_sql(column: str, expr: str) -> str:
    return (
        f"SELECT '{column}' AS column_name, CAST(min({expr}) AS DOUBLE) AS minimum, "
        f"round(quantile_cont({expr}, 0.25), 4) AS q1, round(quantile_cont({expr}, 0.5), 4) AS median, "
        f"round(avg({expr}), 4) AS mean, round(quantile_cont({expr}, 0.75), 4) AS q3, "
        f"CAST(max({expr}) AS DOUBLE) AS maximum, count(*) - count({expr}) AS missing FROM part"
    )


@query(
    "column_summary",
    _summary_sql("p_size", "nullif(p_size, 1)") + " UNION ALL " + _summary_sql("p_retailprice", "p_retailprice"),
)
def column_summary(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(
        F.nullif(F.col("p_size"), F.lit(1)).alias("p_size"), "p_retailprice"
    )
    return rounded(profile.column_summary(part, "p_size", "p_retailprice"), 4, "q1", "median", "mean", "q3")


_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]


@query(
    "table_row_counts",
    " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n FROM {t}" for t in _TABLES),
)
def table_row_counts(spark, sf_dir):
    return profile.table_counts({name: table(spark, sf_dir, name) for name in _TABLES})


# ---- dirty input ---------------------------------------------------------


@query(
    "dirty_numbers",
    """SELECT p_partkey, CASE WHEN p_size % 7 IN (0, 1) THEN NULL ELSE CAST(p_size AS DOUBLE) END AS score FROM part""",
)
def dirty_numbers(spark, sf_dir):
    raw = F.expr("CASE WHEN p_size % 7 = 0 THEN 'NE' WHEN p_size % 7 = 1 THEN 'SUPP' ELSE CAST(p_size AS STRING) END")
    score = numbers.to_number(text.null_if_any(raw, "NE", "SUPP"))
    return table(spark, sf_dir, "part").select("p_partkey", score.alias("score"))


_DATE_TEXT = """CASE WHEN o_orderkey % 9 = 5 THEN strftime(o_orderdate, '%d %B %Y') WHEN o_orderkey % 9 = 7 THEN strftime(o_orderdate, '%b-%d-%y')
  ELSE CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%-m/%-d/%Y') WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d')
  WHEN 2 THEN '28' || strftime(o_orderdate, '/%-m/%Y') ELSE 'junk' END END"""


def _mixed_dates(spark, sf_dir):
    raw = F.expr(
        """CASE WHEN o_orderkey % 9 = 5 THEN date_format(o_orderdate, 'dd MMMM yyyy') WHEN o_orderkey % 9 = 7 THEN date_format(o_orderdate, 'MMM-dd-yy')
           ELSE CASE o_orderkey % 4 WHEN 0 THEN date_format(o_orderdate, 'M/d/yyyy')
           WHEN 1 THEN date_format(o_orderdate, 'yyyy-MM-dd')
           WHEN 2 THEN concat('28', date_format(o_orderdate, '/M/yyyy')) ELSE 'junk' END END"""
    )
    rows = table(spark, sf_dir, "orders").select("o_orderkey", raw.alias("raw"))
    return rows.withColumn("parsed", dates.mixed_date(F.col("raw"), ["mdy", "ymd", "dmy"]))


@query(
    "mixed_dates",
    f"""SELECT o_orderkey, {_DATE_TEXT} AS raw,
  CASE WHEN o_orderkey % 9 IN (5, 7) THEN CAST(o_orderdate AS DATE) ELSE CASE o_orderkey % 4 WHEN 2 THEN make_date(year(o_orderdate), month(o_orderdate), 28)
    WHEN 3 THEN NULL ELSE CAST(o_orderdate AS DATE) END END AS parsed FROM orders""",
)
def mixed_dates(spark, sf_dir):
    return _mixed_dates(spark, sf_dir)


@query("unparsed_dates", "SELECT count(CASE WHEN o_orderkey % 4 = 3 AND o_orderkey % 9 NOT IN (5, 7) THEN 1 END) AS unparsed, count(*) AS total FROM orders")
def unparsed_dates(spark, sf_dir):
    return profile.unparsed_count(_mixed_dates(spark, sf_dir), "parsed")


@query(
    "trained_dates",
    """SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day_first, CAST(o_orderdate AS DATE) AS month_first,
  strftime(o_orderdate, '%Y-%m-%d') AS iso_day FROM orders""",
)
def trained_dates(spark, sf_dir):
    """One day written day first in one column and month first in another; the values tell which is which."""
    rows = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey", "date_format(o_orderdate, 'd/M/yyyy') AS day_first", "date_format(o_orderdate, 'M/d/yyyy') AS month_first"
    )
    orders = ["mdy", "ymd", "dmy"]
    read = {name: dates.mixed_date(F.col(name), dates.trained_orders(rows, name, orders)) for name in ("day_first", "month_first")}
    return rows.withColumns(read).withColumn("iso_day", dates.iso_text(F.col("day_first")))


@query(
    "order_counts",
    """SELECT count(CASE WHEN k = 0 OR (k = 2 AND d <= 12) THEN 1 END) AS mdy, count(CASE WHEN k = 1 THEN 1 END) AS ymd,
  count(CASE WHEN k = 2 OR (k = 0 AND d <= 12) THEN 1 END) AS dmy
FROM (SELECT o_orderkey % 4 AS k, day(o_orderdate) AS d FROM orders)""",
)
def order_counts(spark, sf_dir):
    """Values of a mixed column that are a date in each order."""
    rows = table(spark, sf_dir, "orders").selectExpr(
        """CASE o_orderkey % 4 WHEN 0 THEN date_format(o_orderdate, 'M/d/yyyy') WHEN 1 THEN date_format(o_orderdate, 'yyyy-MM-dd')
           WHEN 2 THEN date_format(o_orderdate, 'dd.MM.yyyy') ELSE 'junk' END AS raw"""
    )
    return dates.order_counts(rows, "raw", ["mdy", "ymd", "dmy"])


# ---- types ---------------------------------------------------------------

_TYPED_COLUMNS = {
    "order_key": "CAST(l_orderkey AS STRING)",
    "quantity": "CAST(l_quantity AS STRING)",
    "ship_day": "date_format(l_shipdate, 'yyyy-MM-dd')",
    "ship_moment": "IF(l_linenumber = 1, date_format(l_shipdate, 'yyyy-MM-dd'), date_format(l_shipdate, 'yyyy-MM-dd HH:mm'))",
    "no_day": "IF(l_orderkey % 1000 = 7, '2023-02-30', date_format(l_shipdate, 'yyyy-MM-dd'))",
    "code": "lpad(CAST(l_linenumber AS STRING), 3, '0')",
    "suppressed": "IF(l_orderkey % 1000 = 7, 'NE', CAST(l_quantity AS STRING))",
    "flag": "IF(l_linestatus = 'O', 'TRUE', 'false')",
    "flag_or_number": "IF(l_linestatus = 'O', 'TRUE', '1')",
    "sparse": "IF(l_orderkey % 3 = 0, CAST(l_linenumber AS STRING), NULL)",
    "nothing": "CAST(NULL AS STRING)",
}


def _typed_sql(name: str, expr: str) -> str:
    expr = expr.replace("AS STRING", "AS VARCHAR").replace("IF(", "if(")
    for spark_form, duck_form in (("'yyyy-MM-dd HH:mm'", "'%Y-%m-%d %H:%M'"), ("'yyyy-MM-dd'", "'%Y-%m-%d'")):
        expr = expr.replace(spark_form, duck_form)
    return f"SELECT '{name}' AS column_name, {expr.replace('date_format(', 'strftime(')} AS v FROM lineitem"


@query(
    "inferred_types",
    f"""WITH long AS ({" UNION ALL ".join(_typed_sql(name, expr) for name, expr in _TYPED_COLUMNS.items())}),
looks AS (
  SELECT column_name, v, regexp_matches(v, '^[+-]?0[0-9]') AS code, try_cast(v AS BIGINT) IS NOT NULL AND NOT contains(v, '.') AS whole,
    try_cast(v AS DOUBLE) IS NOT NULL AS number, length(v) = 10 AND try_cast(v AS DATE) IS NOT NULL AS day,
    length(v) = 16 AND try_cast(v AS TIMESTAMP) IS NOT NULL AS moment, lower(v) IN ('true', 'false', 't', 'f') AS flag
  FROM long)
SELECT column_name, CASE WHEN count(v) = 0 THEN 'string' WHEN bool_and(flag) FILTER (v IS NOT NULL) THEN 'boolean' WHEN bool_and(whole AND NOT code) FILTER (v IS NOT NULL) THEN 'long'
  WHEN bool_and(number AND NOT code) FILTER (v IS NOT NULL) THEN 'double' WHEN bool_and(day) FILTER (v IS NOT NULL) THEN 'date' WHEN bool_and(day OR moment) FILTER (v IS NOT NULL) THEN 'timestamp'
  ELSE 'string' END AS type, count(v) AS present, count(*) - count(v) AS missing
FROM looks GROUP BY column_name""",
)
def inferred_types(spark, sf_dir):
    """Types of text columns made from every line, with clashes in one value of a thousand."""
    rows = table(spark, sf_dir, "lineitem").selectExpr(*[f"{expr} AS {name}" for name, expr in _TYPED_COLUMNS.items()])
    return inference.column_types(rows)


@query(
    "month_buckets",
    """SELECT strftime(o_orderdate, '%Y-%m') AS month_text, CAST(date_trunc('month', o_orderdate) AS DATE) AS month,
  CAST(year(o_orderdate) AS INT) AS year, count(*) AS n FROM orders GROUP BY ALL""",
)
def month_buckets(spark, sf_dir):
    months = table(spark, sf_dir, "orders").select(dates.year_month(F.col("o_orderdate")).alias("month_text"))
    counts = months.groupBy("month_text").agg(F.count("*").alias("n"))
    month = dates.month_start(F.col("month_text"))
    return counts.select("month_text", month.alias("month"), F.year(month).alias("year"), "n")


@query(
    "text_normalise",
    """SELECT p_partkey, trim(upper(p_name)) AS upper_name,
  array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), '-') AS title_name,
  p_name || ' x' AS squished, replace(upper(p_name), ' ', '') AS bare,
  p_brand AS without_code FROM part""",
)
def text_normalise(spark, sf_dir):
    padded = F.concat(F.lit("  "), F.upper("p_name"), F.lit("\t "))
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        text.trim_all(padded).alias("upper_name"),
        text.title_case(F.replace(F.upper("p_name"), F.lit(" "), F.lit("-"))).alias("title_name"),
        text.squish(F.concat(F.lit(" "), F.replace("p_name", F.lit(" "), F.lit("   ")), F.lit("  x "))).alias("squished"),
        text.strip_blanks(padded).alias("bare"),
        text.drop_last_word(F.concat("p_brand", F.lit("  001A"))).alias("without_code"),
    )


@query(
    "postcode_districts",
    """WITH p AS (SELECT c_custkey, upper(substr(c_mktsegment, 1, 2)) || CAST(c_custkey % 30 + 1 AS VARCHAR) AS outward,
  CAST(c_custkey % 10 AS VARCHAR) || 'AA' AS inward FROM customer)
SELECT c_custkey, outward || inward AS postcode, regexp_extract(outward || inward, '^[A-Z]{1,2}[0-9]{1,2}') AS greedy,
  outward FROM p""",
)
def postcode_districts(spark, sf_dir):
    key = geography.postcode_key(postcode_text()).alias("postcode")
    rows = table(spark, sf_dir, "customer").select("c_custkey", key)
    return rows.withColumns(
        {
            "greedy": geography.postcode_district(F.col("postcode")),
            "outward": geography.postcode_district(F.col("postcode"), "outward"),
        }
    )


@query(
    "county_case",
    """WITH c AS (SELECT CASE WHEN c_mktsegment = 'BUILDING' THEN 'NR' || CAST(c_custkey % 9 AS VARCHAR)
    WHEN c_mktsegment = 'MACHINERY' THEN 'IP' || CAST(c_custkey % 9 AS VARCHAR) ELSE 'CB1' END AS postcode,
  CASE WHEN c_mktsegment = 'BUILDING' THEN 'NORFOLK County' WHEN c_mktsegment = 'MACHINERY' THEN 'Mid Suffolk'
    WHEN c_mktsegment = 'HOUSEHOLD' THEN 'ipswich' ELSE 'Essex' END AS authority FROM customer)
SELECT CASE WHEN postcode LIKE 'NR%' THEN 'Norfolk' WHEN postcode LIKE 'IP%' THEN 'Suffolk' END AS by_postcode,
  CASE WHEN authority ILIKE '%norfolk%' THEN 'Norfolk'
    WHEN authority ILIKE '%suffolk%' OR authority ILIKE '%ipswich%' THEN 'Suffolk' END AS by_authority,
  count(*) AS n FROM c GROUP BY ALL""",
)
def county_case(spark, sf_dir):
    postcode = F.expr(
        """CASE WHEN c_mktsegment = 'BUILDING' THEN concat('NR', CAST(c_custkey % 9 AS STRING))
           WHEN c_mktsegment = 'MACHINERY' THEN concat('IP', CAST(c_custkey % 9 AS STRING)) ELSE 'CB1' END"""
    )
    authority = F.expr(
        """CASE WHEN c_mktsegment = 'BUILDING' THEN 'NORFOLK County' WHEN c_mktsegment = 'MACHINERY' THEN 'Mid Suffolk'
           WHEN c_mktsegment = 'HOUSEHOLD' THEN 'ipswich' ELSE 'Essex' END"""
    )
    rows = table(spark, sf_dir, "customer").select(
        geography.county_of_postcode(postcode).alias("by_postcode"),
        geography.county_of_authority(authority).alias("by_authority"),
    )
    return reshape.frequency(rows, "by_postcode", "by_authority")


@query(
    "boundary_flags",
    """WITH x AS (SELECT r_name, n_name, r_name = 'ASIA' AND n_name IN ('NATION_2', 'NATION_7') AS inside
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey)
SELECT r_name AS county_name, count(CASE WHEN inside THEN 1 END) AS inside, count(CASE WHEN NOT inside THEN 1 END) AS outside
FROM x GROUP BY r_name""",
)
def boundary_flags(spark, sf_dir):
    w = warehouse(spark, sf_dir)
    counts = w.fact_crime.groupBy("lsoa_code").agg(F.count("*").alias("n"))
    areas = w.dim_lsoa.join(F.broadcast(w.dim_county), "county_id")
    district = geography.lsoa_district(F.col("lsoa_name"))
    inside = geography.inside_boundary(F.col("county_name"), district, {"ASIA": ["NATION_2", "NATION_7"]})
    return (
        counts.join(areas, "lsoa_code")
        .withColumn("inside", inside)
        .groupBy("county_name")
        .agg(
            F.sum(F.expr("IF(inside, n, 0L)")).alias("inside"),
            F.sum(F.expr("IF(inside, 0L, n)")).alias("outside"),
        )
    )


@query(
    "label_text",
    """SELECT o_orderkey, '£' || format('{:,}', CAST(round_even(o_totalprice, 0) AS BIGINT)) AS price_label,
  '£' || format('{:,}', CAST(round_even(o_totalprice / 1000, 0) AS BIGINT)) || 'k' AS short_label,
  o_orderstatus || ' (' || CAST(CAST(o_orderkey % 1000 AS INT) AS VARCHAR) || ')' AS named,
  CASE WHEN o_orderpriority = '5-LOW' THEN 'Unknown' ELSE o_orderpriority END AS outcome FROM orders""",
)
def label_text(spark, sf_dir):
    price = F.col("o_totalprice")
    outcome = F.nullif(F.col("o_orderpriority"), F.lit("5-LOW"))
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        labels.pounds(price).alias("price_label"),
        labels.thousand_pounds(price).alias("short_label"),
        labels.named_value(F.col("o_orderstatus"), (F.col("o_orderkey") % 1000).cast("double"), 1).alias("named"),
        text.or_default(outcome, "Unknown").alias("outcome"),
    )
