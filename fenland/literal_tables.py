"""The fixed values as small DataFrames (131 rows at most, so safe to broadcast)."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from fenland import fixed_values, schemas


def literal_table(spark: SparkSession, rows: Sequence[tuple], schema: T.StructType) -> DataFrame:
    """Rows as a local relation: its size is known to the optimizer, no Python worker reads it."""
    columns = list(zip(*rows)) if rows else [[] for _ in schema]
    arrow = pa.Table.from_arrays(
        [pa.array(values, field.type) for values, field in zip(columns, to_arrow_schema(schema))],
        schema=to_arrow_schema(schema),
    )
    return spark.createDataFrame(arrow, schema)


def county_table(spark: SparkSession) -> DataFrame:
    return literal_table(spark, fixed_values.COUNTIES, schemas.WAREHOUSE["dim_county"])


def district_table(spark: SparkSession) -> DataFrame:
    ids = {name: county_id for county_id, name in fixed_values.COUNTIES}
    rows = [(district_id, name, ids[county]) for district_id, name, county in fixed_values.DISTRICTS]
    return literal_table(spark, rows, schemas.WAREHOUSE["dim_district"])


def town_lookup(spark: SparkSession) -> DataFrame:
    return literal_table(spark, fixed_values.POSTCODE_TOWNS, schemas.TOWN_LOOKUP)


def span_months(spark: SparkSession) -> DataFrame:
    return literal_table(spark, fixed_values.SPAN_MONTHS, schemas.SPAN_MONTHS)
