"""Column types learned from all values of text columns.

The types form a lattice: null lies below everything, long below double, date below
timestamp, text above all, and any other two meet in text. Each value sets the bit of
the narrowest type it can be; `bit_or` joins the bits of all rows, so one map-side combined
aggregate over the whole table is enough and no row is left out.
"""

from __future__ import annotations

from collections.abc import Collection, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# type -> bit, pattern of its values; a number with a leading zero is a code and stays text
_KINDS = {
    "boolean": (1, "^(?i:true|false|t|f)$"),
    "long": (2, r"^[+-]?(0|[1-9][0-9]{0,17})$"),
    "double": (4, r"^[+-]?(0|[1-9][0-9]*)?(?<=[0-9])(\.[0-9]*)?([eE][+-]?[0-9]{1,3})?$|^[+-]?\.[0-9]+([eE][+-]?[0-9]{1,3})?$"),
    "date": (8, r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"),
    "timestamp": (16, r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[ T][0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]{1,6})?)?$"),
}
TEXT_BIT = 32
_BIT = {name: bit for name, (bit, _) in _KINDS.items()}
# bits that occur together -> joined type; every other mixture is text
_JOINED = {
    **{bit: name for name, bit in _BIT.items()},
    _BIT["long"] | _BIT["double"]: "double",
    _BIT["date"] | _BIT["timestamp"]: "timestamp",
}
SPARK_TYPES = {
    "boolean": T.BooleanType(),
    "long": T.LongType(),
    "double": T.DoubleType(),
    "date": T.DateType(),
    "timestamp": T.TimestampNTZType(),
    "string": T.StringType(),
}


def value_bit(c: Column) -> Column:
    """Bit of the narrowest type of one value; 0 for null, text for days and times that do not exist.

    Cheap tests on the first character and the length come first, so a word meets no pattern at all.
    """

    def fits(name: str) -> Column:
        return c.rlike(_KINDS[name][1])

    def real(name: str) -> Column:
        return fits(name) & c.try_cast(SPARK_TYPES[name]).isNotNull()

    size, first = F.length(c), F.ascii(c)  # signs, point and digits are 43 to 57
    return (
        F.when(c.isNull(), 0)
        .when(~first.between(43, 57), F.when((size <= 5) & fits("boolean"), _BIT["boolean"]).otherwise(TEXT_BIT))
        .when((size == 10) & real("date"), _BIT["date"])
        .when((size >= 16) & real("timestamp"), _BIT["timestamp"])
        .when(fits("long"), _BIT["long"])
        .when(fits("double"), _BIT["double"])
        .otherwise(TEXT_BIT)
    )


def joined_type(bits: Column) -> Column:
    """Name of the type that holds all values with these bits; a column of nulls is text."""
    name = F.lit("string")
    for mixture, kind in _JOINED.items():
        name = F.when(bits == mixture, kind).otherwise(name)
    return name


def column_types(df: DataFrame, *columns: str) -> DataFrame:
    """column_name, type, present, missing of every named (or every) text column, in one pass over the table."""
    names = list(columns) or df.columns
    found = [
        F.struct(
            F.lit(name).alias("column_name"),
            joined_type(F.bit_or(value_bit(F.col(f"`{name}`")))).alias("type"),
            F.count(f"`{name}`").alias("present"),
            F.count_if(F.col(f"`{name}`").isNull()).alias("missing"),
        )
        for name in names
    ]
    return df.agg(F.array(*found).alias("_found")).select(F.explode("_found").alias("_one")).select("_one.*")


def typed(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """The columns cast to their types (`long`, `double`, ... as `column_types` names them); others stay."""

    def cast(name: str) -> Column:
        c = F.col(f"`{name}`")
        kind = types.get(name, "string")
        if kind == "boolean":
            return F.lower(F.substring(c, 1, 1)).isin("t").alias(name)
        return c.alias(name) if kind == "string" else c.cast(SPARK_TYPES[kind]).alias(name)

    return df.select(*[cast(name) if name in types else F.col(f"`{name}`") for name in df.columns])


def infer(df: DataFrame, keep_text: Collection[str] = (), keep: Collection[str] = ()) -> DataFrame:
    """Text columns with the types their values have; `keep_text` stay text (codes), `keep` stay as they are.

    One row per column comes to the driver.
    """
    names = [name for name in df.columns if name not in keep and name not in keep_text]
    if not names:
        return df
    return typed(df, {row.column_name: row.type for row in column_types(df, *names).collect()})
