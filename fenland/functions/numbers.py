"""Numbers from text, rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fenland.functions.text import trim_all

_DECIMAL = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def to_number(c: Column) -> Column:
    """Double, or null when the text is not a plain decimal number.

    A bare `cast` raises in ANSI mode and `try_cast` takes `1d` for 1.0, hence
    the pattern.
    """
    return F.regexp_substr(trim_all(c.cast("string")), F.lit(_DECIMAL)).try_cast("double")


def round_even(c: Column, digits: int) -> Column:
    """Round half to even."""
    return F.bround(c, digits)


def safe_ratio(top: Column, bottom: Column) -> Column:
    """Quotient as double; null for a zero divisor."""
    return F.try_divide(top.cast("double"), bottom.cast("double"))


def rate_per_100k(count: Column, population: Column) -> Column:
    return safe_ratio(count, population) * F.lit(100000.0)
