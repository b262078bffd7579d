"""Display text built next to the numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MACHINE_EPSILON = 2.220446049250313e-16


def pounds(c: Column) -> Column:
    """`£250,000`"""
    return F.concat(F.lit("£"), F.format_number(F.bround(c, 0), 0))


def thousand_pounds(c: Column) -> Column:
    """`£250k`"""
    return F.concat(F.lit("£"), F.format_number(F.bround(c / 1000.0, 0), 0), F.lit("k"))


def short_number(c: Column, digits: int) -> Column:
    """Rounded half to even, trailing zeros dropped: `12.5`, `12`."""
    fixed = F.format_string(f"%.{digits}f", F.bround(c, digits))
    return F.regexp_replace(fixed, r"\.?0+$", "") if digits > 0 else fixed


def named_value(name: Column, value: Column, digits: int = 1) -> Column:
    """`Norwich (12.5)`"""
    return F.concat(name, F.lit(" ("), short_number(value, digits), F.lit(")"))


def percent(c: Column, digits: int = 1) -> Column:
    return F.concat(short_number(c, digits), F.lit("%"))


def p_value_text(p: Column, digits: int = 3) -> Column:
    """p-value with `digits` significant digits; below the machine epsilon only a bound."""
    shown = max(1, digits - 2)
    bound = f"{MACHINE_EPSILON:.{shown - 1}e}"
    bound = f"<{bound}" if shown == 1 else f"< {bound}"
    plain = F.regexp_replace(F.format_string(f"%.{digits}g", p), r"(\.[0-9]*?)0+$", "$1")
    plain = F.regexp_replace(plain, r"\.$", "")
    power = F.regexp_replace(F.format_string(f"%.{digits - 1}e", p), r"\.?0+e", "e")
    return F.when(p < MACHINE_EPSILON, F.lit(bound)).when(p >= 0.001, plain).otherwise(power)


def fit_caption(prefix: Column, r_squared: Column, p: Column) -> Column:
    """`<prefix> | R² = 0.123, p = 0.045`"""
    return F.concat(
        prefix, F.lit(" | R² = "), F.format_string("%.3f", r_squared), F.lit(", p = "), p_value_text(p, 3)
    )
