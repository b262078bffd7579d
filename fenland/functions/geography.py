"""Postcodes, districts and counties."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from fenland.fixed_values import (
    AUTHORITY_PATTERNS,
    CRIME_DISTRICTS,
    POSTCODE_AREA_COUNTY,
    POSTCODE_DISTRICT_PATTERN,
)
from fenland.functions.text import drop_last_word, strip_blanks


def postcode_key(c: Column) -> Column:
    """Upper case, no blanks."""
    return strip_blanks(F.upper(c))


def postcode_district(key: Column, mode: str = "greedy") -> Column:
    """Postcode district of a blank-free postcode, null when there is none.

    `greedy` takes up to two digits, so a one-digit district swallows the first
    digit of the inward part (`NR11AA` gives `NR11`, not `NR1`); the fixed town
    lookup is keyed that way. `outward` cuts the three inward characters off.
    """
    if mode == "greedy":
        return F.regexp_substr(F.upper(key), F.lit(POSTCODE_DISTRICT_PATTERN))
    if mode == "outward":
        outward = F.substring(F.upper(key), F.lit(1), F.length(key) - 3)
        return F.when(F.length(key) > 4, outward)
    raise ValueError(f"unknown postcode district mode: {mode}")


def county_of_postcode(c: Column) -> Column:
    """County by postcode area; null outside the covered areas."""
    county = F.lit(None).cast("string")
    for area, name in POSTCODE_AREA_COUNTY.items():
        county = F.when(c.startswith(area), F.lit(name)).otherwise(county)
    return county


def county_of_authority(c: Column) -> Column:
    """County by local-authority name, any letter case; the first pattern that fits wins."""
    county = F.lit(None).cast("string")
    for pattern, name in reversed(list(AUTHORITY_PATTERNS.items())):
        county = F.when(c.rlike(f"(?i){pattern}"), F.lit(name)).otherwise(county)
    return county


def lsoa_district(lsoa_name: Column) -> Column:
    """`Norwich 001A` -> `Norwich`."""
    return drop_last_word(lsoa_name)


def inside_boundary(
    county: Column,
    district: Column,
    districts: Mapping[str, Sequence[str]] = CRIME_DISTRICTS,
) -> Column:
    """True when the district belongs to the county that reported the row."""
    inside = F.lit(False)
    for name, members in districts.items():
        inside = inside | ((county == name) & district.isin(*members))
    return F.coalesce(inside, F.lit(False))
