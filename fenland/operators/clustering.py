"""Z-order keys: rows that are near in several columns come near each other in a table's files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BITS = 6  # 64 ranges per column
TEXT_CHARS = 10  # first characters of a text that place it; ten digits of base 36 are exact in a double


def _image(df: DataFrame, name: str) -> Column:
    """The column as a double that grows (for letters and digits strictly) with it."""
    c, kind = F.col(f"`{name}`"), df.schema[name].dataType
    if isinstance(kind, T.StringType):
        padded = F.rpad(F.upper(F.substring(c, 1, TEXT_CHARS)), TEXT_CHARS, "0")
        return F.conv(F.regexp_replace(padded, "[^0-9A-Z]", "0"), 36, 10).cast("double")
    if isinstance(kind, T.DateType):
        return F.unix_date(c).cast("double")
    if isinstance(kind, T.TimestampType | T.TimestampNTZType):
        return c.cast("timestamp").cast("double")
    return c.cast("double")


def _rank(value: Column, cuts: Sequence[float]) -> Column:
    """Number of cut points at or below the value; a null is lowest."""
    below = F.size(F.filter(F.array(*[F.lit(x) for x in cuts]), lambda cut: cut <= value)) if cuts else F.lit(0)
    return F.when(value.isNull(), 0).otherwise(below).cast("long")


def z_key(df: DataFrame, columns: Sequence[str], bits: int = BITS) -> Column:
    """Key whose bits are those of the columns' ranges, taken in turn.

    The ranges hold about equally many rows: one aggregate over the named columns gives their
    cut points, 2 ** bits - 1 numbers per column.
    """
    shares = [k / 2**bits for k in range(1, 2**bits)]
    images = [_image(df, name) for name in columns]
    found = df.agg(*[F.percentile_approx(image, shares, 2000).alias(f"c{k}") for k, image in enumerate(images)]).first()
    # a frequent value repeats as a cut point, so few values still spread over all ranks
    ranks = [_rank(image, found[k] or []) for k, image in enumerate(images)]
    key = F.lit(0).cast("long")
    for bit in range(bits):
        for k, rank in enumerate(ranks):
            key = key.bitwiseOR(F.shiftleft(F.shiftright(rank, bit).bitwiseAND(F.lit(1).cast("long")), bit * len(ranks) + k))
    return key
