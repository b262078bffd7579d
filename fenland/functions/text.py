"""Text clean-up."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


# The code points with the Unicode White_Space property.
BLANKS = "".join(
    map(chr, [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
)


# Most values are clean already. One pass over a value tells, and then the rewriting
# chain, several times dearer, is left out; results are the same either way.
_TRIMMED = "^[!-~](?:[ -~]*[!-~])?$"
_SQUISHED = "^[!-~]++(?: [!-~]++)*+$"
_PRINTABLE = r"^[ -~]*\z"  # the only blank in it is the space
_ONE_CASE = "^[A-Za-z0-9' ]*$"


def trim_all(c: Column) -> Column:
    """Strip every Unicode blank from both ends (`trim` strips spaces only)."""
    return F.when(c.rlike(_TRIMMED), c).when(c.rlike(_PRINTABLE), F.trim(c)).otherwise(F.btrim(c, F.lit(BLANKS)))


def squish(c: Column) -> Column:
    """`trim_all`, and each inner run of blanks becomes one space."""
    spaces = F.translate(c, BLANKS, " " * len(BLANKS))
    plain = F.trim(F.regexp_replace(c, " {2,}", " "))
    return F.when(c.rlike(_SQUISHED), c).when(c.rlike(_PRINTABLE), plain).otherwise(F.btrim(F.regexp_replace(spaces, " {2,}", " ")))


def strip_blanks(c: Column) -> Column:
    """Remove every blank."""
    return F.regexp_replace(c, r"(?U)\s+", "")


def not_blank(c: Column) -> Column:
    """`trim_all(c) != ""`; a printable ASCII character settles it."""
    return F.when(c.rlike("[!-~]"), True).otherwise(F.btrim(c, F.lit(BLANKS)) != "")


def title_case(c: Column) -> Column:
    """Capitalise each word; a word ends at anything but a letter, digit or apostrophe.

    `initcap` starts words at spaces only and leaves `Wells-next-the-sea`, so
    every other separator gets a marked space behind it for the moment.
    """

    def cased(c: Column) -> Column:
        marked = F.regexp_replace(c, r"([^\p{L}\p{N}' ])", "$1\u0001 ")
        split = F.replace(F.initcap(marked), F.lit("\u0001 "), F.lit(""))
        return F.when(c.rlike(_ONE_CASE), F.initcap(c)).otherwise(split)

    return F.transform(F.array(c), cased)[0]  # the array works the text out once


def drop_last_word(c: Column) -> Column:
    """Remove the last alphanumeric word and the blanks before it."""
    return trim_all(F.regexp_replace(c, r"(?U)\s+[A-Za-z0-9]+$", ""))


def has_text(c: Column) -> Column:
    """True when the value is present and not empty, null when it is missing."""
    return c != ""


def or_default(c: Column, default: str) -> Column:
    """`default` in place of null."""
    return F.coalesce(c, F.lit(default))


def blank_to(c: Column, default: str) -> Column:
    """`default` in place of null or empty text."""
    return F.when(has_text(c), c).otherwise(F.lit(default))


def null_if_any(c: Column, *markers: str) -> Column:
    """Null in place of each marker text."""
    return F.when(c.isin(*markers), F.lit(None)).otherwise(c)
