"""Dates from text, calendar buckets."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fenland.functions.text import trim_all

_YEAR, _MONTH, _DAY = "[0-9]{4}", "(0?[1-9]|1[0-2])", "(0?[1-9]|[12][0-9]|3[01])"

# Order -> shape after `/`, `.` and blanks became `-`, and how its parts make `year-month-day`.
_ORDERS = {
    "mdy": (f"^{_MONTH}-{_DAY}-{_YEAR}$", "$3-$1-$2"),
    "ymd": (f"^{_YEAR}-{_MONTH}-{_DAY}$", "$1-$2-$3"),
    "dmy": (f"^{_DAY}-{_MONTH}-{_YEAR}$", "$3-$2-$1"),
}


def _shaped_date(c: Column, order: str) -> Column:
    """Date from text of one order; null for another shape and for days that do not exist."""
    shape, places = _ORDERS[order]
    arranged = c if order == "ymd" else F.regexp_replace(c, "^([0-9]+)-([0-9]+)-([0-9]+)$", places)
    return F.when(c.rlike(shape), arranged.try_cast("date"))


def _dashed(c: Column) -> Column:
    return F.when(c.rlike("^[0-9-]*$"), c).otherwise(F.regexp_replace(trim_all(c), r"[/., ]+", "-"))


# fixed values: month names by their first three letters
_MONTH_NAMES = "jan feb mar apr may jun jul aug sep oct nov dec".split()


def _numbered_month(c: Column) -> Column:
    """The month name, short or long, as a number; null where the letters begin no month's name."""
    numbers = F.create_map(*[F.lit(x) for k, name in enumerate(_MONTH_NAMES, 1) for x in (name, str(k))])
    name = F.lower(F.substring(F.regexp_substr(c, F.lit("[A-Za-z]+")), 1, 3))
    return F.regexp_replace(c, F.lit("[A-Za-z]+"), F.try_element_at(numbers, name))


def _full_year(text: Column, order: str) -> Column:
    """A two-digit year with four digits: 69 to 99 are 19xx, 00 to 68 are 20xx."""
    first = order == "ymd"
    short = text.rlike("^[0-9]{2}-" if first else "-[0-9]{2}$")
    digits = F.substring(text, 1, 2) if first else F.substring(text, -2, 2)
    before = F.lit("") if first else F.substring(text, F.lit(1), F.length(text) - 2)
    after = F.substring(text, F.lit(3), F.length(text)) if first else F.lit("")
    return F.when(short, F.concat(before, F.when(digits >= "69", "19").otherwise("20"), digits, after)).otherwise(text)


def iso_date(c: Column) -> Column:
    """Date from `yyyy-MM-dd`, with or without a time part; null when it is neither."""
    return _shaped_date(F.substring(trim_all(c), 1, 10), "ymd")


def is_month(c: Column) -> Column:
    """True when `month_start` finds a month; cheaper than parsing."""
    return F.when(c.rlike("^[0-9]{4}-(?:0[1-9]|1[0-2])$"), True).otherwise(_dashed(c).rlike(f"^{_YEAR}-{_MONTH}$|^{_YEAR}(0[1-9]|1[0-2])$"))


def month_start(c: Column) -> Column:
    """First day of a year-month, `2024-05` or `202405`; null for anything else."""
    text = F.regexp_replace(_dashed(c), "^([0-9]{4})([0-9]{2})$", "$1-$2")
    rare = _once(F.concat(text, F.lit("-01")), lambda t: _shaped_date(t, "ymd"))
    return F.when(c.rlike("^[0-9]{4}-(?:0[1-9]|1[0-2])$"), F.concat(c, F.lit("-01")).try_cast("date")).otherwise(rare)


def mixed_date(c: Column, orders: Sequence[str]) -> Column:
    """Date from text in one of several day/month/year orders, the first that fits wins."""

    def first_of(t: Column, tried: Sequence[str]) -> Column:
        return F.coalesce(F.lit(None).cast("date"), *[_shaped_date(_full_year(t, order), order) for order in tried])

    def rare(t: Column) -> Column:
        # names and short years; where a name stands tells the month's place, so only orders with that place fit
        leading, inside = [o for o in orders if o == "mdy"], [o for o in orders if o != "mdy"]
        named = F.when(t.rlike("^[A-Za-z]"), _once(_numbered_month(t), lambda n: first_of(n, leading)))
        named = named.otherwise(_once(_numbered_month(t), lambda n: first_of(n, inside)))
        return F.when(t.rlike("[A-Za-z]"), named).otherwise(first_of(t, orders))

    def read(t: Column) -> Column:
        whole = F.coalesce(F.lit(None).cast("date"), *[_shaped_date(t, order) for order in orders])
        # the shape is tested before the orders are: most values take one branch and one parse
        return F.when(t.rlike("^[0-9]{4}-|-[0-9]{4}$") & ~t.rlike("[A-Za-z]"), whole).when(t.rlike("^[0-9A-Za-z]+-[0-9A-Za-z]+-[0-9]+$"), rare(t))

    return _once(_dashed(c), read)


def _once(c: Column, use: Callable[[Column], Column]) -> Column:
    """`use(c)` with `c` worked out once, however often it is named."""
    return F.transform(F.array(c), use)[0]


def order_counts(df: DataFrame, column: str, orders: Sequence[str]) -> DataFrame:
    """One row: per order the number of values that are a date in it. One pass over all rows, combined map-side."""
    fits = [F.count_if(mixed_date(F.col(column), [order]).isNotNull()).alias(order) for order in orders]
    return df.agg(*fits)


def trained_orders(df: DataFrame, column: str, orders: Sequence[str]) -> list[str]:
    """The orders, the one that fits most values first; equally good ones stay as declared.

    `05/06/2024` alone may be a day in May or in June; a column that also holds `25/06/2024` says which.
    """
    counts = order_counts(df, column, orders).first()
    return sorted(orders, key=lambda order: (-counts[order], orders.index(order)))


def year_month(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM")


def month_number(c: Column) -> Column:
    """Two-digit month, `01` to `12`."""
    return F.date_format(c, "MM")


def iso_text(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd")


def in_span(c: Column, first: str, until: str) -> Column:
    """`first <= c < until`: a bare date range, so it reaches the Parquet scan."""
    return (c >= F.lit(first).cast("date")) & (c < F.lit(until).cast("date"))
