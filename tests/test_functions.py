from __future__ import annotations

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from fenland.functions import dates, geography, labels, numbers, text


def values(spark, expression, *inputs, kind="string"):
    rows = [(i, value) for i, value in enumerate(inputs)]
    df = spark.createDataFrame(rows, f"i int, c {kind}")
    return [row.out for row in df.select("i", expression(F.col("c")).alias("out")).orderBy("i").collect()]


def test_trim_takes_every_unicode_blank(spark):
    assert values(spark, text.trim_all, "  a  b\t", None) == ["a  b", None]
    assert values(spark, text.squish, "  a   b\t") == ["a b"]
    assert values(spark, text.strip_blanks, " N R 1 ") == ["NR1"]


def test_blanks_of_printable_and_other_text(spark):
    """Printable ASCII takes a path of its own (spaces are its only blanks) and gives what all other text gives."""
    source = random.Random(9)
    texts = ["".join(source.choice(letters) for _ in range(source.randint(0, 9))) for letters in ("aB~  ", "aB \t\u2003é") for _ in range(400)]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    plain, c = F.col("t").rlike(text._PRINTABLE), F.col("t")
    for k, is_plain, trimmed, squished in df.select("k", plain, text.trim_all(c), text.squish(c)).collect():
        t = texts[k]
        assert is_plain == all(" " <= x <= "~" for x in t), repr(t)
        assert trimmed == t.strip(text.BLANKS), repr(t)
        assert squished == re.sub(f"[{text.BLANKS}]+", " ", t).strip(" "), repr(t)
    assert not spark.createDataFrame([("a\n",)], "t string").select(plain).first()[0]


def test_title_case_starts_words_at_hyphens_not_apostrophes(spark):
    got = values(spark, text.title_case, "WELLS-NEXT-THE-SEA", "KING'S LYNN AND WEST NORFOLK", "st ives (east)", None)
    assert got == ["Wells-Next-The-Sea", "King's Lynn And West Norfolk", "St Ives (East)", None]


def test_drop_last_word(spark):
    got = values(spark, text.drop_last_word, "Norwich 001A", "King's Lynn and West Norfolk  003C", "Single")
    assert got == ["Norwich", "King's Lynn and West Norfolk", "Single"]


def test_null_markers_and_defaults(spark):
    assert values(spark, lambda c: text.null_if_any(c, "NE", "SUPP"), "NE", "SUPP", "5", None) == [None, None, "5", None]
    assert values(spark, lambda c: text.blank_to(c, "NA"), "", None, "x") == ["NA", "NA", "x"]
    assert values(spark, lambda c: text.or_default(c, "Unknown"), "", None) == ["", "Unknown"]


def test_numbers_that_are_not_plain_decimals_are_null(spark):
    got = values(spark, numbers.to_number, "12", " 1.5 ", "-2e3", ".5", "1d", "NE", "0x1A", "", None, "1,000")
    assert got == [12.0, 1.5, -2000.0, 0.5, None, None, None, None, None, None]


def test_rounding_half_to_even(spark):
    assert values(spark, lambda c: numbers.round_even(c, 0), 2.5, 3.5, kind="double") == [2.0, 4.0]


def test_rate_with_no_population_is_null(spark):
    assert values(spark, lambda c: numbers.rate_per_100k(F.lit(5), c), 1000.0, 0.0, kind="double") == [500.0, None]


def test_dates(spark):
    assert values(spark, dates.iso_date, "2024-03-01 00:00", "2024-03-01", "bad") == [dt.date(2024, 3, 1)] * 2 + [None]
    assert values(spark, dates.month_start, "2024-05", "2024-13", None) == [dt.date(2024, 5, 1), None, None]


@pytest.mark.parametrize(
    ("orders", "ambiguous"),
    [(["mdy", "ymd", "dmy"], dt.date(2024, 5, 1)), (["ymd", "dmy", "mdy"], dt.date(2024, 1, 5))],
)
def test_mixed_dates_take_the_first_order_that_fits(spark, orders, ambiguous):
    got = values(spark, lambda c: dates.mixed_date(c, orders), "5/1/2024", "2024-05-01", "13/5/2024", "junk", "1.13.2024")
    assert got == [ambiguous, dt.date(2024, 5, 1), dt.date(2024, 5, 13), None, dt.date(2024, 1, 13)]


def test_mixed_dates_with_month_names_and_short_years(spark):
    got = values(spark, lambda c: dates.mixed_date(c, ["dmy", "ymd", "mdy"]), "1 May 2024", "May 1, 2024", "01-Sep-98", "2/3/24", "24-05-01", "1 Smarch 2024", "5-2024")
    assert got == [dt.date(2024, 5, 1), dt.date(2024, 5, 1), dt.date(1998, 9, 1), dt.date(2024, 3, 2), dt.date(2001, 5, 24), None, None]
    assert values(spark, dates.month_start, "202405", "202413", "2024/5") == [dt.date(2024, 5, 1), None, dt.date(2024, 5, 1)]


@pytest.mark.parametrize(
    ("texts", "ranked"),
    [
        (["05/06/2024", "25/06/2024", "junk", None], ["dmy", "mdy", "ymd"]),
        (["05/06/2024", "06/25/2024"], ["mdy", "dmy", "ymd"]),
        (["05/06/2024"], ["mdy", "dmy", "ymd"]),  # a tie stays as declared
        (["2024-06-05", "1 May 2024", "30 Feb 2024"], ["ymd", "dmy", "mdy"]),
        ([None], ["mdy", "ymd", "dmy"]),
    ],
)
def test_orders_learned_from_the_values(spark, texts, ranked):
    rows = spark.createDataFrame([(t,) for t in texts], "raw string")
    assert dates.trained_orders(rows, "raw", ["mdy", "ymd", "dmy"]) == ranked
    assert dates.trained_orders(rows.limit(0), "raw", ["ymd", "mdy"]) == ["ymd", "mdy"]


def test_postcode_district_modes(spark):
    keys = ["NR11AA", "NR29AB", "NR291AB", "IP121AA", "12345", "N1"]
    assert values(spark, geography.postcode_district, *keys) == ["NR11", "NR29", "NR29", "IP12", None, "N1"]
    outward = values(spark, lambda c: geography.postcode_district(c, "outward"), *keys)
    assert outward == ["NR1", "NR2", "NR29", "IP12", "12", None]
    with pytest.raises(ValueError):
        geography.postcode_district(F.col("c"), "other")


def test_counties(spark):
    assert values(spark, geography.county_of_postcode, "NR1 1AA", "IP1 1AA", "CB1", None) == ["Norfolk", "Suffolk", None, None]
    got = values(spark, geography.county_of_authority, "NORFOLK", "West Suffolk", "Ipswich", "babergh DC", "Essex", None)
    assert got == ["Norfolk", "Suffolk", "Suffolk", "Suffolk", None, None]


def test_boundary_needs_the_reporting_county(spark):
    def inside(county):
        return lambda c: geography.inside_boundary(F.lit(county), geography.lsoa_district(c))

    names = ["Norwich 001A", "Ipswich 002B", "King's Lynn and West Norfolk 003C", None]
    assert values(spark, inside("Norfolk"), *names) == [True, False, True, False]
    assert values(spark, inside("Suffolk"), *names) == [False, True, False, False]


def test_labels(spark):
    assert values(spark, labels.pounds, 250000.4, kind="double") == ["£250,000"]
    assert values(spark, labels.thousand_pounds, 250499.0, kind="double") == ["£250k"]
    named = values(spark, lambda c: labels.named_value(F.lit("Norwich"), c), 12.34, 100.0, kind="double")
    assert named == ["Norwich (12.3)", "Norwich (100)"]
    assert values(spark, labels.percent, 33.333, kind="double") == ["33.3%"]


def test_p_value_text(spark):
    ps = [0.0, 1e-20, 0.0065331945, 0.05, 0.5, 1.0, 1.234e-5, 0.00123]
    got = values(spark, labels.p_value_text, *ps, kind="double")
    assert got == ["<2e-16", "<2e-16", "0.00653", "0.05", "0.5", "1", "1.23e-05", "0.00123"]
    assert values(spark, lambda c: labels.p_value_text(c, 4), 0.0, 0.0065331945, kind="double") == ["< 2.2e-16", "0.006533"]
