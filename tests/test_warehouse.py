from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from fenland.plans import building, cleaning, models, reports
from fenland.schemas import WAREHOUSE
from fenland.sources import tables


def rows(df):
    return [tuple(r) for r in df.collect()]


# ---- tables --------------------------------------------------------------


def test_sizes_schemas_and_orphans(warehouse):
    assert dict(rows(building.size_report(warehouse))) == {
        "dim_county": 2,
        "dim_district": 12,
        "dim_lsoa": 7,
        "dim_school": 4,
        "fact_population": 6,
        "fact_house_price": 8,
        "fact_broadband": 6,
        "fact_crime": 16,
        "fact_education": 7,
    }
    for name, df in warehouse.tables().items():
        assert df.schema.simpleString() == WAREHOUSE[name].simpleString(), name
    assert {n for _, n in rows(building.orphan_report(warehouse))} == {0}


def test_keys_are_dense(warehouse):
    for name, key in (("fact_house_price", "transaction_pk"), ("fact_crime", "crime_pk"), ("fact_education", "education_pk")):
        keys = sorted(r[0] for r in getattr(warehouse, name).select(key).collect())
        assert keys == list(range(1, len(keys) + 1)), name


def test_dimensions(warehouse):
    areas = {r.lsoa_code: (r.lsoa_name, r.county_id) for r in warehouse.dim_lsoa.collect()}
    assert areas["E9"] == ("Cambridge 002B", 1)  # reported by both forces, the first county stays
    assert areas["E5"] == ("Ipswich 004D", 2)
    schools = {r.estab: r for r in warehouse.dim_school.collect()}
    assert (schools["4005"].county_id, schools["4005"].postcode) == (1, "NR116AA")
    districts = {r.district_id: (r.district_name, r.county_id) for r in warehouse.dim_district.collect()}
    assert districts[4] == ("King's Lynn And West Norfolk", 1) and districts[10] == ("Ipswich", 2)


def test_facts(warehouse):
    speeds = {r.postcode: r.avg_speed for r in warehouse.fact_broadband.collect()}
    assert speeds["NR11AA"] == 10.0  # two spellings of one postcode, the first in the file stays
    inside = dict(rows(warehouse.fact_crime.groupBy("in_boundary").count()))
    assert inside == {True: 14, False: 2}
    assert {r.lsoa_code for r in warehouse.fact_population.collect()} == {"E1", "E2", "E3", "E5", "E6", "E7"}
    assert {r.postcode for r in warehouse.fact_house_price.where("price = 200000").collect()} == {"NR29AB"}


def test_the_first_row_in_file_order_stays(spark, tmp_path):
    """Neither the smallest spelling nor the smallest value: the row that stands first, also behind removed duplicates."""
    header = "postcode,Average download speed (Mbit/s),Maximum download speed (Mbit/s)\n"
    (tmp_path / "a.csv").write_text(header + "NR11AA,50,60\nNR1 1AA,10,30\nNR11AA,50,60\nIP4  2BB,70,80\n")
    (tmp_path / "b.csv").write_text(header + "IP42BB,1,2\nNR11AA,1,1\n")
    paths = [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")]
    speeds = cleaning.clean_broadband(cleaning.read_broadband(spark, paths))
    assert speeds.count() == 5
    crime = "Month,Reported by,Falls within,LSOA code,LSOA name,Crime type,Last outcome category\n"
    (tmp_path / "x-norfolk.csv").write_text(crime + "2024-05,N,N,E1,Zed 001A,Drugs,\n2024-05,N,N,E1,Alpha 001A,Drugs,\n")
    (tmp_path / "x-suffolk.csv").write_text(crime + "2024-05,S,S,E1,Aaa 001A,Drugs,\n2024-05,S,S,E2,Bee 001A,Drugs,\n")
    frames = {f"{f}_clean": cleaning.clean_crime(cleaning.read_crime(spark, str(tmp_path), f)) for f in ("norfolk", "suffolk")}
    w = building.build_warehouse(spark, {"broadband_clean": speeds, **frames}.__getitem__)
    assert sorted(rows(w.fact_broadband)) == [("IP42BB", 70.0, 80.0, 2), ("NR11AA", 50.0, 60.0, 1)]
    assert sorted(rows(w.dim_lsoa)) == [("E1", "Zed 001A", 1), ("E2", "Bee 001A", 2)]


def test_orphan_counts_of_empty_and_null_keys(spark):
    from fenland.operators.lookup import orphan_count, orphan_counts

    dim = spark.createDataFrame([(1,), (2,), (2,), (None,)], "k int")
    other = spark.createDataFrame([("1",)], "s string")
    fact = spark.createDataFrame([(1,), (3,), (3,), (None,)], "k int")
    named = fact.select(F.col("k").cast("string").alias("s"))
    checks = {"a": (fact, dim, "k"), "b": (named, other, "s"), "empty": (fact.limit(0), dim, "k"), "sound": (fact.where("k = 1"), dim, "k")}
    assert dict(rows(orphan_counts(checks, "fact"))) == {"a": 3, "b": 3, "empty": 0, "sound": 0}
    assert {n: orphan_count(f, d, k).first()[0] for n, (f, d, k) in checks.items()} == {"a": 3, "b": 3, "empty": 0, "sound": 0}


def test_seeded_orphans_are_counted(warehouse):
    from fenland.operators.lookup import orphan_count

    few = warehouse.dim_lsoa.where("lsoa_code <> 'E1'")
    assert orphan_count(warehouse.fact_crime, few, "lsoa_code").first()[0] == 6


def test_school_code_with_authority_keeps_counties_apart(spark, clean_base):
    w = building.build_warehouse(spark, lambda n: tables.read_clean(spark, clean_base, n), school_code="lea_estab")
    assert w.dim_school.count() == 5
    stats = {r.county_name: r for r in reports.attainment_stats(w).collect()}
    assert stats["SUFFOLK"].mean_att8 == pytest.approx((40 + 52.5) / 2)


def test_new_version_replaces_the_old_one_only_when_published(spark, warehouse, tmp_path):
    base = str(tmp_path / "w")
    small = warehouse.tables()
    tables.write_warehouse(small, base, 1)
    small["fact_population"] = warehouse.fact_population.limit(1)
    for name in ("fact_population",):  # an unfinished second version
        tables.write_table(small[name], f"{base}/data/2/{name}")
    assert tables.open_warehouse(spark, base).fact_population.count() == 6
    tables.write_warehouse(small, base, 2)
    assert tables.open_warehouse(spark, base).fact_population.count() == 1
    assert tables.open_warehouse(spark, base, version=1).fact_population.count() == 6


def test_year_filter_prunes_partitions_and_reads_two_columns(warehouse):
    plan = warehouse.fact_house_price.where("year = 2025").select("price")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in plan and "ReadSchema: struct<price:double>" in plan


def test_multi_year_school_table(spark, warehouse, tmp_path):
    from fenland.plans.jobs import load_education_years

    (tmp_path / "y.csv").write_text("URN,LA_NAME,ATT8SCR\n4001,Norfolk,45\n9999,Suffolk,50\n")
    load_education_years(spark, {"2021-2022": str(tmp_path / "y.csv")}, str(tmp_path))
    years = spark.read.parquet(str(tmp_path / "education_all_years"))
    assert building.school_orphans(years, warehouse).first()[0] == 1


# ---- reports -------------------------------------------------------------


def test_price_reports(warehouse):
    assert rows(reports.price_trend(warehouse)) == [
        ("Norfolk", 2024, 250000.0, 3),
        ("Norfolk", 2025, 325000.0, 2),
        ("Norfolk", 2026, 280000.0, 1),
        ("Suffolk", 2025, 250000.0, 2),
    ]
    assert len(rows(reports.price_trend(warehouse, max_year=2025))) == 3
    assert sorted(rows(reports.price_average(warehouse))) == [("Norfolk", 280000.0, 5), ("Suffolk", 250000.0, 2)]
    stats = {r.county_name: r for r in reports.price_distribution(warehouse).collect()}
    assert stats["Suffolk"].sd_price == pytest.approx(14142.1356, rel=1e-6)
    assert (stats["Norfolk"].median_price, stats["Norfolk"].min_price, stats["Norfolk"].n) == (325000.0, 150000.0, 2)
    boxes = {r.county_name: r for r in reports.price_boxes(warehouse).collect()}
    assert boxes["Norfolk"].n == 1 and boxes["Suffolk"].n == 2  # the dearest sale is cut off


def test_speed_reports(warehouse):
    boxes = rows(reports.speed_by_area(warehouse, "Norfolk", min_rows=1))
    assert [(b[0], b[3], b[7]) for b in boxes] == [("NR11", 10.0, 1), ("NR29", 21.0, 2)]
    assert rows(reports.speed_by_area(warehouse, "Norfolk")) == []
    outward = {r.town_code for r in reports.speed_by_area(warehouse, "Norfolk", min_rows=1, mode="outward").collect()}
    assert outward == {"NR1", "NR2", "NR29"}
    assert rows(reports.area_sizes(warehouse, "Suffolk")) == [("IP42", 2), ("IP12", 1)]
    summary = {(r[0], r[1]): r[2] for r in reports.speed_summary(warehouse).collect()}
    assert summary["Norfolk", "Average Speed"] == pytest.approx(52 / 3)
    assert summary["Suffolk", "Maximum Speed"] == pytest.approx(251 / 3)


def test_crime_reports(warehouse):
    months = rows(reports.crime_rate_by_month(warehouse))
    assert [(m[2], m[3], m[4]) for m in months] == [("May", "Norfolk", 1), ("Jun", "Suffolk", 1), ("Feb", "Norfolk", 1)]
    assert months[0][5] == pytest.approx(100000 / 4500)
    wide = {r.county_name: r for r in reports.crime_rate_wide(warehouse).collect()}
    assert wide["Suffolk"].Jun == pytest.approx(20.0) and wide["Suffolk"].May is None
    radar = {r.county_name: r for r in reports.crime_rate_radar(warehouse).collect()}
    assert (radar["axis_max"].May, radar["axis_min"].Apr) == (25.0, 0.0)
    shares = {r.district_name: r for r in reports.crime_share_by_district(warehouse).collect()}
    assert set(shares) == {"Norwich", "Ipswich"}  # an area without people and the out-of-boundary rows are out
    assert shares["Norwich"].pct == pytest.approx(50.0)
    assert (shares["Norwich"].label, shares["Norwich"].pct_label) == ("Norwich (100)", "50%")
    years = {(r[0], r[1]): r[3] for r in reports.crime_rate_by_year(warehouse).collect()}
    assert years == pytest.approx({(2024, "Norfolk"): 3 / 4500 * 1e5, (2025, "Norfolk"): 2 / 4500 * 1e5, (2024, "Suffolk"): 40.0})
    boxes = rows(reports.crime_month_boxes(warehouse))
    assert boxes == [("Norfolk", 1.0, 1.0, 1.0, 1.0, 1.0, 0, 1)]


def test_district_rate_denominators(warehouse):
    rate = {r.district_name: r.rate_per_100k for r in reports.crime_rate_by_district(warehouse, "Drugs").collect()}
    assert rate == pytest.approx(
        {"Norwich": 300.0, "Broadland": 50.0, "King's Lynn and West Norfolk": 1e5 / 1500, "Ipswich": 100.0, "East Suffolk": 25.0}
    )
    everyone = reports.crime_rate_by_district(warehouse, "Drugs", denominator="all_areas")
    assert {r.district_name: r.rate_per_100k for r in everyone.collect()} == pytest.approx(rate)
    with pytest.raises(ValueError):
        reports.crime_rate_by_district(warehouse, "Drugs", denominator="other")


def test_school_reports(warehouse):
    stats = {r.county_name: r for r in reports.attainment_stats(warehouse).collect()}
    assert stats["NORFOLK"].mean_att8 == pytest.approx(45.6) and stats["NORFOLK"].median_att8 == pytest.approx(46.2)
    assert (stats["NORFOLK"].n_records, stats["SUFFOLK"].n_records, stats["SUFFOLK"].sd_att8) == (4, 1, None)
    towns = rows(reports.attainment_by_town_year(warehouse, "Norfolk"))
    assert towns == [("Norwich", "2023-2024", pytest.approx(45.2)), ("Norwich", "2024-2025", pytest.approx(137.2 / 3))]
    boxes = {r.county_name: r for r in reports.attainment_boxes(warehouse).collect()}
    assert boxes["NORFOLK"].n == 4


# ---- models --------------------------------------------------------------


def test_district_model_frame_drops_the_differently_spelled_district(warehouse):
    frame = {r.district_name: (r.avg_house_price, r.drug_rate_per_100k) for r in models.model_frame(warehouse, "lm_01").collect()}
    assert frame == {
        "Norwich": (175000.0, 300.0),
        "Broadland": (500000.0, 50.0),
        "Ipswich": (260000.0, 100.0),
        "East Suffolk": (240000.0, 25.0),
    }
    wider = models.model_frame(warehouse, "lm_01", ignore_case=True)
    assert {r.district_name for r in wider.collect()} == {*frame, "King's Lynn And West Norfolk"}
    assert sorted(r.year for r in models.common_years(warehouse).collect()) == [2024, 2025]


def test_town_model_frame(warehouse):
    frame = {r.town: r for r in models.model_frame(warehouse, "lm_02").collect()}
    assert set(frame) == {"Norwich", "Great Yarmouth", "Ipswich", "Woodbridge"}
    coast = frame["Great Yarmouth"]
    assert coast.avg_house_price == pytest.approx(650000 / 3) and coast.avg_download_speed == 21.0
    assert (coast.hp_n, coast.bb_n, coast.county_name) == (3, 2, "Norfolk")
    assert rows(models.town_match_rate(models.price_parts(warehouse))) == [(8, 8)]


def test_every_model_runs(warehouse):
    sizes = {"lm_01": 4, "lm_02": 4, "lm_03": 3, "lm_04": 5, "lm_05": 5, "lm_06": 3}
    for name, size in sizes.items():
        fit = models.model_fit(warehouse, name).first()
        assert fit.n == size, name
        assert 0 <= fit.r_squared <= 1 and 0 <= fit.p_slope <= 1, name
    flat = models.model_fit(warehouse, "lm_05").first()
    assert flat.distinct_y == 2  # one value per county
    assert models.model_band(warehouse, "lm_05").count() == 80
    low, *_, high = models.model_residuals(warehouse, "lm_02").first()
    assert low < 0 < high
    caption = models.model_caption(warehouse, "lm_01").first()[0]
    assert caption.startswith("District-level average, 2024-2025 | R² = 0.")
    assert models.model_caption(warehouse, "lm_04").first()[0].startswith("District-level (n = 5) | R² = ")
    assert models.model_caption(warehouse, "lm_06").first()[0].startswith("Town-level average (n = 3 towns) | R² = ")


def test_slope_of_the_district_model(warehouse):
    points = [(300.0, 175000.0), (50.0, 500000.0), (100.0, 260000.0), (25.0, 240000.0)]
    mx, my = sum(x for x, _ in points) / 4, sum(y for _, y in points) / 4
    slope = sum((x - mx) * (y - my) for x, y in points) / sum((x - mx) ** 2 for x, _ in points)
    fit = models.model_fit(warehouse, "lm_01").select("slope", "intercept", F.col("slope_text")).first()
    assert fit.slope == pytest.approx(slope) and fit.intercept == pytest.approx(my - slope * mx)
    assert fit.slope_text == f"{slope:.2f}"


def test_clean_steps_are_repeatable(spark, clean_base, raw_folder):
    from raw_files import raw_input

    again = cleaning.clean_house_price(cleaning.read_house_price(spark, raw_input(raw_folder).prices))
    assert again.exceptAll(tables.read_clean(spark, clean_base, "house_price_clean")).count() == 0
