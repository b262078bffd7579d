from __future__ import annotations

import datetime as dt

import pytest

from fenland.fixed_values import POSTCODE_TOWNS
from fenland.plans import building, cleaning
from fenland.schemas import CLEAN, EDUCATION_ALL_YEARS, PRICE_RAW
from fenland.sources import csv_files, tables


def clean(spark, base, name):
    return tables.read_clean(spark, base, name)


def test_clean_tables_have_their_schemas(spark, clean_base):
    for name, schema in CLEAN.items():
        assert spark.read.parquet(f"{clean_base}/{name}").schema.simpleString() == schema.simpleString(), name


def test_the_job_tells_how_many_rows_it_read_and_kept(spark, raw_folder, tmp_path):
    from fenland.plans.jobs import clean_all
    from raw_files import raw_input

    counts = clean_all(spark, raw_input(raw_folder), str(tmp_path))
    assert counts["house_price_clean"] == (13, 9) and counts["broadband_clean"] == (10, 7)
    assert counts["norfolk_clean"] == (13, 10) and counts["suffolk_clean"] == (6, 6)
    assert {name: n for name, (_, n) in counts.items()} == {name: clean(spark, str(tmp_path), name).count() for name in counts}


def test_house_prices_are_filtered_before_the_text_work(spark):
    raw = spark.createDataFrame([(None,) * len(PRICE_RAW.names)], PRICE_RAW)
    plan = cleaning.clean_house_price(raw)._jdf.queryExecution().optimizedPlan().toString()
    filters = [line for line in plan.splitlines() if "Filter" in line]
    assert filters and not any("initcap" in line for line in filters), plan


@pytest.mark.parametrize("postcode", ["NR1 1AA", " nr1 1aa\u00a0", "", " \u2003", "\u00e9", None])
@pytest.mark.parametrize("district", ["NORWICH", "", " ", None])
def test_house_prices_without_postcode_or_district(spark, postcode, district):
    row = dict.fromkeys(PRICE_RAW.names) | {"date": "2020-01-31", "price": "5", "county": "norfolk", "postcode": postcode, "district": district}
    got = cleaning.clean_house_price(spark.createDataFrame([tuple(row[c] for c in PRICE_RAW.names)], PRICE_RAW)).collect()
    kept = postcode is not None and postcode.strip() != "" and district is not None
    assert [r.district for r in got] == ([district.title()] if kept else [])


def test_house_prices(spark, clean_base):
    rows = clean(spark, clean_base, "house_price_clean").collect()
    # two sales that differ in their id only are one; the 2019 file, the other county and unusable rows are out
    assert len(rows) == 9
    sea = next(r for r in rows if r.postcode == "PE30 2AA")
    assert (sea.town, sea.district, sea.county) == ("Wells-Next-The-Sea", "King's Lynn And West Norfolk", "Norfolk")
    assert (sea.date, sea.year, sea.price) == (dt.date(2024, 5, 3), 2024, 250000.0)
    assert sum(r.postcode == "NR2 9AB" for r in rows) == 1
    assert {r.year for r in rows} == {2024, 2025, 2026}


def test_broadband(spark, clean_base):
    rows = sorted(tuple(r) for r in clean(spark, clean_base, "broadband_clean").drop(*csv_files.FILE_ORDER).collect())
    assert len(rows) == 7
    assert ("NR1 1AA", 10.0, 30.0, "Norfolk") in rows and ("NR11AA", 12.0, 31.0, "Norfolk") in rows
    assert ("IP4 2BC", 44.5, 81.0, "Suffolk") in rows


def test_crime(spark, clean_base):
    norfolk = clean(spark, clean_base, "norfolk_clean").collect()
    assert len(norfolk) == 10
    assert clean(spark, clean_base, "suffolk_clean").count() == 6
    assert {r.crime_type for r in norfolk} == {"Drugs", "Violence And Sexual Offences", "Robbery", "Vehicle Crime"}
    first = [r for r in norfolk if r.outcome == "Unknown"]
    assert len(first) == 1 and first[0].month == dt.date(2024, 5, 1) and first[0].year == 2024
    assert spark.read.parquet(f"{clean_base}/norfolk_all").count() == 13


def test_education(spark, clean_base):
    rows = clean(spark, clean_base, "education_clean").collect()
    by_key = {(r.county, r.estab, r.academic_year): r for r in rows}
    assert len(rows) == len(by_key) == 7
    kept = by_key["Norfolk", "4001", "2023-2024"]
    assert (kept.school_name, kept.att8_score, kept.total_pupils) == ("High School", 45.2, 120.0)
    coast = by_key["Norfolk", "4002", "2023-2024"]
    assert (coast.school_name, coast.att8_score, coast.total_pupils) == ("Coast School", None, None)
    assert by_key["Suffolk", "4005", "2024-2025"].lea_code == "935"


def test_population(spark, clean_base):
    rows = {r.lsoa_code: (r.lsoa_name, r.population) for r in clean(spark, clean_base, "population_clean").collect()}
    assert len(rows) == 7 and "E9" not in rows
    assert rows["E1"] == ("Norwich 001A", 1000.0)


def test_file_without_a_year_is_refused(spark, tmp_path):
    path = tmp_path / "ks4final.csv"
    path.write_text("RECTYPE,ESTAB\n1,2\n")
    with pytest.raises(ValueError, match="academic year"):
        cleaning.read_education_files(spark, [str(path)], "Norfolk")


def test_yearly_files_with_changing_headers(spark, tmp_path):
    files = {
        "2021-2022": ("URN,SCHNAME,TOWN,NEW_LA_NAME,ATT8SCR,PCODE", ["101,A,Norwich,NORFOLK,45,NR1 1AA", "102,B,Bury,West Suffolk,NE,IP33 1AA"]),
        "2022-2023": ("ESTAB,school_name,ADDRESS3,LA_NAME,AVG_ATT8", ["201,C,Ipswich,Ipswich,50.5", "202,D,Chelmsford,Essex,60"]),
    }
    paths = {}
    for year, (header, lines) in files.items():
        paths[year] = str(tmp_path / f"{year}.csv")
        (tmp_path / f"{year}.csv").write_text("\n".join([header, *lines]) + "\n")
    paths["2023-2024"] = str(tmp_path / "absent.csv")
    with pytest.warns(UserWarning, match="2023-2024"):
        out = cleaning.load_education_years(spark, paths)
    assert out.columns == EDUCATION_ALL_YEARS.names
    assert sorted(tuple(r) for r in out.collect()) == [
        ("101", "A", "Norwich", "NORFOLK", "NR1 1AA", 45.0, "2021-2022", "Norfolk"),
        ("201", "C", "Ipswich", "Ipswich", None, 50.5, "2022-2023", "Suffolk"),
    ]


def test_yearly_file_without_a_score_column_is_refused(spark, tmp_path):
    path = tmp_path / "year.csv"
    path.write_text("URN,SCHNAME\n1,A\n")
    with pytest.raises(ValueError, match="att8_score"):
        cleaning.read_education_year(spark, str(path), "2021-2022")


def test_scan_by_name_over_different_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1, a \n2,NA\n")
    (tmp_path / "b.csv").write_text("y,z,x\nb,9,3\n")
    (tmp_path / "c.csv").write_text('z,x\n9,"4,""q"""\n')
    paths = csv_files.list_files(spark, str(tmp_path), "*.csv")
    assert len(csv_files.header_groups(spark, paths)) == 3
    rows = csv_files.read_by_name(spark, paths, {"x": "p", "y": "q"}).orderBy(*csv_files.FILE_ORDER).select("p", "q")
    assert [tuple(r) for r in rows.collect()] == [("1", "a"), ("2", None), ("3", "b"), ('4,"q"', None)]


def test_many_files_take_as_many_jobs_as_few(spark, tmp_path):
    def jobs(folder, files):
        folder.mkdir()
        for k in range(files):
            (folder / f"{k:03}.csv").write_text("x,y\n1,2\n" if k % 2 else "y,x\n2,1\n")
        paths = csv_files.list_files(spark, str(folder), "*.csv")
        group = f"headers {files}"
        spark.sparkContext.setJobGroup(group, group)
        rows = csv_files.read_by_name(spark, paths, {"x": "x", "y": "y"})
        count = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        assert {tuple(r) for r in rows.select("x", "y").collect()} == {("1", "2")} and rows.count() == files
        return count

    assert jobs(tmp_path / "few", 80) == jobs(tmp_path / "many", 160)  # from 32 files on Spark lists them in a job


def test_line_breaks_inside_quotes(spark, tmp_path):
    (tmp_path / "a.csv").write_text('x,y\n"a\nb",1\nc,2\n')
    paths = csv_files.list_files(spark, str(tmp_path), "*.csv")
    rows = csv_files.read_by_name(spark, paths, {"x": "x", "y": "y"}, multi_line=True)
    assert [tuple(r) for r in rows.orderBy(*csv_files.FILE_ORDER).select("x", "y").collect()] == [("a\nb", "1"), ("c", "2")]


def test_a_file_that_breaks_the_promised_header_fails(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,2\n")
    (tmp_path / "b.csv").write_text("y,x\n1,2\n")
    paths = csv_files.list_files(spark, str(tmp_path), "*.csv")
    with pytest.raises(Exception, match="(?i)header"):
        csv_files.read_by_name(spark, paths, {"x": "x"}, same_header=True).collect()


def test_unmatched_districts_and_unparsed_months(spark, clean_base):
    missing = building.unmatched_districts(clean(spark, clean_base, "house_price_clean"))
    assert [tuple(r) for r in missing.collect()] == [("Elsewhere", 1)]
    months = spark.createDataFrame([("5/1/2024",), ("2024-05-01",), ("13/5/2024",), ("junk",)], "month string")
    count, sample = building.unparsed_months(months, "Norfolk")
    assert tuple(count.first()) == (1, 4)
    assert [r.month for r in sample.collect()] == ["junk"]
    for county in ("Norfolk", "Suffolk"):
        found = {r.month: r.crime_date for r in building.dated_crime(months, county).collect()}
        # 13/5 shows that this column has the day first
        assert found["13/5/2024"] == dt.date(2024, 5, 13) and found["5/1/2024"] == dt.date(2024, 1, 5)
        first = {r.month: r.crime_date for r in building.dated_crime(months.where("month <> '13/5/2024'"), county).collect()}
        assert first["5/1/2024"] == dt.date(2024, 5, 1)  # nothing says otherwise: the declared order


def test_csv_sink(spark, tmp_path):
    df = spark.createDataFrame([(dt.date(2024, 5, 1), None, 'a"b')], "d date, n string, t string")
    tables.write_csv(df, str(tmp_path / "out"))
    back = csv_files.reader(spark, header=True).csv(str(tmp_path / "out")).first()
    assert tuple(back) == ("2024-05-01", None, 'a"b')


def test_town_lookup_is_whole():
    assert len(POSTCODE_TOWNS) == len(dict(POSTCODE_TOWNS)) == 131
    areas = [district[:2] for district, _ in POSTCODE_TOWNS]
    assert (areas.count("NR"), areas.count("IP")) == (52, 53)
