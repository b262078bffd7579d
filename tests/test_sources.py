"""Header discovery and type inference over files."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from fenland.operators import inference
from fenland.schemas import CLEAN
from fenland.sources import csv_files, headers, tables


def test_headers_cost_the_same_for_small_and_large_files(spark, tmp_path):
    for name, lines in (("small", 60_000), ("large", 6_000_000)):
        (tmp_path / f"{name}.csv").write_text("x,y\n" + "0123456,89012345\n" * lines)
    assert (tmp_path / "large.csv").stat().st_size > 100_000_000
    paths = csv_files.list_files(spark, str(tmp_path), "*.csv")
    rows = headers.file_headers(spark, paths)
    assert rows.rdd.getNumPartitions() == 2
    found = {r.file.rsplit("/", 1)[-1]: (r.header, r.bytes_read) for r in rows.collect()}
    assert found["small.csv"] == found["large.csv"] == (["x", "y"], headers.CHUNK)
    group = "large headers"
    spark.sparkContext.setJobGroup(group, group)
    assert csv_files.header_groups(spark, paths) == {("x", "y"): paths[:1] + paths[1:]}
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup(group)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(jobs) <= 2  # the exchange of the grouping and its result; none reads lines


@pytest.mark.parametrize("scan", [False, True])
def test_headers_of_every_shape(spark, tmp_path, monkeypatch, scan):
    texts = {
        "plain.csv": "a, b ,c\n1,2,3\n",
        "mark.csv": "﻿a,b,c\n1,2,3\n",
        "quoted.csv": '"a","b, ""x""",c\r\n1,2,3\r\n',
        "only.csv": "a,b,c",
        "long.csv": ",".join(f"column{k:05}" for k in range(5000)) + "\n1\n",
    }
    if not scan:  # a line break inside quotes is not seen by a scan of lines
        texts["broken.csv"] = '"a\nb",c\n1,2\n'
        texts["empty.csv"] = ""
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    if scan:
        monkeypatch.setattr(headers, "can_open", lambda path: False)
    paths = [f"{tmp_path}/{name}" for name in texts]
    groups = {tuple(sorted(p.rsplit("/", 1)[-1] for p in files)): header for header, files in csv_files.header_groups(spark, paths).items()}
    assert groups["mark.csv", "only.csv", "plain.csv"] == ("a", "b", "c")
    assert groups["quoted.csv",] == ("a", 'b, "x"', "c")
    assert len(groups["long.csv",]) == 5000 and groups["long.csv",][-1] == "column04999"
    if not scan:
        assert groups["broken.csv",] == ("a\nb", "c") and groups["empty.csv",] == ()


VALUES = {
    "nothing": ([None, None], "string"),
    "whole": (["1", "-20", None, "+3"], "long"),
    "wide": (["123456789012345678", "1234567890123456789"], "double"),
    "real": (["1", "2.5", ".5", "3e4", "7."], "double"),
    "code": (["007", "1"], "string"),
    "day": (["2024-02-29", None], "date"),
    "no_day": (["2024-02-29", "2023-02-29"], "string"),
    "moment": (["2024-02-29 10:30", "2024-02-29T10:30:05.25"], "timestamp"),
    "day_or_moment": (["2024-02-29", "2024-02-29 10:30:00"], "timestamp"),
    "flag": (["TRUE", "false", "T"], "boolean"),
    "flag_or_number": (["TRUE", "1"], "string"),
    "number_or_day": (["20240229", "2024-02-29"], "string"),
    "number_or_moment": (["1.5", "2024-02-29 10:30"], "string"),
    "number_or_text": (["1", "NE"], "string"),
    "sign": (["-", "."], "string"),
    "blank": (["", "1"], "string"),
}


@pytest.mark.parametrize("name", list(VALUES))
def test_types_and_clashes(spark, name):
    values, want = VALUES[name]
    df = spark.createDataFrame([(v,) for v in values], f"{name} string")
    row = inference.column_types(df).first()
    assert tuple(row) == (name, want, sum(v is not None for v in values), sum(v is None for v in values))
    back = inference.infer(df)
    assert back.schema[name].dataType == inference.SPARK_TYPES[want]
    assert back.where(F.col(name).isNotNull()).count() == row.present


def test_types_do_not_depend_on_partitions_or_order(spark):
    df = spark.range(5000).select(F.when(F.col("id") == 4321, "x").otherwise(F.col("id").cast("string")).alias("rare"), F.col("id").cast("string").alias("whole"))
    for n in (1, 13):
        assert [(r.column_name, r.type) for r in inference.column_types(df.repartition(n)).collect()] == [("rare", "string"), ("whole", "long")]
    assert [r.type for r in inference.column_types(df.limit(0)).collect()] == ["string", "string"]


def test_clean_tables_get_their_declared_types_back(spark, clean_base, tmp_path):
    codes = ["lea_code", "estab"]  # numbers by their looks, names by their use
    for name, schema in CLEAN.items():
        tables.write_csv(tables.read_clean(spark, clean_base, name).drop(*csv_files.FILE_ORDER), f"{tmp_path}/{name}")
        paths = csv_files.list_files(spark, f"{tmp_path}/{name}", "*.csv")
        got = csv_files.read_inferred(spark, paths, keep_text=codes).drop(*csv_files.FILE_ORDER)
        want = {f.name: f.dataType.simpleString().replace("int", "bigint").replace("bigbigint", "bigint") for f in schema if f.name not in csv_files.FILE_ORDER}
        assert {f.name: f.dataType.simpleString() for f in got.schema} == want, name
        assert got.count() == tables.read_clean(spark, clean_base, name).count()


def test_files_with_different_columns_share_types(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,score,when\n1,2.5,2024-01-01\n")
    (tmp_path / "b.csv").write_text("when,id,note\n2024-02-02,2,new\n")
    got = csv_files.read_inferred(spark, csv_files.list_files(spark, str(tmp_path), "*.csv"))
    rows = {tuple(r) for r in got.select("id", "score", "when", "note").collect()}
    assert rows == {(1, 2.5, dt.date(2024, 1, 1), None), (2, None, dt.date(2024, 2, 2), "new")}


def row_groups(path, column: str):
    """(minimum, maximum) of every row group of a table."""
    import pyarrow.parquet as pq

    found = []
    for file in sorted(path.rglob("*.parquet")):
        meta = pq.ParquetFile(file).metadata
        place = meta.schema.names.index(column)
        found += [(s.min, s.max) for k in range(meta.num_row_groups) if (s := meta.row_group(k).column(place).statistics)]
    return found


def test_a_filter_on_any_clustered_column_skips_most_row_groups(spark, tmp_path):
    rows = spark.range(120_000).selectExpr(
        "element_at(array('Drugs', 'Robbery', 'Burglary', 'Theft', 'Arson', 'Fraud', 'Fire', 'Other'), cast(id * 7919 % 8 + 1 AS int)) AS crime_type",
        "concat('E010', lpad(cast(id * 104729 % 5000 AS string), 5, '0')) AS lsoa_code",
        "date_add(DATE '2020-01-01', cast(id * 15485863 % 1500 AS int)) AS crime_date",
        "2020 AS year",
    )
    columns = {"crime_type": "Drugs", "lsoa_code": "E01001234", "crime_date": dt.date(2021, 6, 1)}
    tables.write_table(rows, str(tmp_path / "t"), "year", list(columns), ["lsoa_code"], row_group_rows=1500)
    assert spark.read.parquet(str(tmp_path / "t")).exceptAll(rows).count() == 0
    for column, value in columns.items():
        groups = row_groups(tmp_path / "t", column)
        hit = [g for g in groups if g[0] <= value <= g[1]]
        assert len(groups) > 60 and len(hit) < len(groups) / 2, (column, len(hit), len(groups))
    # a plain sort serves its first column alone
    rows.repartitionByRange(8, *columns).sortWithinPartitions(*columns).write.option("parquet.block.row.count.limit", 1500).parquet(str(tmp_path / "s"))
    groups = row_groups(tmp_path / "s", "crime_date")
    assert sum(g[0] <= columns["crime_date"] <= g[1] for g in groups) > len(groups) / 2


def test_bloom_filters_of_looked_up_columns(spark, tmp_path):
    import duckdb

    rows = spark.range(20_000).selectExpr("concat('NR', id * 3) AS postcode", "id % 2 AS county_id")
    tables.write_table(rows, str(tmp_path / "t"), None, ["county_id", "postcode"], ["postcode"])
    with duckdb.connect() as con:
        probe = lambda value: con.execute(f"SELECT bloom_filter_excludes FROM parquet_bloom_probe('{tmp_path}/t/*.parquet', 'postcode', '{value}')").fetchall()
        absent, present = [r[0] for r in probe("NR100")], [r[0] for r in probe("NR300")]
    assert absent and all(absent) and not all(present)


def test_z_key_of_odd_columns(spark):
    from fenland.operators import clustering

    df = spark.createDataFrame([(None, None, None), (1.5, "a", dt.date(2024, 1, 1)), (float("nan"), "é-", None)], "n double, s string, d date")
    assert df.select(clustering.z_key(df, ["n", "s", "d"]).alias("z")).where("z IS NULL").count() == 0
    assert df.limit(0).select(clustering.z_key(df.limit(0), ["n", "s"]).alias("z")).count() == 0
