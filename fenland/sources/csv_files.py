"""CSV input: discovery, scans by column name, file order."""

from __future__ import annotations

import csv
from collections.abc import Collection, Iterable, Mapping, Sequence

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fenland.operators import inference
from fenland.operators.lookup import union_by_name
from fenland.schemas import text_schema
from fenland.sources import headers

# Row position in a file: order by these three for "first row of the first file".
FILE_ORDER = ["_file", "_block", "_row"]


def reader(spark: SparkSession, header: bool, multi_line: bool = False) -> DataFrameReader:
    """Fields are trimmed; empty fields and `NA` are null; quotes are doubled inside quotes.

    `multi_line` keeps line breaks inside quotes; a file is then read by one task.
    """
    return (
        spark.read.option("header", header)
        .option("multiLine", multi_line)
        .option("nullValue", "NA")
        .option("ignoreLeadingWhiteSpace", True)
        .option("ignoreTrailingWhiteSpace", True)
        .option("escape", '"')
    )


def list_files(spark: SparkSession, folder: str, glob: str, recursive: bool = False) -> list[str]:
    """Matching files in path order; only the listing is read, no content."""
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", glob)
        .option("recursiveFileLookup", recursive)
        .load(folder)
    )
    return sorted(row.path for row in files.select("path").collect())


def exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.format("binaryFile").load(path)
    except AnalysisException:
        return False
    return True


def header_of(spark: SparkSession, path: str) -> list[str]:
    """Column names of one file; reads its first line."""
    return reader(spark, header=True).csv(path).columns


def header_groups(spark: SparkSession, paths: Sequence[str]) -> dict[tuple[str, ...], list[str]]:
    """Files by header, so that each group is one scan.

    One distributed job reads the first kilobytes of every file, whatever their number and size; only one
    row per distinct header comes back, with its files. Where a file system is known to Spark's own readers alone,
    the lines are scanned instead.
    """
    if all(headers.can_open(path) for path in {p.split("://")[0]: p for p in paths}.values()):
        found = headers.file_headers(spark, paths)
    else:
        found = _scanned_headers(spark, paths)
    grouped = found.groupBy("header").agg(F.array_sort(F.collect_list("file")).alias("files"))
    return {tuple(row.header): row.files for row in grouped.collect()}


def _scanned_headers(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """file, header by a scan over all lines."""
    lines = spark.read.text(list(paths)).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")
    )
    first = lines.where("block = 0").groupBy("file").agg(F.min_by("value", "row").alias("line"))

    @F.pandas_udf("array<string>")
    def fields(batch: pd.Series) -> pd.Series:
        return pd.Series([[name.strip() for name in next(csv.reader([line.removeprefix("\ufeff")]), [])] for line in batch], dtype=object)

    return first.select("file", fields("line").alias("header"))


def read_plain(spark: SparkSession, paths: str | Sequence[str], schema: T.StructType, glob: str | None = None) -> DataFrame:
    """Files without a header, columns by position, one scan."""
    source = reader(spark, header=False).schema(schema)
    if glob:
        source = source.option("pathGlobFilter", glob)
    return source.csv(paths)


def read_by_name(
    spark: SparkSession, paths: Sequence[str], columns: Mapping[str, str], *, same_header: bool = False, multi_line: bool = False
) -> DataFrame:
    """Files with headers, columns by name; all text, renamed, with row positions.

    A column that a file lacks is null. Files are scanned in groups of equal
    header. With `same_header` only the first file's header is looked at and
    Spark checks the others against it while it reads. `multi_line` is for files
    with line breaks inside quotes.
    """
    if not paths:
        raise ValueError("no input file")
    groups = {tuple(header_of(spark, paths[0])): list(paths)} if same_header else header_groups(spark, paths)
    return union_by_name(*[_scan(spark, header, members, columns, multi_line) for header, members in groups.items()])


def read_inferred(spark: SparkSession, paths: Sequence[str], *, keep_text: Collection[str] = (), multi_line: bool = False) -> DataFrame:
    """Files whose columns nobody declared: every column of any file, with the type that all its values have.

    Types are learned from all rows of all files in one pass; columns in `keep_text` (codes) stay text. Row positions stay.
    """
    groups = header_groups(spark, paths)
    names = list(dict.fromkeys(name for header in groups for name in header))
    frames = [_scan(spark, header, members, {name: name for name in names}, multi_line) for header, members in groups.items()]
    return inference.infer(union_by_name(*frames), keep_text, FILE_ORDER)


def _scan(spark: SparkSession, header: Sequence[str], members: Sequence[str], columns: Mapping[str, str], multi_line: bool) -> DataFrame:
    scan = reader(spark, header=True, multi_line=multi_line).option("enforceSchema", False).schema(text_schema(*header)).csv(list(members))
    picked = [_named(raw, raw in header).alias(name) for raw, name in columns.items()]
    return scan.select(*picked, *file_position())


def _named(raw: str, present: bool) -> Column:
    return F.col(f"`{raw}`") if present else F.lit(None).cast("string")


def file_position() -> list[Column]:
    """Columns that order the rows of a scan as they stand in the files.

    The running number rises within one file block, whatever task reads it.
    """
    return [
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_row"),
    ]


def file_name() -> Column:
    return F.regexp_substr(F.col("_file"), F.lit("[^/]+$"))


def first_lines(spark: SparkSession, path: str, count: int) -> list[str]:
    """The first lines of one file."""
    return [row.value for row in spark.read.text(path).limit(count).collect()]


def read_below_banner(spark: SparkSession, path: str, columns: Mapping[str, str], banner_lines: int) -> DataFrame:
    """A sheet export with lines above its header; columns by header name.

    Header positions are looked up once; banner and header rows stay in the
    frame and fall to the caller's number check.
    """
    header = next(csv.reader(first_lines(spark, path, banner_lines + 1)[-1:]))
    header = [name.strip() for name in header]
    missing = [name for name in columns if name not in header]
    if missing:
        raise ValueError(f"{path} has no column {', '.join(missing)}; it has {', '.join(header)}")
    scan = read_plain(spark, path, text_schema(*[f"c{i}" for i in range(len(header))]))
    picked = [F.col(f"c{header.index(raw)}").alias(name) for raw, name in columns.items()]
    return scan.select(*picked, *file_position())


def first_present(names: Iterable[str], candidates: Sequence[str]) -> str | None:
    """The first candidate that occurs in the names."""
    present = set(names)
    return next((name for name in candidates if name in present), None)
