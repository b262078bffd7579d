"""Headers of many CSV files without reading the files: a data source that takes each file's first kilobytes."""

from __future__ import annotations

import csv
import io
import json
import re
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

CHUNK = 16 * 1024
MOST_TASKS = 1000  # one task per file up to here, then several files to a task

# a record: pieces without quotes and line ends, and quoted pieces with anything in them
_RECORD = re.compile(rb'(?:[^"\r\n]|"[^"]*")*+')


def uri_of(path: str) -> str:
    """The path with a scheme and, for local files, the three slashes that other readers want."""
    if path.startswith("file:"):
        return "file://" + path.removeprefix("file:").removeprefix("//")
    return path if "://" in path else f"file://{path}"


def opened(path: str):
    """A binary stream of the file; local, HDFS and object-store schemes."""
    from pyarrow import fs

    system, inside = fs.FileSystem.from_uri(uri_of(path))
    return system.open_input_stream(inside)


def can_open(path: str) -> bool:
    """True if `opened` knows the path's scheme; paths that only Spark's own readers know are read by them."""
    from pyarrow import fs

    try:
        fs.FileSystem.from_uri(uri_of(path))
    except (OSError, ValueError, NotImplementedError):
        return False
    return True


def first_record(stream) -> tuple[list[str], int]:
    """Fields of the first record that is not empty, trimmed, and the bytes read to get it."""
    raw, done, size = b"", False, CHUNK
    while True:
        more = stream.read(size)
        raw, done, size = raw + more, len(more) < size, 2 * size
        start = re.match(rb"(?:\xef\xbb\xbf)?[\r\n]*", raw).end()
        end = _RECORD.match(raw, start).end()
        if done or (end < len(raw) and raw[end : end + 1] != b'"'):
            record = raw[start:] if done and raw[end : end + 1] == b'"' else raw[start:end]
            text = record.decode("utf-8", "replace").removeprefix("﻿")
            return [name.strip() for name in next(csv.reader(io.StringIO(text, newline="")), [])], len(raw)


class Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class HeaderReader(DataSourceReader):
    def __init__(self, paths: list[str]):
        self.paths = paths

    def partitions(self) -> Sequence[InputPartition]:
        each = max(1, -(-len(self.paths) // MOST_TASKS))
        return [Files(self.paths[k : k + each]) for k in range(0, len(self.paths), each)]

    def read(self, partition: Files) -> Iterator[tuple]:
        for path in partition.paths:
            with opened(path) as stream:
                header, size = first_record(stream)
            yield path, header, size


class HeaderSource(DataSource):
    """`spark.read.format("csv_headers").option("paths", json list)`: file, header, bytes_read of every file."""

    @classmethod
    def name(cls) -> str:
        return "csv_headers"

    def schema(self) -> str:
        return "file string, header array<string>, bytes_read long"

    def reader(self, schema) -> DataSourceReader:
        return HeaderReader(json.loads(self.options["paths"]))


def file_headers(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """file, header, bytes_read; one task per file, none reads more than its first kilobytes.

    A header may be quoted, hold line breaks inside its quotes and follow a byte-order mark or empty lines.
    """
    spark.dataSource.register(HeaderSource)
    return spark.read.format("csv_headers").option("paths", json.dumps(list(paths))).load()
