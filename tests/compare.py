"""Run registered queries beside their SQL twins.

`python tests/compare.py [sf_dir] [name ...]` prints one line per query.
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def plain(rows: list[tuple], names: list[str]) -> list[tuple]:
    """Rows in a fixed column and row order."""
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(row[i] for i in order) for row in rows), key=lambda row: [(v is None, str(v)) for v in row])


def compare(spark, con, name: str, fn, sql: str, sf_dir: str) -> list[str]:
    """Differences between the query and its SQL twin, empty when they agree."""
    df = fn(spark, sf_dir)
    got, want = [tuple(r) for r in df.collect()], con.execute(sql)
    names = [d[0] for d in want.description]
    kinds = {d[0]: str(d[1]) for d in want.description}
    rows = want.fetchall()
    problems = []
    if sorted(df.columns) != sorted(names):
        return [f"columns {sorted(df.columns)} != {sorted(names)}"]
    if len(got) != len(rows):
        problems.append(f"{len(got)} rows != {len(rows)}")
    alike = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE", "boolean": "BOOLEAN"}
    for column, kind in df.dtypes:
        if alike.get(kind) != kinds[column]:
            problems.append(f"type of {column}: {kind} != {kinds[column]}")
    different = [(a, b) for a, b in zip(plain(got, df.columns), plain(rows, names)) if a != b]
    if different:
        problems.append(f"{len(different)} rows differ, first {different[0]}")
    return problems


def main() -> None:
    import __spark_entry__ as entry
    from fenland.session import build_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark = build_session(
        master="local[8]", spark_sql_shuffle_partitions="8", spark_ui_enabled="false", spark_ui_showConsoleProgress="false"
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, oracles, bad = connect(sf_dir), entry.oracle_sql(), 0
    for name, fn in entry.queries().items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            problems = compare(spark, con, name, fn, oracles[name], sf_dir) if name in oracles else []
        except Exception as error:  # report and go on with the next query
            problems = [f"{type(error).__name__}: {str(error)[:600]}"]
        bad += bool(problems)
        print(f"{'ok ' if not problems else 'BAD'} {name} {time.time() - start:.2f}s {'; '.join(problems)}", flush=True)
    print(f"{bad} bad")
    spark.stop()


if __name__ == "__main__":
    main()
