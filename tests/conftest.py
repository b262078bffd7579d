from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
sys.path.insert(0, str(Path(__file__).resolve().parent))


@pytest.fixture(scope="session")
def spark():
    from fenland.session import build_session

    session = build_session(
        "tests",
        "local[*]",
        spark_sql_shuffle_partitions="8",
        spark_ui_enabled="false",
        spark_ui_showConsoleProgress="false",
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def raw_folder(tmp_path_factory):
    from raw_files import write_raw_files

    folder = tmp_path_factory.mktemp("raw")
    write_raw_files(folder)
    return folder


@pytest.fixture(scope="session")
def clean_base(spark, raw_folder, tmp_path_factory):
    from fenland.plans.jobs import clean_all
    from raw_files import raw_input

    base = str(tmp_path_factory.mktemp("clean"))
    clean_all(spark, raw_input(raw_folder), base)
    return base


@pytest.fixture(scope="session")
def warehouse(spark, clean_base, tmp_path_factory):
    from fenland.plans.jobs import build_and_publish

    return build_and_publish(spark, clean_base, str(tmp_path_factory.mktemp("warehouse")), 1)
