"""Every registered query beside its SQL twin on the small benchmark tables."""

from __future__ import annotations

import threading
from pathlib import Path

import pytest

import __spark_entry__ as entry
from compare import compare, connect
from fenland.queries import building
from fenland.queries.registry import ORACLES, QUERIES

SF_DIR = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not Path(SF_DIR).is_dir(), reason="no benchmark tables")


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, duck, name):
    assert compare(spark, duck, name, QUERIES[name], ORACLES[name], SF_DIR) == []


def test_orphan_check_writes_its_clean_tables_side_by_side(spark, monkeypatch):
    gate = threading.Barrier(5)  # broken unless five tables are being written at once

    def written(df):
        gate.wait(60)
        return df

    monkeypatch.setattr(building.scratch, "written", written)
    assert building.built_orphans(spark, SF_DIR).columns == ["fact", "orphans"]


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["county_name", "year", "avg_price", "n"] and df.count() > 0
