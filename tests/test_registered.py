"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

from pathlib import Path

import pytest

import __spark_entry__ as entry
from compare import connect, spark_rows, sql_rows

SF_DIR = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="needs the provided tables")


@pytest.fixture(scope="module")
def db():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", entry.queries())
def test_query(spark, db, name):
    got = spark_rows(spark, name, SF_DIR)
    if name in entry.oracle_sql():
        assert got == sql_rows(db, name)


def test_entry(spark):
    frame = entry.entry(spark)
    assert frame.columns == ["field", "count"] and frame.count() > 0
