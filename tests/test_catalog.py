"""Every named query against its SQL, on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from __spark_entry__ import entry
from check import rows_of
from tidewatch.plans.catalog import QUERIES
from tidewatch.plans.oracle import ORACLE

DIRECTORY = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not Path(DIRECTORY).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def tables():
    base = duckdb.connect()
    for file in Path(DIRECTORY).glob("*.parquet"):
        base.sql(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return base


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, tables, name):
    ours = QUERIES[name](spark, DIRECTORY).toPandas()
    theirs = tables.sql(ORACLE[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows_of(ours) == rows_of(theirs)


def test_entry(spark):
    assert entry(spark).count() > 0
