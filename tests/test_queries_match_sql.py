"""Every query with SQL gives the SQL's rows on the smallest tables."""

from pathlib import Path

import pytest

import compare
from cairn.plans import registry

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables here")


@pytest.fixture(scope="module")
def con():
    return compare.connect(FOLDER)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_rows(spark, con, name):
    columns, rows = compare.spark_rows(registry.QUERIES[name](spark, FOLDER))
    wanted_columns, wanted = compare.oracle_rows(con, registry.ORACLES[name])
    assert columns == wanted_columns
    assert rows == wanted


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, FOLDER).columns
