"""Every query that SQL can express beside its SQL, over whole tables."""

import os

import pytest

import __spark_entry__ as entry
from tests.compare import compare, duck
from tests.conftest import SMALL

SQL = entry.oracle_sql()
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the test tables")


@pytest.fixture(scope="module")
def con():
    return duck(SMALL)


@pytest.mark.parametrize("name", SQL)
def test_oracle(spark, con, name):
    said = compare(spark, con, name, entry.queries()[name], SQL[name], SMALL)
    assert said in ("", "no rows")


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_names():
    assert set(SQL) <= set(entry.queries())


@pytest.mark.parametrize("name", ["p1_table", "ring_population_discs", "zone_shapes", "zone_pairs", "full_pipeline"])
def test_runs(spark, name):
    assert entry.queries()[name](spark, SMALL).count() > 0
