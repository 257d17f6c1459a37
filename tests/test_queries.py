"""Every registered query against its SQL; PANELCAST_TEST_SF chooses the tables."""

import os

import pytest

import __spark_entry__ as entry_points
from oracle import compare, connect
from panelcast.queries import CHECKS, QUERIES

SF = os.environ.get("PANELCAST_TEST_SF", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_check_belongs_to_a_query():
    assert set(CHECKS) <= set(QUERIES) and len(QUERIES) > 100


def test_entry(spark):
    assert entry_points.entry(spark).columns == ["entity", "time", "feature", "value"]


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    assert compare(spark, con, SF, name, QUERIES[name], CHECKS.get(name)) is None
