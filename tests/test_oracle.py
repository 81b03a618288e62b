"""Every registered query against its SQL on the two smaller sets of tables."""

import os

import pytest

import __spark_entry__ as entry
from oracle import compare, connect

FOLDERS = ("/root/testdata/sf0.001", "/root/testdata/sf0.01")
QUERIES, SQL = entry.queries(), entry.oracle_sql()

pytestmark = pytest.mark.skipif(not all(map(os.path.isdir, FOLDERS)), reason="no tables")


@pytest.fixture(scope="module")
def connections():
    return {folder: connect(folder) for folder in FOLDERS}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, connections, name):
    assert compare(spark, connections[FOLDERS[0]], name, FOLDERS[0], QUERIES, SQL) is None


@pytest.mark.parametrize("name", sorted(SQL))
def test_larger(spark, connections, name):
    """More rows than the limits of top lists and scans."""
    assert compare(spark, connections[FOLDERS[1]], name, FOLDERS[1], QUERIES, SQL) is None


def test_entry(spark):
    assert entry.entry(spark).count() > 0
