"""Every registered query against its SQL on the smallest sample tables."""

import os

import pytest

import __spark_entry__ as spark_entry
from loomgraph.plans.oracle import ORACLE
from loomgraph.plans.queries import QUERIES
from tools.check import compare, connect

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def db():
    return connect(SF_DIR)


def test_every_query_has_sql():
    assert set(ORACLE) == set(QUERIES)
    assert set(ORACLE) <= set(spark_entry.oracle_sql())


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, db, name):
    same, note = compare(spark, db, name, SF_DIR)
    assert same, note


def test_entry(spark):
    assert spark_entry.entry(spark).count() == 20
