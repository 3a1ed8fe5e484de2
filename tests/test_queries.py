"""Every registered query against its SQL twin."""

import pytest

import __spark_entry__ as spark_entry
from relinfer.plans.catalog import QUERIES
from tests.conftest import FOLDER
from tools.compare import compare, duck


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


def test_every_query_has_a_twin():
    assert set(QUERIES) <= set(spark_entry.oracle_sql()) <= set(spark_entry.queries())


@pytest.mark.parametrize("name", list(spark_entry.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    assert compare(spark, con, name, FOLDER) is None


def test_entry(spark):
    rows = spark_entry.entry(spark)
    assert rows.columns == ["seq_id", "token"] and rows.count() > 0
