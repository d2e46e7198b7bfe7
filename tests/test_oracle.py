"""Every registered query against its SQL, and what the registry has to look like."""

import pytest
from compare import connect, of_spark, of_sql

import __spark_entry__ as entry
from tallyloom.plans.catalog import QUERIES
from tallyloom.plans.oracle import ORACLE

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_sql(spark, duck, name):
    assert of_spark(QUERIES[name](spark, FOLDER)) == of_sql(duck, ORACLE[name])


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLE) <= set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    frame = entry.entry(spark)
    assert frame.columns == ["user_id", "total", "page", "size", "rn", "project_id", "name", "status", "created_at"]
    assert frame.count() > 0
