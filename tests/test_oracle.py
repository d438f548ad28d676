"""Every registered query against its SQL, on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from oracle import compare, duck
from tidegauge.plans import load

FOLDER = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", sorted(load()[0]))
def test_query(spark, con, name):
    df = load()[0][name](spark, FOLDER)
    result = compare(df, con, load()[1][name])
    assert result.startswith("ok"), result


def test_every_query_has_sql():
    assert set(load()[0]) == set(load()[1])


def test_entry_lists_every_query():
    assert set(load()[0]) <= set(entry.queries()) and set(load()[1]) <= set(entry.oracle_sql())


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
