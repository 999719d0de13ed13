"""Every registered query against its SQL, over whole tables."""

from __future__ import annotations

import compare
import pytest

import __spark_entry__ as entry
from tillsight.registry import QUERIES

ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def database(folder):
    return compare.connect(folder)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, folder, database, name):
    assert name in ORACLES
    df = entry.queries()[name](spark, folder)
    _, only = compare.differences(df, database, ORACLES[name])
    assert not only


def test_no_sql_without_query():
    assert set(ORACLES) <= set(entry.queries())


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
