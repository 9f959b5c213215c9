"""Every registered query against its SQL on the small tables."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))
import check_queries  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
import catalogue  # noqa: E402


@pytest.fixture(scope="module")
def con(sf):
    return check_queries.connect(sf)


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query_equals_sql(spark, con, sf, name):
    status, _, _, note = check_queries.compare(spark, con, name, sf)
    assert status == "ok", note


def test_every_query_has_sql():
    assert set(catalogue.queries()) == set(catalogue.oracle_sql())
    assert set(catalogue.queries()) <= set(entry.queries())


def test_entry_runs(spark):
    assert entry.entry(spark).columns == ["token", "n"]
