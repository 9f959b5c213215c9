"""Queries of the subpackage that SQL can express, against that SQL."""

import check_queries
import pytest

from chatlens.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_equals_sql(spark, con, sf, name):
    status, _, _, note = check_queries.compare(spark, con, name, sf)
    assert status == "ok", note


def test_every_operator_has_a_query():
    assert sorted({int(n[2:].split("_")[0]) for n in queries.queries()}) == list(range(1, 14))
