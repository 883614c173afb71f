"""Every query against its SQL, and the entry points."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry_points
from check import compare, duck_rows, spark_rows

SQL = entry_points.oracle_sql()


OWN = sorted(set(SQL) - set(entry_points.LLM_SQL))


def test_every_query_has_sql():
    assert set(OWN) == set(entry_points.queries()) - set(entry_points.LLM_QUERIES)


@pytest.mark.parametrize("key", OWN)
def test_query_matches_sql(spark, folder, key):
    got = spark_rows(entry_points.queries()[key](spark, folder))
    assert compare(got, duck_rows(folder, SQL[key])) is None
    assert got[1]


def test_flagship(spark, folder):
    rows = entry_points.entry(spark).collect()
    assert [r.subject for r in rows] == sorted(r.subject for r in rows) and sum(r.total for r in rows) == 200
