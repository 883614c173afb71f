"""Queries against their SQL."""

from __future__ import annotations

import pytest
from check import compare, duck_rows, spark_rows

from mcqflow.llm.oracle import all_sql
from mcqflow.llm.queries import all_queries


@pytest.mark.parametrize("key", sorted(all_sql()))
def test_query_matches_sql(spark, folder, key):
    assert compare(spark_rows(all_queries()[key](spark, folder)), duck_rows(folder, all_sql()[key])) is None


def test_there_is_one_query_for_each_operator():
    assert sorted(int(k.split("_")[0][2:]) for k in all_queries()) == list(range(1, 14))
