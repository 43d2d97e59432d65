from __future__ import annotations

from pathlib import Path

import pytest

from corpusgraph.llm import query_modules
from tests.oracle import connect, differences

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="the test tables aren't here")
QUERIES = {n: q for m in query_modules() for n, q in m.QUERIES.items()}
SQL = {n: q for m in query_modules() for n, q in m.SQL.items()}


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_agrees_with_its_sql(spark, name):
    assert differences(spark, connect(FOLDER), QUERIES[name], SQL[name], FOLDER) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_runs(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0
