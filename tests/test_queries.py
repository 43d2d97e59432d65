"""Every core query with SQL against DuckDB on the smallest tables; the others at least run."""

from __future__ import annotations

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from corpusgraph.plans import integrity, reference, surface
from corpusgraph.sources.tables import table
from tests.oracle import connect, differences

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="the test tables aren't here")
QUERIES, SQL = integrity.QUERIES | reference.QUERIES | surface.QUERIES, integrity.SQL | reference.SQL | surface.SQL


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_agrees_with_its_sql(spark, con, name):
    assert differences(spark, con, QUERIES[name], SQL[name], FOLDER) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_runs(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0


def test_chunks_cover_the_documents(spark):
    """Every document with visible text has chunks, numbered densely from 0."""
    made = reference.chunk_documents(spark, FOLDER).select("document_id", "position").distinct()
    known = table(spark, FOLDER, "documents").where("regexp_like(text, '[A-Za-z]')").select(F.col("id").alias("document_id")).distinct()
    assert known.join(made.where("position = 0"), "document_id", "left_anti").count() == 0
    assert made.groupBy("document_id").agg((F.max("position") + 1 == F.count("*")).alias("dense")).where("NOT dense").count() == 0
