from __future__ import annotations

import pytest

import __spark_entry__
from corpusgraph.operators import orphans
from corpusgraph.plans.joins import join_checked
from corpusgraph.plans.lineage import clear, cut
from corpusgraph.sources.tables import table

FOLDER = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().toString()


def test_cut_tables_are_read_back_and_cleared(spark):
    df = cut(spark.range(10))
    assert df.count() == 10 and cut(spark.range(0)).count() == 0
    clear(spark)
    with pytest.raises(Exception):
        df.count()


def test_broadcasts_are_checked(spark):
    large, small = spark.range(100), cut(spark.range(10))
    assert "BroadcastHashJoin" in plan(join_checked(large, small, ["id"]))
    assert join_checked(large, small, ["id"], most=5).count() == join_checked(large, small, ["id"]).count() == 10
    with pytest.raises(ValueError):
        join_checked(large, small, ["id"], "full_outer")


def test_scans_read_only_what_they_need(spark):
    found = plan(orphans.find_orphans(orphans.corpus_references(*[table(spark, FOLDER, t) for t in ("documents", "chunks", "links", "files")])))
    scans = [line for line in found.split("Physical Plan")[1].splitlines() if "ReadSchema" in line]
    assert scans and not any("text:" in line or "sha256" in line for line in scans)
    assert "PushedFilters: [IsNotNull" in found


def test_entry_and_names(spark):
    assert __spark_entry__.entry(spark).count() > 0
    names = __spark_entry__.queries()
    assert set(__spark_entry__.oracle_sql()) <= set(names)
    assert {"p3_found", "p4_found", "bm25_topk"} <= set(names)
