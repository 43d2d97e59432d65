from __future__ import annotations

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from corpusgraph.operators import orphans, snapshots
from corpusgraph.plans.lineage import scratch
from corpusgraph.plans.ordinals import assign_ordinals

T = [datetime(2024, 1, d) for d in range(1, 29)]


def refs(spark, child, parent):
    c = spark.createDataFrame(child, "n long, ref string, v string, loaded_at timestamp_ntz, word string, at int")
    p = spark.createDataFrame(parent, "path string, v string, loaded_at timestamp_ntz, since int")
    return [orphans.Reference("t", c, "n", [("ref", "path"), ("v", "v")], p, blank_is_none=True)]


def test_orphans_by_hand(spark):
    child = [
        (1, "a", "1", T[5], "x", 1),  # there in time
        (2, "a", "1", T[1], "x", 1),  # loaded before its target
        (3, "a", "2", T[5], "x", 1),  # other release
        (4, None, "1", T[5], "x", 1),
        (5, "", "1", T[5], "x", 1),
        (6, "a", None, T[5], None, None),  # null release matches nothing
        (7, "a", "1", None, "x", 1),  # no time of loading
        (8, "A", "1", T[5], "x", 1),  # exact comparison
        (3, "a", "2", T[5], "x", 1),  # a repeated row counts again
        (9, "b", "1", T[5], "x", 1),  # the target has no time
    ]
    parent = [("a", "1", T[3], 0), ("a", "1", T[2], 0), ("b", "1", None, 0), (None, "1", T[0], 0)]
    got = sorted((r.record_no, r.period or "") for r in orphans.find_orphans(refs(spark, child, parent)).collect())
    assert got == [(2, "2024-01"), (3, "2024-01"), (3, "2024-01"), (6, "2024-01"), (7, ""), (8, "2024-01"), (9, "2024-01")]
    assert {(r.period, r.orphans) for r in orphans.orphan_report(refs(spark, child, parent)).collect()} == {("2024-01", 6), (None, 1)}


def test_orphans_of_empty_tables(spark):
    assert orphans.find_orphans(refs(spark, [], [])).collect() == []
    assert [r.record_no for r in orphans.find_orphans(refs(spark, [(1, "a", "1", T[0], "", 0)], [])).collect()] == [1]


@pytest.mark.parametrize("words", [1, 64, 1 << 20])
def test_a_filter_that_is_not_broadcast_loses_nothing(spark, words):
    rng = random.Random(words)
    parent = [(str(rng.randrange(400)), "1", T[rng.randrange(10)], 0) for _ in range(300)]
    child = [(i, str(rng.randrange(400)), "1", T[rng.randrange(28)], "", 0) for i in range(600)]
    since = {}
    for k, _, t, _ in parent:
        since[k] = min(t, since.get(k, t))
    want = sorted(i for i, k, _, t, *_ in child if k not in since or since[k] > t)
    assert sorted(r.record_no for r in orphans.find_orphans(refs(spark, child, parent), words).collect()) == want


def test_the_filter_does_not_fill_up():
    """At fifty million keys and at fifty billion it lets through what it lets through at a thousand."""
    for keys in (5_000, 50_000_000, 50_000_000_000):
        words = orphans.filter_words(keys)
        assert words * orphans.KEYS_PER_WORD >= keys and orphans.passing_share(keys, words) < 0.015


def test_absent_keys_hardly_pass(spark):
    keys = spark.range(20_000).select(F.concat(F.lit("k"), "id").alias("k0"))
    absent = spark.range(20_000).select(F.concat(F.lit("x"), "id").alias("k0"))
    words = orphans.filter_words(20_000)
    pages = orphans.bloom_pages(keys, ["k0"], words)
    assert pages.count() * orphans.PAGE == words

    def passing(df):
        h = F.xxhash64("k0")
        probed = df.select(orphans._mask(h).alias("mask"), orphans._word(h, words).alias("word")).withColumn("page", F.floor(F.col("word") / orphans.PAGE)).join(pages, "page")
        return probed.where(F.element_at("words", (F.col("word") % orphans.PAGE + 1).cast("int")).bitwiseAND(F.col("mask")) == F.col("mask")).count()

    assert passing(keys) == 20_000 and passing(absent) < 0.015 * 20_000


def releases(spark):
    return spark.createDataFrame([("4.9", T[0]), ("4.10", T[9]), ("5", T[19]), ("5", T[20]), (None, T[1])], "product_version string, released_at timestamp_ntz")


def test_changes_against_brute_force(spark):
    rng = random.Random(7)
    rows = [(f"k{rng.randrange(60)}", rng.choice(["4.9", "4.10", "5", "unlisted"]), rng.choice([None, "A", "b", "B", "c"]), T[rng.randrange(28)], i) for i in range(300)]
    rows += [(None, "5", "a", T[0], 1), ("k0", None, "a", T[0], 2), rows[0], rows[0]]
    df = spark.createDataFrame(rows, "path string, product_version string, sha string, loaded_at timestamp_ntz, no int")
    latest = snapshots.last_loaded(df, "path", "product_version", F.lower("sha"), ["loaded_at", "no"])
    got = sorted((r.product_version, r.record_key, r.change) for r in snapshots.snapshot_changes(latest, releases(spark)).collect())
    state = {v: {} for v in ("4.9", "4.10", "5")}
    for k, v, s, t, n in sorted((r for r in rows if r[0] and r[1]), key=lambda r: (r[3], r[4])):
        if v in state:
            state[v][k] = s and s.lower()
    want = []
    for a, b in (("4.9", "4.10"), ("4.10", "5")):
        for k in state[a].keys() | state[b].keys():
            kind = "added" if k not in state[a] else "removed" if k not in state[b] else "changed" if state[a][k] != state[b][k] else None
            want += [(b, k, kind)] if kind else []
    assert got == sorted(want)


def test_ties_of_the_last_load_go_to_the_greatest_content(spark):
    df = spark.createDataFrame([("k", "5", None, T[0]), ("k", "5", "b", T[0]), ("k", "5", "a", T[0])], "path string, product_version string, sha string, loaded_at timestamp_ntz")
    assert snapshots.last_loaded(df, "path", "product_version", F.col("sha"), ["loaded_at"]).collect()[0].content == "b"


def test_an_absent_snapshot_removes_all_and_empty_tables_give_none(spark):
    df = spark.createDataFrame([("a", "4.9", "x", T[0]), ("a", "5", "x", T[0])], "path string, product_version string, sha string, loaded_at timestamp_ntz")
    latest = snapshots.last_loaded(df, "path", "product_version", F.col("sha"), ["loaded_at"])
    got = {(r.product_version, r.change) for r in snapshots.snapshot_changes(latest, releases(spark)).collect()}
    assert got == {("4.10", "removed"), ("5", "added")}
    assert snapshots.snapshot_changes(latest.limit(0), releases(spark)).collect() == []


def test_ordinals_are_distinct_and_stay(spark):
    keys = spark.createDataFrame([(f"k{i % 500}",) for i in range(1500)] + [(None,)], "k string")
    ordinals = assign_ordinals(keys, "k")
    first = {r.k: r.ordinal for r in ordinals.collect()}
    assert len(first) == len(set(first.values())) == 500
    assert first == {r.k: r.ordinal for r in ordinals.orderBy("k").collect()}


def test_ordinals_stay_over_deliveries_and_stored_blocks_are_used_again(spark):
    """The second delivery has the new release only: the one before it comes from the store."""
    def delivered(version, keys):
        rows = spark.createDataFrame([(k, version, s, T[0]) for k, s in keys.items()], "path string, product_version string, sha string, loaded_at timestamp_ntz")
        return snapshots.last_loaded(rows, "path", "product_version", F.col("sha"), ["loaded_at"])

    store = scratch(spark, "store")
    first = delivered("4.9", {"a": "1", "b": "1"}).unionByName(delivered("4.10", {"b": "2", "c": "1"}))
    assert {tuple(r) for r in snapshots.snapshot_changes(first, releases(spark).where("product_version <> '5'"), store=store).collect()} == {("4.10", "a", "removed"), ("4.10", "b", "changed"), ("4.10", "c", "added")}
    before = {r.snapshot_key: r.ordinal for r in spark.read.parquet(f"{store}/keys").collect()}
    second = snapshots.snapshot_changes(delivered("5", {"a": "1", "c": "1", "d": None}), releases(spark), store=store)
    assert {tuple(r) for r in second.where("product_version = '5'").collect()} == {("5", "a", "added"), ("5", "b", "removed"), ("5", "d", "added")}
    after = {r.snapshot_key: r.ordinal for r in spark.read.parquet(f"{store}/keys").collect()}
    assert sorted(before.values()) == [1, 2, 3] and after == before | {"d": 4}
    again = snapshots.snapshot_changes(delivered("5", {"b": "2", "c": "1"}), releases(spark), store=store)  # delivered again: replaces what was stored
    assert again.where("product_version = '5'").collect() == []
