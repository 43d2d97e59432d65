from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from corpusgraph.llm import repeated_lines as rl
from corpusgraph.llm import splitting


def found(df, **kw):
    return sorted((r.record, r.line_no) for r in rl.repeated_lines(df, "no", "site", "doc", **kw).collect())


def frame(spark, rows):
    return spark.createDataFrame(rows, "no long, site string, doc string, text string")


def test_variants_are_united_and_thresholds_are_exact(spark):
    variants = ["All Rights 2019 Reserved", "all rights 1 reserved", "  all\trights 77  reserved\r", "ALL RIGHTS 20 RESERVED", "all rights 9 reserved"]
    rows = [(i, "s", f"d{i}", f"own line number {chr(97 + i)} here\n{v}") for i, v in enumerate(variants)]
    assert found(frame(spark, rows)) == [(i, 2) for i in range(5)]
    assert found(frame(spark, rows[:4])) == []  # in four documents only
    assert found(frame(spark, rows + rows)) == sorted(2 * [(i, 2) for i in range(5)])  # rows repeat, documents don't
    many = rows + [(100 + i, "s", f"x{i}", None) for i in range(120)]
    assert found(frame(spark, many)) == [(i, 2) for i in range(5)]  # 4 % of 125
    assert found(frame(spark, many + [(999, "s", "y", "")])) == []  # 4 % of 126 are more than five


def test_sources_and_short_lines(spark):
    rows = [(i, site, f"{site}{i}", "one two 3\nsee all the pages") for site in ("a", None) for i in range(5)] + [(50 + i, "b", f"b{i}", "see all the pages") for i in range(4)]
    assert found(frame(spark, rows)) == sorted([(i, 2) for i in range(5)] * 2)
    assert found(frame(spark, [])) == []
    assert found(frame(spark, [(1, None, None, None), (2, "a", None, "x y z")])) == []


def test_a_hot_line_and_clashing_columns(spark):
    df = spark.range(3000).select(F.col("id").alias("no"), F.lit("s").alias("site"), F.concat(F.lit("d"), F.col("id") % 700).alias("doc"), F.lit("hot line of all\nx").alias("text"), F.lit(1).alias("record"), F.lit(2).alias("line"), F.lit("z").alias("source"))
    got = rl.repeated_lines(df, "no", "site", "doc")
    assert got.count() == 3000 and got.select("line_no").distinct().collect()[0][0] == 1


def test_deletion_keeps_the_rest(spark):
    texts = [(1, "a\nb\nc"), (2, "a"), (3, None), (4, "\n".join(str(i) for i in range(200))), (5, "")]
    df = spark.createDataFrame(texts, "no long, text string").withColumn("record", F.lit(9))
    lines = spark.createDataFrame([(1, 2), (2, 1), (4, 1), (4, 65), (4, 200)], "record long, line_no int")
    got = {r.no: r.text for r in rl.without_lines(df, "no", lines).collect()}
    assert got == {1: "a\nc", 2: "", 3: None, 4: "\n".join(str(i) for i in range(1, 199) if i != 64), 5: ""}


@pytest.mark.parametrize("limit, overlap", [(1800, 200), (100, 0), (50, 24), (7, 3)])
def test_pieces_make_up_the_text(spark, limit, overlap):
    rng = random.Random(limit)
    texts = ["", "x", "a" * limit, "a" * (limit + 1), "😀" * (3 * limit), "\n" * (2 * limit), "word " * limit, "a\n\n" * limit]
    texts += ["".join(rng.choice("ab .\n,é😀 ") for _ in range(rng.randrange(1, 6 * limit))) for _ in range(30)]
    df = spark.createDataFrame(list(enumerate(texts)) + [(99, None)], "no int, text string")
    got = {}
    for r in splitting.split_oversized(df, limit=limit, overlap=overlap).orderBy("no", "piece").collect():
        got.setdefault(r.no, []).append(r.text)
    assert got.pop(99) == [None]
    for i, t in enumerate(texts):
        assert all(len(p) <= limit for p in got[i])
        assert got[i][0] + "".join(p[overlap:] for p in got[i][1:]) == t
        assert all(not overlap or b[:overlap] == a[-overlap:] for a, b in zip(got[i], got[i][1:]))
        assert len(got[i]) > 1 or len(t) <= limit


def test_cuts_prefer_strong_boundaries(spark):
    text = "a" * 60 + ".\n\n" + "b" * 20 + ". " + "c" * 40 + " " + "d" * 90
    rows = splitting.split_oversized(spark.createDataFrame([(1, text, 7)], "no int, text string, piece int"), limit=100, overlap=0).orderBy("piece").collect()
    assert [r.text for r in rows][0] == "a" * 60 + ".\n\n"
    assert [r.text for r in rows][1] == "b" * 20 + ". " + "c" * 40 + " "
    with pytest.raises(ValueError):
        splitting.pieces("text", 100, 50)


def test_a_very_long_text_is_split(spark):
    df = spark.range(1).select(F.repeat(F.lit("Some words here. "), 200_000).alias("text"))
    sizes = splitting.split_oversized(df).agg(F.max(F.length("text")), F.count("*"), F.sum(F.length("text"))).collect()[0]
    assert sizes[0] <= 1800 and sizes[2] - 200 * (sizes[1] - 1) == 17 * 200_000
