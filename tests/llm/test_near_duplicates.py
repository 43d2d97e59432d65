from __future__ import annotations

import itertools
import random

import pytest
import regex

from corpusgraph.llm import near_duplicates as nd
from corpusgraph.llm.shingles import shingle_sets

_WORD = regex.compile(r"[\p{L}\p{N}]+")


def shingles(text, size, least):
    w = _WORD.findall((text or "").lower())
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= least else set()


def brute(rows, size, least, least_words=0):
    sets = {n: shingles(t, size, least_words) for n, t in rows if n is not None}
    return {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if sets[a] and sets[b] and len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b])}


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        at = rng.randrange(len(words))
        kind = rng.randrange(3)
        if kind == 0:
            words[at] = f"new{rng.randrange(999)}"
        elif kind == 1:
            del words[at]
        else:
            words.insert(at, "Слово")
    return " ".join(words)


def frame(spark, rows):
    return spark.createDataFrame(rows, "no long, text string")


def pairs(members, links):
    return {(r.a, r.b) for r in nd.all_pairs(members, links).collect()}


@pytest.mark.parametrize("size, least, words", [(5, 0.8, 0), (3, 0.6, 40)])
def test_pairs_are_those_of_brute_force(spark, size, least, words):
    rng = random.Random(size)
    rows = []
    for _ in range(25):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(30, 160))]
        rows += [" ".join(base)] + [edited(rng, base, rng.randrange(0, 9)) for _ in range(rng.randrange(0, 5))]
    rows = list(enumerate(rows + rows[:6] + [rows[0].upper()]))
    assert pairs(*nd.near_duplicates(frame(spark, rows), "no", size=size, least=least, least_words=words)) == brute(rows, size, least, words)


def test_masks_cover_the_radius():
    for wrong in itertools.combinations(range(nd.PLACES), nd.RADIUS):
        assert any(not set(wrong) & set(mask) for mask in nd.MASKS.tolist())
    assert all(len(mask) == 4 for mask in nd.MASKS.tolist())


def test_odd_rows(spark):
    text = " ".join(f"w{i}" for i in range(30))
    long = " ".join(f"v{i}" for i in range(150_000))
    rows = [(1, text), (2, text), (2, text), (3, None), (4, ""), (5, "one two"), (None, text), (6, long), (7, long + " end"), (8, text.replace(" ", " "))]
    df = frame(spark, rows).selectExpr("*", "'x' AS record", "1 AS class_id", "2 AS a", "3 AS b")
    assert pairs(*nd.near_duplicates(df, "no")) == {(1, 2), (1, 8), (2, 8), (6, 7)}
    members, links = nd.near_duplicates(df, "no")
    assert {(r.record, r.class_id, r.copies, r.links) for r in nd.class_summary(members, links).collect()} == {(1, 1, 3, 0), (2, 1, 3, 0), (8, 1, 3, 0), (6, 6, 1, 1), (7, 7, 1, 1)}
    assert pairs(*nd.near_duplicates(frame(spark, []), "no")) == set()


def test_shingle_sets_are_those_of_the_words():
    texts = ["", "a b", "The  CAT\nsat_on 2nd mat's", "ДОМ дом дом дом", "x" * 50 + " y z " * 30]
    sets, first = shingle_sets(texts, 3, 0)
    assert [b - a for a, b in zip(first, first[1:])] == [len(shingles(t, 3, 0)) for t in texts]
