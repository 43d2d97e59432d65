from __future__ import annotations

import base64
import random

import numpy as np
import pytest
import tiktoken
from pyspark.sql import functions as F

from corpusgraph.llm import bpe, encoding, packing


@pytest.fixture(scope="module")
def reference():
    with open(encoding.vocabulary_path(), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("test", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def own():
    with open(encoding.vocabulary_path(), "rb") as f:
        return bpe.Encoder(f.read())


def random_texts(n, longest, seed=3):
    rng = random.Random(seed)
    alphabet = "abc'stlrevdm  \n\t\r é1٣½.,!'’ ​　Ж中😀́\x1c\x85"
    return ["".join(rng.choice(alphabet) for _ in range(rng.randrange(longest))) for _ in range(n)]


def test_encoder_agrees_with_the_library(own, reference):
    texts = random_texts(3000, 60) + ["<|endoftext|>", "it's we'll x''s 'S", "   ", "a\n\n\n b", ""]
    assert [list(x) for x in own.encode(texts)] == [reference.encode_ordinary(t) for t in texts]
    assert own.count(texts).tolist() == [len(reference.encode_ordinary(t)) for t in texts]


def test_round_trip(own):
    for text, ids in zip(random_texts(300, 200), own.encode(random_texts(300, 200))):
        assert own.decode(ids) == text


def test_a_full_cache_starts_anew(reference, own, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE", 50)
    texts = [f"w{i} x{i}" for i in range(200)]
    for t in texts:
        assert list(own.encode([t])[0]) == reference.encode_ordinary(t)


@pytest.mark.parametrize("chunk, overlap", [(40, 12), (300, 60)])
def test_stitched_chunks_are_the_whole(spark, reference, chunk, overlap):
    texts = random_texts(60, 900, chunk) + ["a" * 1000, " " * 500 + "x", "b" * 130 + " c " * 90 + "1" * 150, "", "'ll " * 200]
    rows = list(enumerate(texts)) + [(900, None), (None, "null key"), (0, texts[0])]
    df = spark.createDataFrame(rows, "doc long, text string").withColumn("record", F.lit("x")).withColumn("ids", F.lit(0)).withColumn("row", F.lit(1))
    got = sorted(((r.record if r.record is not None else -1), list(r.ids)) for r in encoding.encode_texts(df, "doc", chunk=chunk, overlap=overlap).collect())
    assert got == sorted(((d if d is not None else -1), reference.encode_ordinary(t or "")) for d, t in rows)
    counts = sorted(((r.record if r.record is not None else -1), r.ids) for r in encoding.encode_texts(df, "doc", chunk=chunk, overlap=overlap, counts=True).collect())
    assert counts == [(d, len(i)) for d, i in got]


def test_encoding_of_an_empty_table(spark):
    assert encoding.encode_texts(spark.createDataFrame([], "doc long, text string"), "doc").collect() == []
    with pytest.raises(ValueError):
        encoding.encode_texts(spark.createDataFrame([], "doc long, text string"), "doc", chunk=10, overlap=10)


def test_bin_completion_beats_or_meets_best_fit():
    rng = np.random.default_rng(5)
    for n, top in ((40, 100), (120, 70), (300, 50)):
        sizes = rng.integers(1, top, n)
        bins = packing.bin_completion(sizes, 100)
        assert sorted(i for b in bins for i in b) == list(range(n))
        assert all(sizes[b].sum() <= 100 for b in bins)
        assert len(bins) <= len(packing.best_fit_decreasing(sizes, 100))
    # best fit decreasing needs four containers here, three do
    sizes = np.array([6, 5, 5, 4, 4, 3, 3])
    assert len(packing.bin_completion(sizes, 10)) == 3
    assert packing.bin_completion(np.zeros(0, np.int64), 10) in ([], [[]])


def test_fillings_have_any_number_of_items():
    """The search reaches the lower bound with five items and more in a container."""
    rng = np.random.default_rng(0)
    for least, most in ((300, 1500), (200, 900), (50, 300)):
        sizes = rng.integers(least, most, 2000)
        bins = packing.bin_completion(sizes, 4096)
        assert sorted(i for b in bins for i in b) == list(range(2000)) and all(sizes[b].sum() <= 4096 for b in bins)
        assert len(bins) <= min(-(-int(sizes.sum()) // 4096) + 1, len(packing.best_fit_decreasing(sizes, 4096)))
        assert max(map(len, bins)) >= 5
    assert {len(f) for f in packing.fillings([1, 1, 2, 2, 3, 5, 8], 11)} >= {2}
    assert sum([1, 1, 2, 2, 3, 5, 8][i] for i in packing.completions([1, 1, 2, 2, 3, 5, 8], 11)[0]) == 11


def test_dominated_sets():
    sizes = [2, 3, 4, 5, 9]
    assert packing.dominated(sizes, (0, 1), 10)  # 2 and 3 may give way to 5
    assert not packing.dominated(sizes, (4,), 10) and packing.dominated(sizes, (3,), 10)


@pytest.mark.parametrize("text", ["'ll" * 400, "ab" * 700 + " " + "'s" * 300, "\t" * 999 + "x", "x" * 5000 + "y 1" * 40, " \n" * 800])
def test_runs_without_breaks_are_stitched(own, reference, text):
    for chunk, overlap in ((50, 12), (64, 9), (101, 40)):
        offsets = range(0, max(1, len(text) - overlap), chunk - overlap)
        pieces = [(o, text[o : o + chunk]) for o in offsets]
        encoded = own.encode_with_starts([t for _, t in pieces])
        asked = []

        def encode(texts):
            asked.extend(map(len, texts))
            return own.encode_with_starts(texts)

        got = encoding.stitch([(o, t, i, s) for (o, t), (i, s) in zip(pieces, encoded)], encode)
        assert list(got) == reference.encode_ordinary(text)
        assert sum(asked) <= 6 * len(text)


def test_pieces_of_one_hash_are_told_apart(own, monkeypatch):
    fresh = bpe.Encoder(open(encoding.vocabulary_path(), "rb").read())
    monkeypatch.setattr(bpe, "span_hashes", lambda points, starts, ends: (ends - starts).astype(np.uint64))
    with pytest.raises(ValueError):
        fresh.encode(["ab", "cd"])


def check(placed, capacity, items):
    """Nothing lost, nothing too full, offsets and places in order, only large items divided."""
    used: dict = {}
    for r in sorted(placed, key=lambda r: (r.container, r.place)):
        have = used.setdefault(r.container, [])
        assert r.place == len(have) and r.offset == sum(have)
        have.append(r.tokens)
    assert all(sum(u) <= capacity for u in used.values())
    total: dict = {}
    total_size: dict = {}
    for k, n in items:
        total_size[k] = max(total_size.get(k, 0), n or 0)
    for r in placed:
        total[r.record] = total.get(r.record, 0) + r.tokens
        assert 0 <= r.part < max(1, -(-total_size[r.record] // capacity))
    want: dict = {}
    for k, n in items:
        want[k] = want.get(k, 0) + (n or 0)
    assert total == want
    parts = sum(max(1, -(-(n or 0) // capacity)) for _, n in items)
    assert len(placed) == parts
    return used


def test_packing(spark):
    rng = random.Random(2)
    items = [(i, rng.choice([0, 1, 5, 30, 60, 100, 101, 250, None, rng.randrange(1, 100)])) for i in range(900)] + [(None, 7), (5, 60), (5, 60)]
    df = spark.createDataFrame(items, "doc long, n long").withColumn("record", F.lit("x")).withColumn("part", F.lit(0)).withColumn("tokens", F.lit(0))
    used = check(packing.pack(df, "doc", "n", 100, block_items=120).collect(), 100, items)
    assert len(used) <= 1.02 * -(-sum(n or 0 for _, n in items) // 100) + 1
    assert packing.pack(spark.createDataFrame([], "doc long, n long"), "doc", "n").collect() == []
    check(packing.pack(spark.createDataFrame([(1, 0), (2, None)], "doc long, n long"), "doc", "n").collect(), 4096, [(1, 0), (2, None)])
    with pytest.raises(ValueError):
        packing.pack(df, "doc", "n", 0)
