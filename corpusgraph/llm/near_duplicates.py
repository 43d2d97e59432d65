"""Near-duplicate records with small edits (problem 1).

A text is its set of word shingles; texts are alike if the Jaccard similarity of their sets reaches a threshold. Pairs are
found by covering locality-sensitive hashing over min-hash vectors: a sketch has ``REPEATS`` vectors of seven min-hashes.
Seven structured bit masks, the non-zero code words of the simplex code, choose four of the seven places each; the places
that a mask leaves out are the lines of the Fano plane. Any two vectors that differ in at most two places therefore agree
on all places of some mask and meet in its table: within that radius nothing is lost, whatever the data. A pair at
similarity 0.6 comes within the radius of one vector with probability 0.48 (counting the three-place differences that
masks also cover), and of at least one of eight with 0.995; at 0.7 with 0.9999.

Equal shingle sets form a class first, and only a class's representative enters the tables, so a group of copies
of any size costs one row a table. All pairs that meet are verified exactly on their shingle sets, a batch of pairs at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusgraph.functions.codepoints import mix
from corpusgraph.llm.shingles import HASH_BITS, shingle_sets
from corpusgraph.plans.lineage import cut
from corpusgraph.sources.tables import table

#: Places of one min-hash vector, vectors of a sketch, and radius within which two vectors always meet.
PLACES, REPEATS, RADIUS = 7, 8, 2
#: The masks: place i has the 3-bit number i + 1, and mask v keeps the places whose number has an odd product with v.
MASKS = np.array([[i for i in range(PLACES) if bin((i + 1) & v).count("1") % 2] for v in range(1, PLACES + 1)])


def _signatures(size: int, least_words: int):
    rng = np.random.default_rng(20240229)
    factors = rng.integers(0, 1 << 32, PLACES * REPEATS, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
    offsets = rng.integers(0, 1 << 32, PLACES * REPEATS, dtype=np.uint64).astype(np.uint32)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets, first = shingle_sets(batch["text"].tolist(), size, least_words)
            counts = np.diff(first)
            kept = np.flatnonzero(counts)
            if not len(kept):
                continue
            starts = first[:-1][kept]
            spread = mix(sets)
            short = (spread >> np.uint64(32)).astype(np.uint32)
            sketch = np.empty((len(kept), len(factors)), np.uint16)  # of a minimum 16 bits tell it from others: a key has 64
            for i in range(len(factors)):
                sketch[:, i] = np.minimum.reduceat((short ^ offsets[i]) * factors[i], starts)
            yield pd.DataFrame(
                {
                    "record": batch["record"].to_numpy()[kept],
                    "set_a": np.add.reduceat(spread, starts).view(np.int64),
                    "set_b": np.bitwise_xor.reduceat(mix(spread + np.uint64(1)), starts).view(np.int64),
                    "sketch": [row.tobytes() for row in sketch],
                }
            )

    return run


def _meeting_places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The key of a sketch in each table: a hash of the four min-hashes that the table's mask keeps."""
    for batch in batches:
        if not len(batch):
            continue
        sketch = np.frombuffer(b"".join(batch["sketch"]), np.uint16).reshape(len(batch), REPEATS, PLACES)
        keys = np.zeros((len(batch), REPEATS, len(MASKS)), np.uint64)
        for m, places in enumerate(MASKS):
            h = np.arange(REPEATS, dtype=np.uint64) * np.uint64(len(MASKS)) + np.uint64(m)
            for p in places:
                h = mix(h + sketch[:, :, p])
            keys[:, :, m] = h
        yield pd.DataFrame({"key": keys.reshape(-1).view(np.int64), "record": np.repeat(batch["record"].to_numpy(), REPEATS * len(MASKS))})


#: Pairs and shingles that are verified at once; only a pair of longer sets takes more.
_PAIRS_AT_ONCE, _SHINGLES_AT_ONCE = 1 << (64 - HASH_BITS), 2_000_000


def shared(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Of each pair of sets the number of common members: both sets of all pairs are sorted at once, a pair's number before the hash."""
    sizes = np.array([len(a) + len(b) for a, b in zip(left, right)], np.int64)
    pair = np.repeat(np.arange(len(sizes), dtype=np.uint64), sizes)
    every = np.concatenate([x for both in zip(left, right) for x in both]).astype(np.uint64)
    keyed = np.sort(pair << np.uint64(HASH_BITS) | every)
    twice = keyed[1:][keyed[1:] == keyed[:-1]] >> np.uint64(HASH_BITS)
    return np.bincount(twice.astype(np.int64), minlength=len(sizes))


def _similar(size: int, least: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            known = pd.concat([batch[["a", "text_a"]].set_axis(["record", "text"], axis=1), batch[["b", "text_b"]].set_axis(["record", "text"], axis=1)])
            number, records = pd.factorize(known["record"])
            texts = known["text"].to_numpy()[np.unique(number, return_index=True)[1]]
            sets, first = shingle_sets(texts.tolist(), size, 0)  # once for each text of the batch
            parts = [sets[first[i] : first[i + 1]] for i in range(len(records))]
            left, right = ([parts[i] for i in side] for side in np.split(number, 2))
            both = np.array([len(a) + len(b) for a, b in zip(left, right)], np.int64)
            total = np.cumsum(both)
            at = 0
            while at < len(batch):
                end = int(np.searchsorted(total, (total[at - 1] if at else 0) + _SHINGLES_AT_ONCE, "right"))
                end = min(max(end, at + 1), at + _PAIRS_AT_ONCE)
                common = shared(left[at:end], right[at:end])
                alike = common >= least * (both[at:end] - common) - 1e-9
                yield batch.iloc[at:end].loc[alike, ["a", "b"]]
                at = end

    return run


def near_duplicates(records: DataFrame, key: str, text: str = "text", size: int = 5, least: float = 0.8, least_words: int = 0) -> tuple[DataFrame, DataFrame]:
    """Classes of records with the same shingle set, and links between alike classes.

    Returns ``members (record, class_id)``, where ``class_id`` is the least record of its class, and
    ``links (a, b)`` between classes, ``a < b``, whose sets have a Jaccard similarity of at least ``least``. A set's
    members are sequences of ``size`` neighbouring words; words are runs of letters and numbers of the lower-cased text.

    A null or empty text, one of fewer than ``least_words`` words, or one shorter than a shingle has no shingles and is in
    neither result; nor is a row with a null key. A key should be unique: rows that repeat a key are taken as one record if
    their texts agree. Extra columns are ignored. Sets are compared by 52-bit hashes of the shingles.
    """
    rows = records.select(F.col(key).cast("bigint").alias("record"), F.col(text).alias("text")).dropna()
    signed = cut(rows.mapInPandas(_signatures(size, least_words), "record bigint, set_a bigint, set_b bigint, sketch binary"), "signatures")
    members = signed.select("record", F.struct("set_a", "set_b").alias("set"))
    ids = members.groupBy("set").agg(F.min("record").alias("class_id"))
    members = members.join(ids, "set").select("record", "class_id").distinct()

    heads = signed.groupBy("set_a", "set_b").agg(F.min(F.struct("record", "sketch")).alias("head")).select("head.record", "head.sketch")
    met = heads.mapInPandas(_meeting_places, "key bigint, record bigint")
    pairs = (
        met.withColumnRenamed("record", "a").join(met.withColumnRenamed("record", "b"), "key").where(F.col("a") < F.col("b")).select("a", "b").distinct()
    )
    pairs = cut(pairs, "candidates")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("record")).distinct()
    texts = rows.join(wanted, "record", "left_semi").dropDuplicates(["record"])  # compressed texts are smaller than their sets of hashes
    both = pairs.join(texts.select(F.col("record").alias("a"), F.col("text").alias("text_a")), "a").join(
        texts.select(F.col("record").alias("b"), F.col("text").alias("text_b")), "b"
    )
    links = both.mapInPandas(_similar(size, least), "a bigint, b bigint")
    return members, links


def all_pairs(members: DataFrame, links: DataFrame) -> DataFrame:
    """The record pairs ``(a, b)``, ``a < b``, behind classes and links: only for results that must name every pair."""
    left = members.select(F.col("record").alias("x"), F.col("class_id").alias("class_a"))
    right = members.select(F.col("record").alias("y"), F.col("class_id").alias("class_b"))
    within = left.join(right, F.col("class_a") == F.col("class_b")).where("x < y").select("x", "y")
    sides = links.select(F.col("a").alias("class_a"), F.col("b").alias("class_b"))
    across = sides.join(left, "class_a").join(right, "class_b").select("x", "y")
    return within.unionByName(across).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def class_summary(members: DataFrame, links: DataFrame) -> DataFrame:
    """One row a record: its class, the class's size, and the number of other classes it is linked to."""
    sizes = members.groupBy("class_id").agg(F.count("*").alias("copies"))
    degree = links.select(F.explode(F.array("a", "b")).alias("class_id")).groupBy("class_id").agg(F.count("*").alias("links"))
    known = sizes.join(degree, "class_id", "left").fillna(0, ["links"])
    return members.join(known, "class_id").select("record", "class_id", "copies", "links")


def _corpus(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return near_duplicates(table(spark, folder, "chunks"), "chunk_no", size=3, least=0.6, least_words=40)


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return all_pairs(*_corpus(spark, folder)).select(F.col("a").alias("chunk_no_a"), F.col("b").alias("chunk_no_b"))


def p1_classes(spark: SparkSession, folder: str) -> DataFrame:
    """Near-duplicate classes at the library's usual setting: five words, similarity 0.8."""
    members, links = near_duplicates(table(spark, folder, "chunks"), "chunk_no")
    return class_summary(members, links).withColumnRenamed("record", "chunk_no")


QUERIES = {"p1_found": p1_found, "p1_classes": p1_classes}

SQL = {
    "p1_found": """
WITH w AS (SELECT chunk_no, text, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS words FROM chunks),
t AS (SELECT min(chunk_no) AS id, text, any_value(words) AS words FROM w WHERE len(words) >= 40 GROUP BY text),
s AS (SELECT DISTINCT id, hash(words[i], words[i + 1], words[i + 2]) AS h FROM (SELECT id, words, unnest(range(1, len(words) - 1)) AS i FROM t)),
n AS (SELECT id, count(*) AS n FROM s GROUP BY id),
met AS (SELECT a.id AS a, b.id AS b, count(*) AS k FROM s a JOIN s b ON a.h = b.h AND a.id < b.id GROUP BY ALL),
alike AS (SELECT a, b FROM met JOIN n x ON x.id = a JOIN n y ON y.id = b WHERE k >= 0.6 * (x.n + y.n - k) - 1e-9),
m AS (SELECT chunk_no, id FROM w JOIN t USING (text)),
p AS (
  SELECT x.chunk_no AS x, y.chunk_no AS y FROM m x JOIN m y ON x.id = y.id AND x.chunk_no < y.chunk_no
  UNION ALL SELECT x.chunk_no, y.chunk_no FROM alike JOIN m x ON x.id = a JOIN m y ON y.id = b
)
SELECT least(x, y) AS chunk_no_a, greatest(x, y) AS chunk_no_b FROM p""",
    "p1_classes": """
WITH w AS (SELECT chunk_no, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS words FROM chunks WHERE text IS NOT NULL),
s AS (SELECT DISTINCT chunk_no, hash(words[i], words[i + 1], words[i + 2], words[i + 3], words[i + 4]) AS h FROM (SELECT chunk_no, words, unnest(range(1, len(words) - 3)) AS i FROM w)),
c AS (SELECT chunk_no, min(chunk_no) OVER (PARTITION BY every) AS class_id, count(*) OVER (PARTITION BY every) AS copies FROM (SELECT chunk_no, list_sort(list(h)) AS every FROM s GROUP BY chunk_no)),
f AS (SELECT s.* FROM s JOIN c ON c.chunk_no = s.chunk_no AND c.class_id = c.chunk_no),
n AS (SELECT chunk_no, count(*) AS n FROM f GROUP BY chunk_no),
met AS (SELECT a.chunk_no AS a, b.chunk_no AS b, count(*) AS k FROM f a JOIN f b ON a.h = b.h AND a.chunk_no < b.chunk_no GROUP BY ALL),
alike AS (SELECT a, b FROM met JOIN n x ON x.chunk_no = a JOIN n y ON y.chunk_no = b WHERE k >= 0.8 * (x.n + y.n - k) - 1e-9),
l AS (SELECT class_id, count(*) AS links FROM (SELECT unnest([a, b]) AS class_id FROM alike) GROUP BY class_id)
SELECT chunk_no, class_id, copies, coalesce(links, 0) AS links FROM c LEFT JOIN l USING (class_id)""",
}
