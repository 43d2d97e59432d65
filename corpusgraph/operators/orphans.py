"""References to records that do not exist (problem 3).

A register-blocked Bloom filter of the parent keys is built by aggregation: one 64-bit word a block, four
bits of it a key, a thousand words a page. A reference whose word lacks one of the bits is an orphan for certain and
takes no part in the join. Only filter-positive references are verified by an exact join, where the earliest
load of the parent must not come after the load of the reference.

The filter always has a word for every four parents, so it lets the same share of absent keys through at every size. It is broadcast
as long as its size, which is known before it is built, stays within ``broadcast_words``; a larger one is looked up page by page: both
sides are partitioned by page.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: One word for every four parent keys is 16 bits a key: fewer than one in a hundred absent keys pass.
KEYS_PER_WORD = 4
#: Words of a page, and of a filter that is broadcast: 8 bytes each, 64 MB at most.
PAGE, BROADCAST_WORDS = 1024, 1 << 23


@dataclass(frozen=True)
class Reference:
    """One kind of reference. ``keys`` pairs columns of the child with columns of the parent."""

    name: str
    child: DataFrame
    record: str
    keys: list[tuple[str, str]]
    parent: DataFrame
    child_time: str = "loaded_at"
    parent_time: str = "loaded_at"
    blank_is_none: bool = False


def _mask(h: Column) -> Column:
    """Four bits of a 64-bit word, taken from the upper half of the key's hash."""
    one = F.lit(1).cast("bigint")
    bits = [F.call_function("shiftleft", one, F.shiftrightunsigned(h, 34 + 6 * i).bitwiseAND(F.lit(63)).cast("int")) for i in range(4)]
    return bits[0].bitwiseOR(bits[1]).bitwiseOR(bits[2]).bitwiseOR(bits[3])


def _word(h: Column, words: int) -> Column:
    return F.pmod(h, F.lit(words).cast("bigint"))


def filter_words(keys: int) -> int:
    """Words of a filter for so many keys: a power of two, one page at least."""
    return max(PAGE, 1 << max(0, -(-keys // KEYS_PER_WORD) - 1).bit_length())


def passing_share(keys: int, words: int) -> float:
    """The share of absent keys that a filter lets through, by calculation: over the number of keys that share a word."""
    load = keys / words
    share, weight = 0.0, math.exp(-load)
    for n in range(1, 200):
        weight *= load / n
        share += weight * (1 - (1 - 1 / 64) ** (4 * n)) ** 4
    return share


def bloom_pages(keys: DataFrame, columns: list[str], words: int) -> DataFrame:
    """The filter as rows ``(page, words)``: partial aggregation ors the masks before the shuffle; every page has all its words."""
    h = F.xxhash64(*columns)
    empty = keys.sparkSession.range(words).select(F.col("id").alias("word"), F.lit(0).cast("bigint").alias("mask"))
    filled = keys.select(_word(h, words).alias("word"), _mask(h).alias("mask")).unionByName(empty).groupBy("word").agg(F.bit_or("mask").alias("bits"))
    pages = filled.groupBy(F.floor(F.col("word") / PAGE).alias("page")).agg(F.array_sort(F.collect_list(F.struct("word", "bits"))).alias("w"))
    return pages.select("page", F.transform("w", lambda x: x["bits"]).alias("words"))


def orphans(ref: Reference, broadcast_words: int = BROADCAST_WORDS) -> DataFrame:
    """Rows ``table_name, period, record_no`` of ``ref.child`` whose target is absent or was loaded later.

    Keys are compared exactly. A reference with a null key is no reference, and with ``blank_is_none`` neither is an empty
    one; a null in any further key column of the child (such as a release) matches nothing, so the row is an orphan. Repeated
    rows each count. A child without a load time can't be shown to follow its target: it is an orphan with a null
    period. Parents without a load time count as never loaded. Empty tables give no rows, or all references. Extra
    columns are ignored, whatever their names.
    """
    names = [f"k{i}" for i in range(len(ref.keys))]
    first = ref.child[ref.keys[0][0]]
    real = first.isNotNull() & (first != "") if ref.blank_is_none else first.isNotNull()
    child = ref.child.where(real).select(
        F.col(ref.record).cast("bigint").alias("record_no"), F.col(ref.child_time).alias("at"), *[F.col(c).alias(n) for (c, _), n in zip(ref.keys, names)]
    )
    parent = ref.parent.select(*[F.col(p).alias(n) for (_, p), n in zip(ref.keys, names)], F.col(ref.parent_time).alias("since")).dropna(subset=names)
    count = parent.agg(F.approx_count_distinct(F.xxhash64(*names)).alias("n")).collect()[0]["n"]
    words = filter_words(count)

    h = F.xxhash64(*names)
    probed = child.withColumn("mask", _mask(h)).withColumn("word", _word(h, words)).withColumn("page", F.floor(F.col("word") / PAGE))
    pages = bloom_pages(parent, names, words)
    probed = probed.join(F.broadcast(pages) if words <= broadcast_words else pages.hint("merge"), "page", "left")
    probed = probed.withColumn("bits", F.element_at("words", (F.col("word") % PAGE + 1).cast("int")))
    maybe = F.coalesce(F.col("bits").bitwiseAND(F.col("mask")) == F.col("mask"), F.lit(False))
    whole = F.lit(True)
    for n in names:
        whole = whole & F.col(n).isNotNull()
    probed = probed.withColumn("maybe", maybe & whole & F.col("at").isNotNull()).drop("page", "word", "words", "mask", "bits")

    certain = probed.where(~F.col("maybe"))
    known = parent.groupBy(*names).agg(F.min("since").alias("since"))
    checked = probed.where("maybe").join(known, names, "left").where(F.col("since").isNull() | (F.col("since") > F.col("at")))
    out = certain.select("record_no", "at").unionByName(checked.select("record_no", "at"))
    return out.select(F.lit(ref.name).alias("table_name"), F.date_format("at", "yyyy-MM").alias("period"), "record_no")


def corpus_references(documents: DataFrame, chunks: DataFrame, links: DataFrame, files: DataFrame) -> list[Reference]:
    """The references of the versioned corpus."""
    return [
        Reference("documents", documents, "doc_id", [("source_path", "path"), ("product_version", "product_version")], files, blank_is_none=True),
        Reference("chunks", chunks, "chunk_no", [("document_id", "id")], documents),
        Reference("links", links, "link_no", [("target_logical_id", "logical_id"), ("product_version", "product_version")], documents),
    ]


def find_orphans(references: list[Reference], broadcast_words: int = BROADCAST_WORDS) -> DataFrame:
    """The orphans of all references, one row each."""
    found = [orphans(r, broadcast_words) for r in references]
    out = found[0]
    for df in found[1:]:
        out = out.unionByName(df)
    return out


def orphan_report(references: list[Reference], broadcast_words: int = BROADCAST_WORDS) -> DataFrame:
    """Orphans by table and period."""
    return find_orphans(references, broadcast_words).groupBy("table_name", "period").agg(F.count("*").alias("orphans"))
