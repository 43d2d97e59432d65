"""What changed between full snapshots (problem 4).

Keys get persistent ordinals, kept in a key table: a key has the same ordinal in every delivery. A snapshot is then, for each block of 32,768 ordinals, a bitmap of the keys present and a
vector of content hashes aligned with the ordinals of the bitmap, compressed. The later bitmap AND NOT the earlier
one gives additions, the reverse removals; where both have the bit, the aligned vectors tell the changes. Blocks are
bounded, so no task holds more than one block of two snapshots at a time, and a snapshot moves as a few compressed bytes
a key instead of its rows. With a store, blocks of earlier releases are read, not made again. Only the differing ordinals are turned back into keys.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusgraph.plans.lineage import cut, scratch
from corpusgraph.plans.ordinals import BLOCK, assign_ordinals, block_of, exists, place_of

CHANGES = ["added", "removed", "changed"]


def last_loaded(rows: DataFrame, key: str, release: str, content: Column, order: list[str]) -> DataFrame:
    """One row ``(snapshot_key, snapshot, content)`` a key and release: the one loaded last.

    ``order`` names the columns that tell the last load, most significant first; a null counts as earliest, and full
    ties go to the greatest content, a null content losing. Partial aggregation keeps a hot key cheap. Rows without
    a key or release belong to no snapshot.
    """
    rank = F.struct(*[F.col(c) for c in order], content.isNotNull(), content)
    return (
        rows.where(F.col(key).isNotNull() & F.col(release).isNotNull())
        .groupBy(F.col(key).alias("snapshot_key"), F.col(release).alias("snapshot"))
        .agg(F.max(F.struct(rank.alias("rank"), content.alias("content"))).alias("last"))
        .select("snapshot_key", "snapshot", F.col("last.content").alias("content"))
    )


def _pack(places: np.ndarray, hashes: np.ndarray, nulls: np.ndarray) -> tuple[bytes, bytes]:
    """Bitmap of the places and the hashes in their order (0 and a flag for null), both compressed."""
    order = np.argsort(places)
    bits = np.zeros(BLOCK, bool)
    bits[places] = True
    values = np.where(nulls, 0, hashes)[order].astype("<i8")
    return zlib.compress(np.packbits(bits).tobytes(), 1), zlib.compress(np.packbits(nulls[order]).tobytes(), 1) + b"|" + values.tobytes()


def _unpack(bitmap: bytes | None, vector: bytes | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Presence, hash and null flag, each aligned with the ordinals of the block."""
    present, values, nulls = np.zeros(BLOCK, bool), np.zeros(BLOCK, np.int64), np.zeros(BLOCK, bool)
    if bitmap is None:
        return present, values, nulls
    present = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8)).astype(bool)
    n = int(present.sum())
    inner = zlib.decompressobj()
    flags = inner.decompress(vector)
    rest = inner.unused_data[1:]
    values[present] = np.frombuffer(rest, "<i8", n)
    nulls[present] = np.unpackbits(np.frombuffer(flags, np.uint8))[:n].astype(bool)
    return present, values, nulls


def _pack_blocks(group: pd.DataFrame) -> pd.DataFrame:
    bitmap, vector = _pack(group["place"].to_numpy(np.int64), group["hash"].fillna(0).to_numpy(np.int64), group["is_null"].to_numpy(bool))
    return pd.DataFrame({"block": [group["block"].iloc[0]], "snapshot": [group["snapshot"].iloc[0]], "bitmap": [bitmap], "vector": [vector]})


def _differences(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for row in batch.itertuples(index=False):
            was, old, old_null = _unpack(row.bitmap_before, row.vector_before)
            now, new, new_null = _unpack(row.bitmap, row.vector)
            kinds = [now & ~was, was & ~now, now & was & ((old != new) | (old_null != new_null))]
            places = [np.flatnonzero(k) for k in kinds]
            yield pd.DataFrame(
                {
                    "ordinal": np.concatenate(places) + (row.block - 1) * BLOCK + 1,
                    "step": np.int32(row.step),
                    "change": np.repeat(np.arange(3, dtype=np.int32), [len(p) for p in places]),
                }
            )


def snapshot_changes(latest: DataFrame, releases: DataFrame, version: str = "product_version", released: str = "released_at", store: str | None = None) -> DataFrame:
    """Rows ``product_version, record_key, change`` of every key that differs between two consecutive releases.

    ``latest`` has one row a key and snapshot, as made by :func:`last_loaded`. Releases follow each other by ``released``,
    then by version; a repeated version counts once, at its earliest time, one without a time comes first. Snapshots of
    unlisted releases are left out. A release without rows is an empty snapshot: all keys of the one before are removed.
    Null content equals only null content. The first release has no cases; empty tables give none.

    ``store`` is a folder that keeps the key table and the blocks of all snapshots delivered so far: ``latest`` then needs to have the new
    snapshots only, and one that is delivered again replaces what was stored. Contents are compared by 64-bit hashes.
    """
    spark = latest.sparkSession
    folder = store or scratch(spark, "snapshots")
    steps = (
        releases.where(F.col(version).isNotNull())
        .groupBy(F.col(version).alias("snapshot"))
        .agg(F.min(released).alias("at"))
        .withColumn("step", F.row_number().over(Window.orderBy("at", "snapshot")))  # one row a release
        .select("snapshot", "step")
    )
    ordinals = assign_ordinals(latest, "snapshot_key", folder=f"{folder}/keys", name="snapshot-keys")
    placed = (
        latest.join(F.broadcast(steps.select("snapshot")), "snapshot")
        .join(ordinals, "snapshot_key")
        .select(block_of("ordinal").alias("block"), place_of("ordinal").alias("place"), "snapshot", F.xxhash64("content").alias("hash"), F.col("content").isNull().alias("is_null"))
    )
    made = placed.groupBy("block", "snapshot").applyInPandas(_pack_blocks, "block bigint, snapshot string, bitmap binary, vector binary")
    blocks = f"{folder}/blocks"
    delivery = 1 + (spark.read.parquet(blocks).agg(F.coalesce(F.max("delivery"), F.lit(0))).collect()[0][0] if exists(spark, blocks) else 0)
    made.withColumn("delivery", F.lit(delivery)).write.mode("append").option("compression", "zstd").parquet(blocks)
    stored = spark.read.schema("block bigint, snapshot string, bitmap binary, vector binary, delivery int").parquet(blocks)
    newest = stored.groupBy("snapshot").agg(F.max("delivery").alias("delivery"))  # one row a release
    packed = stored.join(F.broadcast(newest), ["snapshot", "delivery"]).join(F.broadcast(steps), "snapshot")

    # every block stands beside its state one step earlier; a block that a snapshot lacks is an empty one
    after = packed.select("block", "step", "bitmap", "vector")
    before = packed.select("block", (F.col("step") + 1).alias("step"), F.col("bitmap").alias("bitmap_before"), F.col("vector").alias("vector_before"))
    last = steps.agg(F.max("step").alias("last"))
    pairs = after.join(before, ["block", "step"], "full_outer").crossJoin(F.broadcast(last)).where((F.col("step") > 1) & (F.col("step") <= F.col("last"))).drop("last")
    found = pairs.mapInPandas(_differences, "ordinal bigint, step int, change int")
    names = F.array(*[F.lit(c) for c in CHANGES])
    return (
        found.join(ordinals, "ordinal")
        .join(F.broadcast(steps), "step")
        .select(F.col("snapshot").alias("product_version"), F.col("snapshot_key").alias("record_key"), F.element_at(names, F.col("change") + 1).alias("change"))
    )


def corpus_changes(documents: DataFrame, files: DataFrame, releases: DataFrame) -> DataFrame:
    """Changes of files (by path) and documents (by logical id) from each release to the next; hashes regardless of case."""
    digest = F.lower("sha256")
    sides = {
        "files": last_loaded(files, "path", "product_version", digest, ["loaded_at"]),
        "documents": last_loaded(documents, "logical_id", "product_version", digest, ["loaded_at", "doc_id"]),
    }
    parts = [snapshot_changes(cut(latest, f"latest-{name}"), releases).select(F.lit(name).alias("table_name"), "*") for name, latest in sides.items()]
    return parts[0].unionByName(parts[1])


def change_counts(changes: DataFrame) -> DataFrame:
    """Changes by table, release and kind."""
    return changes.groupBy("table_name", "product_version", "change").agg(F.count("*").alias("n"))
