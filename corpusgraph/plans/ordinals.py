"""Persistent ordinals of keys, for bitmaps and ordinal-aligned vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusgraph.plans.lineage import cut, scratch

#: Ordinals that one block of Spark's bitmap functions covers.
BLOCK = 32768
_WITHIN = (1 << 33) - 1  # places that Spark's increasing numbers have within a partition


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a table was written to ``path``."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def assign_ordinals(keys: DataFrame, *columns: str, folder: str | None = None, partitions: int | None = None, name: str = "ordinals") -> DataFrame:
    """The key table ``(columns, ordinal)`` of ``folder`` with the keys of ``keys`` added to it; without a folder, a new one.

    A key keeps the ordinal that it got first, in this delivery and in all later ones, so that bitmaps stored by ordinal stay valid; new
    keys get the next ones, densely from 1 on. Distinct non-null combinations count; null keys get no ordinal. New keys are spread by hash and sorted
    there, and only the number of keys of each partition is brought together.
    """
    spark = keys.sparkSession
    folder = folder or scratch(spark, name)
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    new = keys.select(*columns).dropna(how="any").distinct()
    start = 0
    if exists(spark, folder):
        known = spark.read.parquet(folder)
        start = known.agg(F.coalesce(F.max("ordinal"), F.lit(0))).collect()[0][0]
        new = new.join(known, list(columns), "left_anti")
    placed = cut(new.repartition(partitions, *columns).sortWithinPartitions(*columns).withColumn("__at", F.monotonically_increasing_id()), name)
    sizes = placed.groupBy(F.shiftright("__at", 33).alias("__part")).agg(F.count("*").alias("n")).orderBy("__part").collect()  # one row a partition
    first, offsets = start + 1, []
    for row in sizes:
        offsets.append((row["__part"], first))
        first += row["n"]
    begins = spark.createDataFrame(offsets, "__part bigint, __first bigint")
    numbered = placed.withColumn("__part", F.shiftright("__at", 33)).join(F.broadcast(begins), "__part")
    numbered.select(*columns, (F.col("__first") + F.col("__at").bitwiseAND(F.lit(_WITHIN))).alias("ordinal")).write.mode("append").option("compression", "zstd").parquet(folder)
    return spark.read.schema(placed.select(*columns, F.lit(0).cast("bigint").alias("ordinal")).schema).parquet(folder)


def block_of(ordinal: Column | str) -> Column:
    return F.bitmap_bucket_number(ordinal)


def place_of(ordinal: Column | str) -> Column:
    return F.bitmap_bit_position(ordinal)
