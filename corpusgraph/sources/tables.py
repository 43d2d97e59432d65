"""Reading the managed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One managed table; Parquet gives column pruning and pushed-down filters."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
