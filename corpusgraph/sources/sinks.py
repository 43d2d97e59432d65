"""Sinks: JSON lines, Markdown with front matter, staged publishing, catalogues."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_json_lines(rows: DataFrame, path: str) -> None:
    """One JSON object a line, nulls kept; columns in the order of their names, as for hashing."""
    rows.select(*sorted(rows.columns)).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def markdown_with_front_matter(rows: DataFrame, metadata: list[str]) -> DataFrame:
    """Adds ``file``: the text below a YAML block of the metadata columns, values as JSON strings."""
    value = lambda c: F.regexp_extract(F.to_json(F.struct(F.coalesce(F.col(c).cast("string"), F.lit("")).alias("v"))), r"(?s)^\{\"v\":(.*)\}$", 1)
    lines = [F.concat(F.lit(f"{c}: "), value(c)) for c in metadata]
    return rows.withColumn("file", F.concat(F.lit("---\n"), F.concat_ws("\n", *lines), F.lit("\n---\n\n"), "text"))


def write_corpus(tables: dict[str, DataFrame], path: str, partition_by: tuple[str, ...] = ("corpus", "product_version")) -> None:
    """Managed tables as Parquet, partitioned by corpus and release where they have these columns, for partition pruning."""
    for name, df in tables.items():
        by = [c for c in partition_by if c in df.columns]
        df.write.mode("overwrite").partitionBy(*by).parquet(f"{path}/{name}.parquet")


def publish(spark: SparkSession, tables: dict[str, DataFrame], target: str, checks: DataFrame | None = None) -> str:
    """Writes tables to a staging folder and renames it to a new version only if no check failed; a pointer file names the version.

    A failure deletes the staging folder and leaves the published version as it is.
    """
    path_of = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p)
    fs = path_of(target).getFileSystem(spark._jsc.hadoopConfiguration())
    version = uuid.uuid4().hex
    staging = f"{target}/.building-{version}"
    try:
        write_corpus(tables, staging)
        failed = [] if checks is None else checks.where("failures > 0").collect()  # one row a check
        if failed:
            raise ValueError("checks failed: " + ", ".join(r["check_name"] for r in failed))
        fs.rename(path_of(staging), path_of(f"{target}/{version}"))
    except Exception:
        fs.delete(path_of(staging), True)
        raise
    out = fs.create(path_of(f"{target}/active.json"), True)
    out.write(bytearray(json.dumps({"version": version}).encode()))
    out.close()
    return f"{target}/{version}"


def active(spark: SparkSession, target: str) -> str:
    """The folder of the published version."""
    row = spark.read.json(f"{target}/active.json").collect()[0]
    return f"{target}/{row['version']}"


def catalog_of(spark: SparkSession, tables: dict[str, DataFrame], corpus: str, product_version: str) -> DataFrame:
    """A catalogue entry for each dataset: id, number of rows, and an order-free digest of the rows."""
    out = None
    for name, df in tables.items():
        row = df.agg(F.count("*").alias("records"), F.coalesce(F.sum(F.xxhash64(F.to_json(F.struct("*"))).cast("decimal(38,0)")), F.lit(0)).cast("string").alias("digest")).select(
            F.lit(f"{corpus}.{product_version}.{name}").alias("id"), F.lit(corpus).alias("corpus"), F.lit(product_version).alias("product_version"), F.lit(name).alias("name"), "records", F.sha2("digest", 256).alias("sha256")
        )
        out = row if out is None else out.unionByName(row)
    return out
