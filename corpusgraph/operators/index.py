"""The stored search index: postings, result rows, vectors and statistics, written once and read by every search.

Postings and rows lie in folders by a hash of their term or key, sorted by it, so that a search opens the folders of its own terms and
keys and, within their files, the row groups that the statistics leave.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusgraph.functions import text
from corpusgraph.operators.features import DIMENSIONS, raw_vectors

#: Fixed values of the index: weights of the fields.
FIELDS = {"title": 5.0, "section": 2.0, "tags": 1.5, "text": 1.0}
#: What a search may filter by and divide its ranks by, kept with every posting and vector.
FACETS = ("corpus", "product_version", "is_current")
BUCKETS, SALTS = 64, 4
_TABLES = ("postings", "rows", "vectors", "idf", "stats")


def field_text(chunks: DataFrame, field: str) -> Column:
    c = F.col(field)
    return F.coalesce(F.array_join(c, " ") if dict(chunks.dtypes)[field].startswith("array") else c, F.lit(""))


def bucket_of(value: Column) -> Column:
    return F.pmod(F.xxhash64(value), F.lit(BUCKETS)).cast("int")


@dataclass
class SearchIndex:
    """Tables of one index; ``key`` names the rows. ``dimensions`` is the length of its vectors."""

    key: str
    postings: DataFrame  # bucket, term, key, tf, words, length, facets
    rows: DataFrame  # bucket and all columns of the chunks
    vectors: DataFrame  # key, embedding, facets
    idf: DataFrame  # place, idf
    stats: DataFrame  # facet corpus, n, words

    @property
    def facets(self) -> list[str]:
        return [f for f in FACETS if f in self.postings.columns]


def postings(chunks: DataFrame, key: str, fields: dict[str, float] = FIELDS) -> DataFrame:
    """The inverted index ``(bucket, term, key, tf, words, length)`` and facets: weighted and plain frequency of each term, and the row's
    number of words. Rows are shuffled once, by bucket and a salt of the key, so that a term of a third of all rows is many tasks."""
    used = {f: w for f, w in fields.items() if f in chunks.columns}
    facets = [f for f in FACETS if f in chunks.columns]

    def weighted(field: str, weight: float) -> Column:
        return F.transform(text.words(field_text(chunks, field)), lambda w: F.struct(w.alias("term"), F.lit(float(weight)).alias("weight")))

    per_field = [weighted(f, w) for f, w in used.items()]
    rows = chunks.select(key, *facets, F.concat(*per_field).alias("all")).withColumn("length", F.size("all"))
    each = rows.select(key, *facets, "length", F.explode("all").alias("x")).select(key, *facets, "length", "x.term", "x.weight")
    spread = each.withColumns({"bucket": bucket_of(F.col("term")), "salt": F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("int")}).repartition("bucket", "salt")
    return spread.groupBy("bucket", "salt", "term", key, *facets, "length").agg(F.sum("weight").alias("tf"), F.count("*").alias("words")).drop("salt")


def _vectorised(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield batch.drop(columns="content").assign(raw=list(raw_vectors(batch["content"].fillna("").tolist())))


def _weighed(weights: np.ndarray):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                scaled = np.stack(batch["raw"].to_list()) * weights
                norms = np.linalg.norm(scaled, axis=1, keepdims=True)
                yield batch.drop(columns="raw").assign(embedding=list(np.divide(scaled, norms, out=np.zeros_like(scaled), where=norms > 0)))

    return run


def build_index(chunks: DataFrame, key: str, folder: str, fields: dict[str, float] = FIELDS) -> SearchIndex:
    """Writes the index of ``chunks`` to ``folder`` and opens it. ``key`` should be unique; null texts have no words and a zero vector."""
    spark = chunks.sparkSession
    facets = [f for f in FACETS if f in chunks.columns]
    tasks = spark.sparkContext.defaultParallelism
    if chunks.rdd.getNumPartitions() < tasks:  # a table of few row groups would leave most cores idle
        chunks = chunks.repartition(tasks)

    def write(df: DataFrame, name: str, *by: str) -> DataFrame:
        writer = df.write.mode("overwrite").option("compression", "zstd")
        (writer.partitionBy(*by) if by else writer).parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    terms = write(postings(chunks, key, fields).sortWithinPartitions("bucket", "term"), "postings", "bucket")
    write(chunks.withColumn("bucket", bucket_of(F.col(key))).repartition("bucket").sortWithinPartitions("bucket", key), "rows", "bucket")
    content = F.concat_ws("\n", *[F.col(f) for f in ("title", "section", "text") if f in chunks.columns])
    known = chunks.select(key, *facets, content.alias("content"))
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in known.schema if f.name != "content")
    raw = write(known.mapInPandas(_vectorised, f"{shape}, raw array<float>"), "raw")
    used = raw.select(F.posexplode("raw").alias("place", "x")).where("x <> 0").groupBy("place").agg(F.count("*").alias("df"))
    total = raw.agg(F.count("*").alias("n"))
    places = spark.range(DIMENSIONS).select(F.col("id").cast("int").alias("place"))
    idf = places.join(used, "place", "left").crossJoin(total).select("place", (F.ln((F.col("n") + 1) / (F.coalesce("df", F.lit(0)) + 1)) + 1).alias("idf"))
    weights = _weights(write(idf.coalesce(1), "idf"))
    write(raw.mapInPandas(_weighed(weights), f"{shape}, embedding array<float>"), "vectors")
    part = [f for f in ("corpus",) if f in facets]
    words = terms.groupBy(*part).agg(F.sum("words").alias("words"))
    counted = chunks.groupBy(*part).agg(F.count("*").alias("n"))
    write((counted.join(words, part, "left") if part else counted.crossJoin(words)).fillna(0, ["words"]).coalesce(1), "stats")
    return open_index(spark, key, folder)


def open_index(spark: SparkSession, key: str, folder: str) -> SearchIndex:
    return SearchIndex(key, *[spark.read.parquet(f"{folder}/{name}") for name in _TABLES])


def _weights(idf: DataFrame) -> np.ndarray:
    """Inverse document frequencies, one number a dimension."""
    return np.array([r["idf"] for r in idf.orderBy("place").collect()], np.float32)


def query_vector(index: SearchIndex, query: str) -> np.ndarray:
    """The query's unit vector, weighed with the stored frequencies; zeros if it has no features. A wrong number of them is an error."""
    weights = _weights(index.idf)
    if len(weights) != DIMENSIONS:
        raise ValueError(f"the index has {len(weights)} inverse document frequencies, not {DIMENSIONS}")
    raw = raw_vectors([query])[0] * weights
    return raw / (np.linalg.norm(raw) or 1.0)


def table_sizes(index: SearchIndex) -> DataFrame:
    """Rows of each table of the index."""
    out = None
    for name in _TABLES:
        row = getattr(index, name).agg(F.count("*").alias("rows")).select(F.lit(name).alias("table_name"), "rows")
        out = row if out is None else out.unionByName(row)
    return out


def check_vectors(index: SearchIndex) -> DataFrame:
    """Failures of the vector store: rows without a vector, vectors of a wrong length, of no unit length, or of unknown rows."""
    rows, vectors = index.rows.select(index.key), index.vectors
    norm = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    counted = [
        ("rows-without-vector", rows.join(vectors.select(index.key), index.key, "left_anti")),
        ("vectors-without-row", vectors.select(index.key).join(rows, index.key, "left_anti")),
        ("vector-length", vectors.where(F.size("embedding") != DIMENSIONS)),
        ("vector-norm", vectors.where((norm > 0) & (F.abs(norm - 1) > 1e-4))),
        ("idf-length", index.idf.agg(F.count("*").alias("n")).where(F.col("n") != DIMENSIONS)),
    ]
    out = None
    for name, bad in counted:
        row = bad.agg(F.count("*").alias("failures")).select(F.lit(name).alias("check_name"), "failures")
        out = row if out is None else out.unionByName(row)
    return out
