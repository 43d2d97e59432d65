"""Retrieval from a stored index: lexical ranking, vectors, fusion, results."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusgraph.functions import text
from corpusgraph.operators.index import SearchIndex, bucket_of, query_vector
from corpusgraph.plans.joins import BROADCAST_ROWS

#: Fixed values of the ranking: BM25, fusion, and the columns of a result.
K1, B = 1.2, 0.75
FUSION, LEXICAL_SHARE, VECTOR_SHARE = 50, 2.0, 0.65
RESULT = "id document_id logical_id corpus title section kind product_version source_version source_path normalized_path provenance score vector_score snippet".split()
MOST_RESULTS = 20


def query_words(query: str) -> list[str]:
    """The index words of a query's terms, each once."""
    folded = [t.translate(str.maketrans(*text._unaccented())) for t in text.query_terms(query)]
    return list(dict.fromkeys(w for t in folded for w in re.findall(r"[^\W_]+", t)))


def top(hits: DataFrame, k: int, order: list[Column], scope: list[str], rank: str) -> DataFrame:
    """The first ``k`` rows of each scope with their rank: every task keeps its own first ``k`` before rows are brought together."""
    if not scope:
        hits = hits.orderBy(*order).limit(k)  # at most k rows are numbered in one task
    return hits.withColumn(rank, F.row_number().over(Window.partitionBy(*scope).orderBy(*order))).where(F.col(rank) <= k)


def bm25(index: SearchIndex, query: str, limit: int, where: Column | None = None, scope: tuple[str, ...] = ()) -> DataFrame:
    """The best rows ``(key, score, lexical_rank)`` for a query by BM25 over weighted fields; ties by key.

    A row matches if any term occurs. Statistics cover the whole index, or each value of ``scope`` (none, or the corpus), and filters
    come after them. Only the postings of the query's terms are read.
    """
    terms = query_words(query)
    folders = bucket_of(F.col("term"))
    known = index.postings.sparkSession.createDataFrame([(t,) for t in terms], "term string").select("term", folders.alias("bucket"))
    wanted = sorted({r["bucket"] for r in known.collect()})  # at most one a term of the query
    hits = index.postings.where(F.col("bucket").isin(wanted) & F.col("term").isin(terms))
    frequency = hits.groupBy(*scope, "term").agg(F.count("*").alias("df"))
    stats = index.stats.groupBy(*scope).agg(F.sum("n").alias("n"), F.sum("words").alias("all_words"))
    told = frequency.join(stats, list(scope)) if scope else frequency.crossJoin(stats)
    idf = F.greatest(F.ln((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    told = told.select(*scope, "term", idf.alias("idf"), (F.col("all_words") / F.col("n")).alias("mean"))
    kept = hits if where is None else hits.where(where)
    scored = kept.join(F.broadcast(told), [*scope, "term"])  # a row for each term of the query and corpus
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    sums = scored.groupBy(*scope, index.key).agg(F.round(F.sum(part), 6).alias("score"))
    return top(sums, limit, [F.desc("score"), F.col(index.key)], list(scope), "lexical_rank")


def cosine_to(vector: Column, query: np.ndarray) -> Column:
    """Dot product with a query vector, a matrix product for each Arrow batch."""
    q = np.asarray(query, np.float64)

    @F.pandas_udf("double")
    def dot(vectors: pd.Series) -> pd.Series:
        return pd.Series(np.stack(vectors.to_list()).astype(np.float64) @ q if len(vectors) else np.zeros(0))

    return dot(vector)


def vector_search(index: SearchIndex, query: str, limit: int, scope: tuple[str, ...] = ()) -> DataFrame:
    """The rows nearest to the query's vector ``(key, score, vector_rank)`` and facets: none for a query without features."""
    vector = query_vector(index, query)
    near = index.vectors.select(index.key, *index.facets, F.round(cosine_to(F.col("embedding"), vector), 6).alias("score"))
    return top(near if vector.any() else near.limit(0), limit, [F.desc("score"), F.col(index.key)], list(scope), "vector_rank")


def fuse(lexical: DataFrame, vector: DataFrame, keys: list[str]) -> DataFrame:
    """Reciprocal rank fusion of two ranked lists: ``(keys, score, vector_score)``; a side that lacks a row adds nothing."""
    both = lexical.select(*keys, "lexical_rank").join(vector.select(*keys, "vector_rank", F.col("score").alias("vector_score")), keys, "full_outer")
    part = lambda share, rank: F.coalesce(F.lit(share) / (F.lit(FUSION) + F.col(rank)), F.lit(0.0))
    return both.select(*keys, F.round(part(LEXICAL_SHARE, "lexical_rank") + part(VECTOR_SHARE, "vector_rank"), 8).alias("score"), "vector_score")


def hybrid(index: SearchIndex, query: str, limit: int, where: Column | None = None, scope: tuple[str, ...] = ()) -> DataFrame:
    """The best rows by both rankings ``(scope, key, score, vector_score)``. ``where`` filters facets: the lexical side before its list
    is cut, the vector side after. Ties go to the greater key."""
    pool = max(8 * limit, 50)
    keys = [*scope, index.key]
    vector = vector_search(index, query, pool, scope)
    fused = fuse(bm25(index, query, pool, where, scope), vector if where is None else vector.where(where), keys)
    return top(fused, limit, [F.desc("score"), F.desc(index.key)], list(scope), "place")


def results(index: SearchIndex, hits: DataFrame, limit: int = MOST_RESULTS) -> DataFrame:
    """Result rows of at most ``limit`` hits (a limit of the response): what is known of the chunk, scores and a snippet."""
    found = hits.limit(limit).toPandas()  # at most the limit
    spark = hits.sparkSession
    keys = found[index.key].tolist()
    asked = spark.createDataFrame([(k, float(s), None if pd.isna(v) else float(v)) for k, s, v in zip(keys, found["score"], found["vector_score"])], f"`{index.key}` {dict(hits.dtypes)[index.key]}, score double, vector_score double")
    folders = sorted({r["b"] for r in asked.select(bucket_of(F.col(index.key)).alias("b")).collect()})
    rows = index.rows.where(F.col("bucket").isin(folders) & F.col(index.key).isin(keys)) if keys else index.rows.limit(0)
    joined = rows.join(F.broadcast(asked), index.key).withColumn("snippet", text.snippet("text"))
    return joined.select(index.key, *[c for c in RESULT if c in joined.columns])


def search(index: SearchIndex, query: str, limit: int = 8, where: Column | None = None, corpora: bool = False) -> DataFrame:
    """Result rows for a query, over the whole index or, with ``corpora``, ranked in each corpus and merged.

    Each corpus gives at least eight rows to the merged list, which goes by score, then vector score (none or zero counts as -1), then the
    corpora's names, then the greater key.
    """
    if len(query.strip()) < 2:
        raise ValueError("a query needs two characters")
    if not 1 <= limit <= MOST_RESULTS:
        raise ValueError(f"limit must be between 1 and {MOST_RESULTS}")
    if not corpora:
        return results(index, hybrid(index, query, limit, where), limit)
    each = hybrid(index, query, max(limit, 8), where, ("corpus",))
    second = F.when(F.coalesce("vector_score", F.lit(0.0)) == 0, -1.0).otherwise(F.col("vector_score"))
    return results(index, each.orderBy(F.desc("score"), second.desc(), "corpus", F.desc(index.key)).limit(limit), limit)


def nearest(rows: DataFrame, queries: DataFrame, key: str, vector: str, k: int, block: int = 1024) -> DataFrame:
    """The ``k`` rows nearest to each query by dot product: ``(query, neighbour, score, rank)``, exact, ties by key.

    The queries are packed into blocks of ``block`` vectors of one length, the rows into batches; each pair of block and batch is one matrix product,
    of which only ``k`` rows a query leave the task. Blocks of few queries are broadcast. A row isn't its own neighbour. Null vectors are
    left out; only vectors of the same length are neighbours.
    """

    def packed(df: DataFrame, name: str) -> DataFrame:
        sized = df.where(F.col(vector).isNotNull()).select(key, F.col(vector).cast("array<double>").alias("v"), F.size(vector).alias("wide"))
        count = sized.agg(F.count("*").alias("n"))
        number = F.pmod(F.xxhash64(key), F.greatest(F.lit(1), F.ceil(F.col("n") / block)))
        return sized.crossJoin(F.broadcast(count)).groupBy("wide", number.alias(name)).agg(F.collect_list(key).alias(f"{name}_ids"), F.flatten(F.collect_list("v")).alias(f"{name}_vectors"))

    def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                left, right = np.asarray(row.q_ids), np.asarray(row.r_ids)
                scores = np.round(np.asarray(row.q_vectors).reshape(len(left), -1) @ np.asarray(row.r_vectors).reshape(len(right), -1).T, 6)
                scores[left[:, None] == right] = -np.inf
                least = np.partition(scores, -k, axis=1)[:, -k] if len(right) > k else np.full(len(left), -np.inf)
                q, r = np.nonzero((scores >= least[:, None]) & np.isfinite(scores))
                order = np.lexsort((right[r], -scores[q, r], q))
                q, r = q[order], r[order]
                rank = np.arange(len(q)) - np.searchsorted(q, q)
                q, r = q[rank < k], r[rank < k]
                yield pd.DataFrame({"query": left[q], "neighbour": right[r], "score": scores[q, r]})

    asked = packed(queries, "q")
    few = queries.count() <= BROADCAST_ROWS // 10
    pairs = packed(rows, "r").join(F.broadcast(asked) if few else asked, "wide")  # blocks of the stated queries against blocks of rows
    partial = pairs.mapInPandas(products, "query bigint, neighbour bigint, score double")
    best = partial.groupBy("query").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "neighbour"))), 1, k).alias("top"))
    return best.select("query", F.posexplode("top").alias("at", "x")).select("query", F.col("x.neighbour").alias("neighbour"), (-F.col("x.s")).alias("score"), (F.col("at") + 1).alias("rank"))


def merge_corpora(parts: list[DataFrame], key: str, limit: int) -> DataFrame:
    """Hits of several indexes in one list; ties stay in the indexes' order. A missing or zero vector score counts as -1."""
    tagged = [df.withColumn("corpus_order", F.lit(i)) for i, df in enumerate(parts)]
    out = reduce(DataFrame.unionByName, tagged)
    second = F.when(F.coalesce("vector_score", F.lit(0.0)) == 0, -1.0).otherwise(F.col("vector_score"))
    return out.orderBy(F.desc("score"), second.desc(), "corpus_order", F.desc(key)).limit(limit)


def context_terms(name: str, kind: str | None, extra: dict[str, list[str]], most: int = 500) -> str:
    """Query of a symbol's context: its name, then what its kind stands for, each word once, at most ``most`` characters."""
    return " ".join(dict.fromkeys([name, *extra.get(kind or "", [])]))[:most]
