"""Registered queries of problems 3 and 4 and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusgraph.operators import orphans, snapshots
from corpusgraph.sources.tables import table


def _references(spark: SparkSession, folder: str) -> list[orphans.Reference]:
    return orphans.corpus_references(*[table(spark, folder, t) for t in ("documents", "chunks", "links", "files")])


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return orphans.find_orphans(_references(spark, folder))


def p3_report(spark: SparkSession, folder: str) -> DataFrame:
    return orphans.orphan_report(_references(spark, folder))


def _changes(spark: SparkSession, folder: str) -> DataFrame:
    return snapshots.corpus_changes(*[table(spark, folder, t) for t in ("documents", "files", "releases")])


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return _changes(spark, folder)


def p4_counts(spark: SparkSession, folder: str) -> DataFrame:
    return snapshots.change_counts(_changes(spark, folder))


QUERIES = {"p3_found": p3_found, "p3_report": p3_report, "p4_found": p4_found, "p4_counts": p4_counts}

_P3 = """
WITH r AS (
  SELECT 'documents' AS table_name, d.loaded_at, d.doc_id AS record_no,
         (SELECT min(f.loaded_at) FROM files f WHERE f.path = d.source_path AND f.product_version = d.product_version) AS since
  FROM documents d WHERE d.source_path <> ''
  UNION ALL
  SELECT 'chunks', c.loaded_at, c.chunk_no, (SELECT min(d.loaded_at) FROM documents d WHERE d.id = c.document_id)
  FROM chunks c WHERE c.document_id IS NOT NULL
  UNION ALL
  SELECT 'links', l.loaded_at, l.link_no,
         (SELECT min(d.loaded_at) FROM documents d WHERE d.logical_id = l.target_logical_id AND d.product_version = l.product_version)
  FROM links l WHERE l.target_logical_id IS NOT NULL
), o AS (SELECT table_name, strftime(loaded_at, '%Y-%m') AS period, record_no FROM r WHERE since IS NULL OR since > loaded_at)
"""

_P4 = """
WITH steps AS (SELECT product_version, row_number() OVER (ORDER BY released_at, product_version) AS step FROM releases),
rows AS (
  SELECT 'files' AS table_name, path AS record_key, product_version, lower(sha256) AS sha, loaded_at, 0 AS no FROM files
  UNION ALL SELECT 'documents', logical_id, product_version, lower(sha256), loaded_at, doc_id FROM documents
), latest AS (
  SELECT table_name, record_key, step, sha FROM (
    SELECT *, row_number() OVER (PARTITION BY table_name, record_key, product_version ORDER BY loaded_at DESC, no DESC, sha DESC NULLS LAST) AS rn FROM rows
    WHERE record_key IS NOT NULL
  ) JOIN steps USING (product_version) WHERE rn = 1
), changes AS (
  SELECT coalesce(a.table_name, b.table_name) AS table_name, s.product_version, coalesce(a.record_key, b.record_key) AS record_key,
         CASE WHEN b.record_key IS NULL THEN 'added' WHEN a.record_key IS NULL THEN 'removed' ELSE 'changed' END AS change
  FROM latest a FULL JOIN (SELECT table_name, record_key, step + 1 AS step, sha FROM latest) b
    ON a.table_name = b.table_name AND a.record_key = b.record_key AND a.step = b.step
  JOIN steps s ON s.step = coalesce(a.step, b.step)
  WHERE s.step > 1 AND (a.record_key IS NULL OR b.record_key IS NULL OR a.sha IS DISTINCT FROM b.sha)
)
"""

SQL = {
    "p3_found": _P3 + "SELECT table_name, period, record_no FROM o",
    "p3_report": _P3 + "SELECT table_name, period, count(*) AS orphans FROM o GROUP BY ALL",
    "p4_found": _P4 + "SELECT * FROM changes",
    "p4_counts": _P4 + "SELECT table_name, product_version, change, count(*) AS n FROM changes GROUP BY ALL",
}
