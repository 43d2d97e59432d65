"""Registered queries of text functions, sources and sinks over the given tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusgraph.functions import text
from corpusgraph.operators import corpus, diagnostics
from corpusgraph.plans.lineage import scratch
from corpusgraph.sources import files as sources
from corpusgraph.sources import sinks
from corpusgraph.sources.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return register


# text


@query("SELECT doc_id, 'doc:' || left(sha256(logical_id || chr(0) || product_version || chr(0) || coalesce(lang, '')), 20) AS stable_id FROM documents")
def stable_ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.stable_id("doc", "logical_id", "product_version", "lang").alias("stable_id"))


@query(r"SELECT DISTINCT product_version, list_transform(regexp_extract_all(product_version, '\d+'), lambda n: n::INT) AS version_key FROM files")
def version_keys(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "files").select("product_version", text.version_key("product_version").alias("version_key")).distinct()


@query("SELECT doc_id, epoch_us(loaded_at - INTERVAL 2 HOUR) AS micros, NULL::BIGINT AS without_zone FROM documents")
def instants(spark: SparkSession, d: str) -> DataFrame:
    """Times of loading, written with a zone and read again; without a zone there is no instant."""
    written = F.date_format("loaded_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    micros = lambda x: F.unix_micros(text.instant(x))
    return table(spark, d, "documents").select("doc_id", micros(F.concat(written, F.lit("+02:00"))).alias("micros"), micros(written).alias("without_zone"))


@query(r"SELECT DISTINCT title, regexp_replace(list_last(string_split_regex(string_split(title, ' ')[1], '::|\.')), '[?\[\]<>]+$', '') AS last_name FROM documents WHERE title IS NOT NULL")
def last_names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("title IS NOT NULL").select("title", text.last_name(F.substring_index("title", " ", 1)).alias("last_name")).distinct()


@query("SELECT DISTINCT path, regexp_replace(rtrim('/' || coalesce(top_directory, '') || '//', '/') || '/' || path, '/{2,}', '/', 'g') AS route FROM files")
def joined_routes(spark: SparkSession, d: str) -> DataFrame:
    root = F.concat(F.lit("/"), F.coalesce("top_directory", F.lit("")), F.lit("//"))
    return table(spark, d, "files").select("path", text.join_route(root, "path").alias("route")).distinct()


@query(r"SELECT chunk_no, 12 + length(regexp_replace(left(text, 12), '[^\x{10000}-\x{10FFFF}]', '', 'g'))::INT AS utf16 FROM chunks WHERE length(text) >= 12")
def utf16_offsets(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").where(F.length("text") >= 12).select("chunk_no", text.utf16_offset("text", F.lit(13)).alias("utf16"))


_SECRETS = rf"""regexp_replace(regexp_replace(text, '(?i)\b({text.SCHEMES})\s+{text.TOKEN68}', '\1 {text.HIDDEN}', 'g'), '(?i)({text.SECRET_NAMES})(\s*[:=]\s*)([^\s,;]+)', '\1\2{text.HIDDEN}', 'g')"""


@query(f"SELECT chunk_no, sha256({_SECRETS}) AS digest FROM chunks")
def redacted_text(spark: SparkSession, d: str) -> DataFrame:
    """The given texts have no mail addresses and no user ids; fixtures test those."""
    return table(spark, d, "chunks").select("chunk_no", F.sha2(text.redact("text"), 256).alias("digest"))


@query(
    rf"""SELECT doc_id, sha256(left(regexp_replace(regexp_replace(regexp_replace(text, '(?i)(authorization\s*[:=]\s*)\S+(\s+\S+)?', '\1{text.HIDDEN}', 'g'),
'(?i)({text.SECRET_NAMES}|token|secret)(\s*[:=]\s*)([^\s,;]+)', '\1\2{text.HIDDEN}', 'g'), '\beyJ[\w-]+\.[\w-]+\.[\w-]+', '{text.HIDDEN}', 'g'), 2000)) AS digest FROM documents"""
)
def external_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.sha2(text.redact_external("text"), 256).alias("digest"))


# corpus


@query("SELECT document_id, list(section ORDER BY first, section) AS sections FROM (SELECT document_id, section, min(position) AS first FROM chunks WHERE section IS NOT NULL GROUP BY ALL) GROUP BY document_id")
def document_sections(spark: SparkSession, d: str) -> DataFrame:
    return corpus.first_wins(table(spark, d, "chunks"), "document_id", "section", "position").select("document_id", F.col("values").alias("sections"))


@query("SELECT doc_id, to_json(list_sort(list_distinct(tags)))::VARCHAR AS tags FROM documents")
def tag_sets(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", corpus.set_json("tags").alias("tags"))


@query(
    """SELECT doc_id, f.sha256 FROM documents d LEFT JOIN (SELECT path, product_version, arg_max(lower(sha256), (loaded_at, coalesce(lower(sha256), ''))) AS sha256 FROM files WHERE sha256 IS NOT NULL GROUP BY ALL) f
ON f.path = d.source_path AND f.product_version = d.product_version"""
)
def source_hashes(spark: SparkSession, d: str) -> DataFrame:
    """Each document with the hash of the file it came from, as the inventory of its release had it last."""
    return corpus.inventory_hash(table(spark, d, "documents"), table(spark, d, "files")).select("doc_id", "sha256")


@query("SELECT product_version, count(*) AS documents, sum(length(text))::BIGINT AS characters FROM documents GROUP BY product_version")
def published_documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents published by release, read from the active version."""
    target = scratch(spark, "published")
    sinks.publish(spark, {"documents": table(spark, d, "documents")}, target)
    stored = spark.read.parquet(f"{sinks.active(spark, target)}/documents.parquet")
    return stored.groupBy("product_version").agg(F.count("*").alias("documents"), F.sum(F.length("text")).alias("characters"))


@query("SELECT doc_id, title, lang, sha256(text) AS digest FROM documents")
def documents_as_json_lines(spark: SparkSession, d: str) -> DataFrame:
    """Written as JSON lines and read again, strictly."""
    target = scratch(spark, "json-lines")
    sinks.write_json_lines(table(spark, d, "documents").select("doc_id", "title", "lang", "text"), target)
    read = sources.json_lines(spark, target, "doc_id bigint, title string, lang string, text string", strict=True)
    return read.select("doc_id", "title", "lang", F.sha2("text", 256).alias("digest"))


@query("SELECT doc_id, sha256('---' || chr(10) || 'logical_id: ' || to_json(logical_id) || chr(10) || 'kind: ' || to_json(kind) || chr(10) || '---' || chr(10) || chr(10) || text) AS digest FROM documents")
def documents_with_front_matter(spark: SparkSession, d: str) -> DataFrame:
    files = sinks.markdown_with_front_matter(table(spark, d, "documents"), ["logical_id", "kind"])
    return files.select("doc_id", F.sha2("file", 256).alias("digest"))


@query("SELECT 'all.1.' || name AS id, name, records FROM (SELECT 'documents' AS name, count(*) AS records FROM documents UNION ALL SELECT 'chunks', count(*) FROM chunks UNION ALL SELECT 'files', count(*) FROM files)")
def dataset_catalog(spark: SparkSession, d: str) -> DataFrame:
    known = {name: table(spark, d, name) for name in ("documents", "chunks", "files")}
    return sinks.catalog_of(spark, known, "all", "1").select("id", "name", "records")


# lists and properties


@query("SELECT event_id, event_type AS event_kind, value::VARCHAR AS amount_value, NULL::VARCHAR AS status FROM (SELECT event_id, event_type, round(value, 2)::DECIMAL(18, 2) AS value FROM events)")
def aliased_events(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select(F.col("event_id").alias("eventId"), F.col("event_type").alias("event-kind"), F.round("value", 2).cast("decimal(18,2)").cast("string").alias("amountValue"), F.lit(1).alias("hidden"))
    return diagnostics.aliased(rows, ["event_id", "event_kind", "amount_value", "status"])


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, '[HIDDEN]' AS token FROM events")
def event_properties(spark: SparkSession, d: str) -> DataFrame:
    """Properties of events beside a sensitive one, hidden by its name."""
    properties = F.map_concat(F.from_json("props", "map<string,string>"), F.create_map(F.lit("access_token"), F.col("user_id").cast("string")))
    shown = table(spark, d, "events").select("event_id", diagnostics.redact_properties(properties).alias("p"))
    return shown.select("event_id", F.col("p")["k"].alias("k"), F.col("p")["access_token"].alias("token"))
