"""Documents and chunks: records, versions, inventories, integrity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusgraph.functions import markdown, text

CHUNK_COLUMNS = (
    "id document_id logical_id corpus kind title section position product_version source_version is_current source_path normalized_path provenance tags sha256 text".split()
)


def document_records(pages: DataFrame) -> DataFrame:
    """Normalises text and derives ``id``, ``tags`` (sorted, distinct) and ``sha256``; other columns stay."""
    return (
        pages.withColumn("text", markdown.normalize("text"))
        .withColumn("id", F.concat("logical_id", F.lit("@"), "product_version", F.lit("|"), "source_version"))
        .withColumn("tags", F.sort_array(F.array_distinct(F.coalesce("tags", F.array().cast("array<string>")))))
        .withColumn("sha256", F.sha2("text", 256))
    )


def redirect_stubs(pages: DataFrame, least: int = 20) -> DataFrame:
    """Pages with next to no text: a canonical target makes a redirect document, otherwise ``failure`` tells why there is none."""
    bare = F.length(F.trim(F.coalesce("text", F.lit("")))) < least
    target = F.coalesce("source_uri", F.lit(""))
    return (
        pages.withColumn("is_redirect", bare & (target != ""))
        .withColumn("failure", F.when(bare & (target == ""), F.lit("empty-normalized-document-without-target")))
        .withColumn("text", F.when(F.col("is_redirect"), F.concat(F.lit("# "), "title", F.lit("\n\nSee "), "source_uri", F.lit("\n"))).otherwise(F.col("text")))
    )


def chunk_documents(documents: DataFrame) -> DataFrame:
    """Search chunks of documents with dense positions and ids of document, position and content. Documents without text have none."""
    made = documents.where(F.trim(F.coalesce("text", F.lit(""))) != "").withColumn("made", markdown.chunks_of("text", "title"))
    flat = made.select("*", F.posexplode("made").alias("position", "piece"))
    digest = F.sha2(F.col("piece.text"), 256)
    carried = [c for c in CHUNK_COLUMNS if c in documents.columns and c not in ("id", "sha256", "text")]
    out = flat.select(
        F.concat("id", F.lit("#c"), F.lpad(F.col("position").cast("string"), 4, "0"), F.lit("-"), F.substring(digest, 1, 12)).alias("id"),
        F.col("id").alias("document_id"), *carried, F.col("piece.section").alias("section"), "position", digest.alias("sha256"), F.col("piece.text").alias("text"),
    )
    return out.select(*[c for c in CHUNK_COLUMNS if c in out.columns])


def versions(chunks: DataFrame) -> DataFrame:
    """Documents and chunks by version."""
    return chunks.groupBy("corpus", "product_version", "source_version").agg(
        F.max("is_current").alias("is_current"), F.countDistinct("document_id").alias("documents"), F.count("*").alias("chunks")
    )


def document_frequency(rows: DataFrame, key: str, features: Column) -> DataFrame:
    """In how many rows each feature occurs: distinct within the row first, so that nothing is shuffled twice."""
    return rows.select(F.explode(F.array_distinct(features)).alias("feature")).groupBy("feature").agg(F.count("*").alias("df"))


def histogram(rows: DataFrame, column: str) -> DataFrame:
    """Counts by value, in descending order, then by value."""
    return rows.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc_nulls_last(column))


def inventory(files: DataFrame) -> DataFrame:
    """Files and bytes by release, top directory and extension, with all subtotals of extensions and directories."""
    return (
        files.select("product_version", "top_directory", "extension", F.col("bytes").alias("size"))
        .rollup("product_version", "top_directory", "extension")
        .agg(F.count("*").alias("files"), F.sum("size").alias("bytes"), F.grouping_id().cast("int").alias("level"))
    )


def extension_of(path: Column) -> Column:
    name = F.substring_index(path, "/", -1)
    found = F.regexp_extract(name, r"^.+(\.[^.]+)$", 1)
    return F.when(found == "", F.lit("(none)")).otherwise(F.lower(found))


def last_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by ``order``; null keys form keys of their own. Partial aggregation, no window."""
    others = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("last")).select(*keys, "last.*")


def document_digest(chunks: DataFrame) -> DataFrame:
    """Digest over the chunk hashes of each document in order of position: bounded by the document."""
    one = chunks.groupBy("document_id", "position").agg(F.max("sha256").alias("sha256"))
    listed = one.groupBy("document_id").agg(F.sort_array(F.collect_list(F.struct("position", "sha256"))).alias("all"))
    lines = F.transform("all", lambda x: F.concat(x["position"].cast("string"), F.lit(":"), x["sha256"]))
    return listed.select("document_id", F.sha2(F.array_join(lines, "\n"), 256).alias("digest"))


def key_differences(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys that only one side has."""
    a, b = left.select(key).dropna().distinct(), right.select(key).dropna().distinct()
    return a.join(b, key, "left_anti").select(F.lit("missing").alias("side"), key).unionByName(b.join(a, key, "left_anti").select(F.lit("extra").alias("side"), key))


def stale_keys(cached: DataFrame, live: DataFrame, key: str) -> DataFrame:
    """Cached keys that are no longer live."""
    return cached.select(key).distinct().join(live.select(key), key, "left_anti")


def latest_version(rows: DataFrame, key: str, current: str, version: str) -> DataFrame:
    """The version to serve for each key: the current release, else the greatest version as text."""
    rank = F.struct(F.coalesce(F.col(current), F.lit(False)), F.col(version))
    return rows.groupBy(key).agg(F.max_by(version, rank).alias(version))


def validation(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Rows ``check_name, failures``: uniqueness of ids, content hashes, orphans, emptiness. Each table is read once for its own checks."""
    ids = documents.groupBy("id").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum((F.col("n") > 1).cast("int")), F.lit(0)).cast("bigint").alias("failures"))
    chunk_ids = chunks.groupBy("id").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum((F.col("n") > 1).cast("int")), F.lit(0)).cast("bigint").alias("failures"))
    hashes = documents.agg(F.count_if(F.lower("sha256") != F.sha2("text", 256)).alias("failures"))
    chunk_hashes = chunks.agg(F.count_if(F.lower("sha256") != F.sha2("text", 256)).alias("failures"))
    orphan = chunks.join(documents.select(F.col("id").alias("document_id")).distinct(), "document_id", "left_anti").agg(F.count("*").alias("failures"))
    empty = documents.agg(F.count_if(F.coalesce(F.trim("text"), F.lit("")) == "").alias("failures"))
    named = {"unique-document-ids": ids, "unique-chunk-ids": chunk_ids, "document-hashes": hashes, "chunk-hashes": chunk_hashes, "orphan-chunks": orphan, "empty-documents": empty}
    out = None
    for name, df in named.items():
        row = df.select(F.lit(name).alias("check_name"), "failures")
        out = row if out is None else out.unionByName(row)
    return out


def golden_mismatches(actual: DataFrame, golden: DataFrame, key: str, value: str) -> DataFrame:
    """Fields whose value differs from the expected one, or that one side lacks."""
    a, g = actual.select(key, F.col(value).alias("actual")), golden.select(key, F.col(value).alias("expected"))
    return a.join(g, key, "full_outer").where(~F.col("actual").eqNullSafe(F.col("expected")))


def line_numbers(rows: DataFrame, key: str, column: str = "text") -> DataFrame:
    return rows.select(key, F.posexplode(F.split(column, "\n")).alias("at", "line")).select(key, (F.col("at") + 1).alias("line_no"), "line")


def grep(rows: DataFrame, key: str, needle: str, column: str = "text", ignore_case: bool = True) -> DataFrame:
    """One row a matching line, with its 1-based number and the column of the first hit. Texts without a hit aren't split."""
    fold = F.lower if ignore_case else (lambda c: F.col(c) if isinstance(c, str) else c)
    wanted = needle.lower() if ignore_case else needle
    lines = line_numbers(rows.where(F.contains(fold(column), F.lit(wanted))), key, column)
    return lines.withColumn("column_no", F.instr(fold("line"), wanted)).where("column_no > 0").withColumn("line", text.compact_line("line"))


def read_lines(rows: DataFrame, key: str, start: int, count: int, column: str = "text") -> DataFrame:
    """Lines from ``start`` (1-based) on, how many there are, whether more follow, and the digest of the whole text."""
    lines = F.split(column, "\n")
    return rows.where(F.col(column).isNotNull()).select(
        key, F.array_join(F.slice(lines, start, count), "\n").alias("lines"), F.size(lines).alias("total"), (F.size(lines) > start - 1 + count).alias("truncated"), F.sha2(column, 256).alias("digest")
    )


def tail(rows: DataFrame, key: str, count: int, window: int, column: str = "text") -> DataFrame:
    """The last lines of the text's last ``window`` characters; a window that starts inside the text drops its first, partial line."""
    x = F.substring(column, -window, window)
    whole = F.when(F.length(column) > window, F.regexp_replace(x, r"(?s)^[^\n]*\n", "")).otherwise(F.col(column))
    lines = F.split(whole, "\n")
    return rows.where(F.col(column).isNotNull()).select(key, F.array_join(F.slice(lines, F.greatest(F.lit(1), F.size(lines) - count + 1), F.lit(count)), "\n").alias("lines"))


def neighbours(hits: DataFrame, chunks: DataFrame, reach: int = 1) -> DataFrame:
    """Chunks of the hit's document within ``reach`` positions, ``selected`` marking the hit: an equi-join with a band."""
    h = hits.select(F.col("chunk_no").alias("hit"), "document_id", F.col("position").alias("at"))
    near = chunks.select("chunk_no", "document_id", "position")
    return h.join(near, "document_id").where(F.abs(F.col("position") - F.col("at")) <= reach).select("hit", "document_id", "position", "chunk_no", (F.col("chunk_no") == F.col("hit")).alias("selected"))


def page(rows: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    """A page under a total order with ``total`` and ``has_more``; the total comes from a cheap second pass."""
    if offset < 0 or not 1 <= limit <= 100:
        raise ValueError("offset must be at least 0 and limit between 1 and 100")
    total = rows.agg(F.count("*").alias("total"))
    return rows.orderBy(*order).offset(offset).limit(limit).crossJoin(total).withColumn("has_more", F.col("total") > offset + limit)


def byte_budget(rows: DataFrame, order: list[Column], limit: int, budget: int) -> DataFrame:
    """The first ``limit`` rows under the order, as far as their JSON fits the budget; nothing follows the first that doesn't."""
    top = rows.orderBy(*order).limit(limit)
    size = F.octet_length(F.to_json(F.struct("*")))
    return top.withColumn("used", F.sum(size).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))).where(F.col("used") <= budget)


def first_wins(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """Distinct values of each key in the order of their first appearance: ``(key, values)``. A list is bounded by what is distinct in its key."""
    firsts = rows.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.min(order).alias("first"))
    lists = firsts.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("first", value))).alias("x"))
    return lists.select(key, F.transform("x", lambda v: v[value]).alias("values"))


def set_json(values: str) -> Column:
    """An array as a set: the distinct values in order, as JSON text; null for a null one."""
    return F.to_json(F.sort_array(F.array_distinct(values)))


def inventory_hash(documents: DataFrame, files: DataFrame) -> DataFrame:
    """Adds the hash that the inventory of the document's release has for its source file: the one loaded last, hashes in lower case. Null without one."""
    digest = F.lower("sha256")
    known = (
        files.where(F.col("sha256").isNotNull())
        .groupBy(F.col("path").alias("source_path"), "product_version")
        .agg(F.max(F.struct(F.col("loaded_at"), digest.alias("sha256"))).alias("last"))
        .select("source_path", "product_version", F.col("last.sha256").alias("sha256"))
    )
    return documents.drop("sha256").join(known, ["source_path", "product_version"], "left")
