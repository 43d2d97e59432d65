"""Registered queries of the corpus, search, dataset, graph and diagnostics operators, with their SQL."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusgraph.functions import text
from corpusgraph.operators import code, corpus, datasets, diagnostics, graph, index, search
from corpusgraph.plans.lineage import shared_dir
from corpusgraph.sources.tables import table
from corpusgraph.streaming import events as streams

QUERIES: dict = {}
SQL: dict[str, str] = {}
_W = r"[\p{L}\p{N}]+"


def _usual(x: str) -> str:
    """SQL of :func:`text.compatible`."""
    pairs = text._compatible()
    return f"replace(replace(translate({x}, '{pairs[0]}', '{pairs[1]}'), 'и\u0306', 'й'), 'е\u0308', 'ё')"


def _words(x: str) -> str:
    """SQL of :func:`text.words`."""
    pairs = text._unaccented()
    return f"regexp_extract_all(translate(lower({_usual(x)}), '{pairs[0]}', '{pairs[1]}'), '{_W}')"


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


# corpus


@query("SELECT corpus, product_version, source_version, bool_or(is_current) AS is_current, count(DISTINCT document_id) AS documents, count(*) AS chunks FROM chunks GROUP BY ALL")
def corpus_versions(spark: SparkSession, d: str) -> DataFrame:
    return corpus.versions(table(spark, d, "chunks"))


@query(rf"SELECT feature, count(*) AS df FROM (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower({_usual('text')}), '{text.TOKEN}'))) AS feature FROM documents) GROUP BY feature")
def token_document_frequency(spark: SparkSession, d: str) -> DataFrame:
    return corpus.document_frequency(table(spark, d, "documents"), "doc_id", text.tokens("text"))


@query(
    rf"""SELECT token, list_filter(regexp_extract_all(token, '{text.PART}'), lambda p: length(p) > 1) AS parts
FROM (SELECT DISTINCT unnest(regexp_extract_all(lower({_usual('title')}), '{text.TOKEN}')) AS token FROM documents)"""
)
def token_parts(spark: SparkSession, d: str) -> DataFrame:
    each = table(spark, d, "documents").select(F.explode(text.tokens("title")).alias("token")).distinct()
    return each.select("token", text.token_parts("token").alias("parts"))


@query(
    r"""SELECT doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\r\n?|[\x{85}\x{2028}\x{2029}]', chr(10), 'g'), '\x{A0}', ' ', 'g'),
'[\x{200B}\x{FEFF}\x{AD}\x00-\x08\x0B-\x1F]', '', 'g'), '(?m)[ \t]+$', '', 'g')) AS digest FROM documents"""
)
def clean_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.sha2(text.clean_characters("text"), 256).alias("digest"))


@query()
def normalized_documents(spark: SparkSession, d: str) -> DataFrame:
    return corpus.document_records(table(spark, d, "documents")).select("doc_id", "id", "tags", "sha256")


@query()
def chunk_documents(spark: SparkSession, d: str) -> DataFrame:
    return corpus.chunk_documents(table(spark, d, "documents")).select("id", "document_id", "section", "position", "sha256")


@query(
    rf"""SELECT doc_id, CASE WHEN s = '' THEN 'document' ELSE s END AS slug FROM (SELECT doc_id,
regexp_replace(regexp_replace(regexp_replace(lower(trim({_usual('title')})), '[^0-9a-zа-яё._/-]+', '-', 'g'), '-+', '-', 'g'), '^-+|-+$', '', 'g') AS s FROM documents)"""
)
def slug_titles(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.slug("title").alias("slug"))


@query(r"SELECT DISTINCT path, CASE WHEN r = '' THEN 'index' ELSE r END AS route FROM (SELECT path, regexp_replace(regexp_replace(path, '(^|/)index\.html$|\.html$', ''), '^/+|/+$', '', 'g') AS r FROM files)")
def routes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "files").select("path", text.route("path").alias("route")).distinct()


@query(
    r"""SELECT chunk_no, CASE WHEN length(x) <= 300 THEN x ELSE rtrim(CASE WHEN b > 0 AND 300 - b >= 150 THEN left(x, 300 - b) ELSE left(x, 300) END) || '…' END AS snippet
FROM (SELECT chunk_no, x, instr(reverse(left(x, 300)), ' ') AS b FROM (SELECT chunk_no, trim(regexp_replace(text, '\s+', ' ', 'g')) AS x FROM chunks))"""
)
def snippets(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").select("chunk_no", text.snippet("text", 300).alias("snippet"))


@query("SELECT extension, count(*) AS n FROM files GROUP BY extension")
def extension_histogram(spark: SparkSession, d: str) -> DataFrame:
    return corpus.histogram(table(spark, d, "files"), "extension")


@query(
    """SELECT product_version, top_directory, extension, count(*) AS files, sum(bytes)::BIGINT AS bytes, grouping(product_version, top_directory, extension)::INT AS level
FROM files GROUP BY ROLLUP (product_version, top_directory, extension)"""
)
def inventory_rollup(spark: SparkSession, d: str) -> DataFrame:
    return corpus.inventory(table(spark, d, "files"))


@query("SELECT id, sha256, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY id, sha256 ORDER BY loaded_at DESC, doc_id DESC) AS rn FROM documents) WHERE rn = 1")
def last_delivered(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("id", "sha256", "loaded_at", "doc_id")
    return corpus.last_wins(docs, ["id", "sha256"], ["loaded_at", "doc_id"]).select("id", "sha256", "doc_id")


@query(
    """SELECT document_id, sha256(string_agg(position || ':' || sha256, chr(10) ORDER BY position)) AS digest
FROM (SELECT document_id, position, max(sha256) AS sha256 FROM chunks GROUP BY ALL) GROUP BY document_id"""
)
def document_digests(spark: SparkSession, d: str) -> DataFrame:
    return corpus.document_digest(table(spark, d, "chunks"))


@query(
    """SELECT 'missing' AS side, logical_id FROM (SELECT logical_id FROM documents EXCEPT SELECT logical_id FROM chunks)
UNION ALL SELECT 'extra', logical_id FROM (SELECT logical_id FROM chunks EXCEPT SELECT logical_id FROM documents)"""
)
def documents_without_chunks(spark: SparkSession, d: str) -> DataFrame:
    return corpus.key_differences(table(spark, d, "documents"), table(spark, d, "chunks"), "logical_id")


@query("SELECT DISTINCT path FROM files WHERE path NOT IN (SELECT path FROM files WHERE product_version IN (SELECT product_version FROM releases WHERE is_current))")
def stale_files(spark: SparkSession, d: str) -> DataFrame:
    files, current = table(spark, d, "files"), table(spark, d, "releases").where("is_current").select("product_version")
    return corpus.stale_keys(files, files.join(current, "product_version", "left_semi"), "path")


@query("SELECT logical_id, arg_max(product_version, (coalesce(is_current, false)::INT)::VARCHAR || product_version) AS product_version FROM documents GROUP BY logical_id")
def served_version(spark: SparkSession, d: str) -> DataFrame:
    return corpus.latest_version(table(spark, d, "documents"), "logical_id", "is_current", "product_version")


@query(
    """SELECT 'unique-document-ids' AS check_name, count(*) AS failures FROM (SELECT id FROM documents GROUP BY id HAVING count(*) > 1)
UNION ALL SELECT 'unique-chunk-ids', count(*) FROM (SELECT id FROM chunks GROUP BY id HAVING count(*) > 1)
UNION ALL SELECT 'document-hashes', count(*) FROM documents WHERE lower(sha256) <> sha256(text)
UNION ALL SELECT 'chunk-hashes', count(*) FROM chunks WHERE lower(sha256) <> sha256(text)
UNION ALL SELECT 'orphan-chunks', count(*) FROM chunks c WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.id = c.document_id)
UNION ALL SELECT 'empty-documents', count(*) FROM documents WHERE coalesce(trim(text), '') = ''"""
)
def validation_report(spark: SparkSession, d: str) -> DataFrame:
    return corpus.validation(table(spark, d, "documents"), table(spark, d, "chunks"))


@query(
    """SELECT chunk_no, i AS line_no, instr(lower(parts[i]), 'deadlocks')::INT AS column_no, parts[i] AS line
FROM (SELECT chunk_no, parts, unnest(range(1, len(parts) + 1))::INT AS i FROM (SELECT chunk_no, string_split(text, chr(10)) AS parts FROM chunks)) WHERE instr(lower(parts[i]), 'deadlocks') > 0 AND length(parts[i]) <= 1200
UNION ALL SELECT chunk_no, i, instr(lower(parts[i]), 'deadlocks')::INT, left(parts[i], 1199) || '…'
FROM (SELECT chunk_no, parts, unnest(range(1, len(parts) + 1))::INT AS i FROM (SELECT chunk_no, string_split(text, chr(10)) AS parts FROM chunks)) WHERE instr(lower(parts[i]), 'deadlocks') > 0 AND length(parts[i]) > 1200"""
)
def line_search(spark: SparkSession, d: str) -> DataFrame:
    return corpus.grep(table(spark, d, "chunks"), "chunk_no", "deadlocks")


@query("SELECT doc_id, array_to_string(p[3:7], chr(10)) AS lines, len(p)::INT AS total, len(p) > 7 AS truncated, sha256(text) AS digest FROM (SELECT doc_id, text, string_split(text, chr(10)) AS p FROM documents WHERE text IS NOT NULL)")
def read_lines(spark: SparkSession, d: str) -> DataFrame:
    return corpus.read_lines(table(spark, d, "documents"), "doc_id", 3, 5)


@query(
    r"""SELECT doc_id, array_to_string(p[greatest(1, len(p) - 4):], chr(10)) AS lines FROM (SELECT doc_id,
string_split(CASE WHEN length(text) > 500 THEN regexp_replace(right(text, 500), '(?s)^[^\n]*\n', '') ELSE text END, chr(10)) AS p FROM documents WHERE text IS NOT NULL)"""
)
def tail_lines(spark: SparkSession, d: str) -> DataFrame:
    return corpus.tail(table(spark, d, "documents"), "doc_id", 5, 500)


# retrieval

_BM25 = rf"""
WITH f AS (SELECT chunk_no, is_current, {_words("coalesce(title, '')")} AS a, {_words("coalesce(section, '')")} AS b,
  {_words("coalesce(array_to_string(tags, ' '), '')")} AS c, {_words("coalesce(text, '')")} AS t FROM chunks),
q AS (SELECT unnest(['deadlocks', 'rollbacks', 'tablespaces']) AS term),
s AS (SELECT chunk_no, is_current, len(a) + len(b) + len(c) + len(t) AS n, term, 5.0::DOUBLE * len(list_filter(a, lambda w: w = term)) + 2.0::DOUBLE * len(list_filter(b, lambda w: w = term))
  + 1.5::DOUBLE * len(list_filter(c, lambda w: w = term)) + 1.0::DOUBLE * len(list_filter(t, lambda w: w = term)) AS tf FROM f, q),
g AS (SELECT count(DISTINCT chunk_no) AS n, avg(n) AS avg FROM s),
df AS (SELECT term, count(*) AS df FROM s WHERE tf > 0 GROUP BY term),
r AS (SELECT chunk_no, round(sum(greatest(ln((g.n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * s.n / g.avg))), 6) AS score
  FROM s JOIN df USING (term), g WHERE tf > 0 __WHERE__ GROUP BY chunk_no)
SELECT chunk_no, score FROM r ORDER BY score DESC, chunk_no LIMIT 20"""
_BM25_CORPUS = (
    _BM25[: _BM25.index("SELECT chunk_no, score FROM r ORDER")]
    .replace("is_current", "corpus")
    .replace("g AS (SELECT count(DISTINCT chunk_no) AS n, avg(n) AS avg FROM s)", "g AS (SELECT corpus, count(DISTINCT chunk_no) AS n, avg(n) AS avg FROM s GROUP BY corpus)")
    .replace("df AS (SELECT term, count(*) AS df FROM s WHERE tf > 0 GROUP BY term)", "df AS (SELECT corpus, term, count(*) AS df FROM s WHERE tf > 0 GROUP BY corpus, term)")
    .replace("r AS (SELECT chunk_no, round", "r AS (SELECT corpus, chunk_no, round")
    .replace("FROM s JOIN df USING (term), g WHERE tf > 0 __WHERE__ GROUP BY chunk_no", "FROM s JOIN df USING (corpus, term) JOIN g USING (corpus) WHERE tf > 0 GROUP BY corpus, chunk_no")
    + "SELECT corpus, chunk_no, score FROM (SELECT *, row_number() OVER (PARTITION BY corpus ORDER BY score DESC, chunk_no) AS rn FROM r) WHERE rn <= 5"
)
_INDEXES: dict[tuple, index.SearchIndex] = {}


def stored_index(spark: SparkSession, d: str) -> index.SearchIndex:
    """The index of a folder's chunks, in the session's shared folder: built by the first search that needs it, and again for other files."""
    chunks = table(spark, d, "chunks")
    known = (spark.sparkContext.applicationId, d, *sorted(tuple(r) for r in chunks.select("_metadata.file_path", "_metadata.file_size", F.col("_metadata.file_modification_time").cast("string")).distinct().collect()))
    if known not in _INDEXES:
        _INDEXES[known] = index.build_index(chunks, "chunk_no", f"{shared_dir(spark)}/index-{uuid.uuid4().hex}")
    return _INDEXES[known]


ASKED = "deadlocks rollbacks tablespaces"


@query(_BM25.replace("__WHERE__", ""))
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return search.bm25(stored_index(spark, d), ASKED, 20).select("chunk_no", "score")


@query(_BM25.replace("__WHERE__", "AND is_current"))
def bm25_current(spark: SparkSession, d: str) -> DataFrame:
    return search.bm25(stored_index(spark, d), ASKED, 20, where=F.col("is_current")).select("chunk_no", "score")


@query(_BM25_CORPUS)
def bm25_by_corpus(spark: SparkSession, d: str) -> DataFrame:
    """The best five of each corpus, by its own statistics."""
    return search.bm25(stored_index(spark, d), ASKED, 5, scope=("corpus",)).select("corpus", "chunk_no", "score")


@query(
    f"""SELECT term, count(*) AS rows, sum(words)::BIGINT AS words FROM (SELECT chunk_no, term, count(*) AS words FROM (SELECT chunk_no, unnest(list_concat({_words("coalesce(title, '')")},
{_words("coalesce(section, '')")}, {_words("coalesce(array_to_string(tags, ' '), '')")}, {_words("coalesce(text, '')")})) AS term FROM chunks) GROUP BY ALL) GROUP BY term"""
)
def index_terms(spark: SparkSession, d: str) -> DataFrame:
    """Document frequency and words of every term of the stored index."""
    return stored_index(spark, d).postings.groupBy("term").agg(F.count("*").alias("rows"), F.sum("words").alias("words"))


@query(
    f"""SELECT unnest(['rows', 'vectors', 'idf', 'stats', 'postings']) AS table_name, unnest([(SELECT count(*) FROM chunks), (SELECT count(*) FROM chunks), 384, (SELECT count(DISTINCT corpus) FROM chunks),
(SELECT count(DISTINCT (chunk_no, term)) FROM (SELECT chunk_no, unnest(list_concat({_words("coalesce(title, '')")}, {_words("coalesce(section, '')")}, {_words("coalesce(array_to_string(tags, ' '), '')")},
{_words("coalesce(text, '')")})) AS term FROM chunks))]) AS rows"""
)
def index_build(spark: SparkSession, d: str) -> DataFrame:
    """Builds the index anew and counts its rows."""
    return index.table_sizes(index.build_index(table(spark, d, "chunks"), "chunk_no", f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"))


@query("SELECT unnest(['rows-without-vector', 'vectors-without-row', 'vector-length', 'vector-norm', 'idf-length']) AS check_name, 0::BIGINT AS failures")
def index_checks(spark: SparkSession, d: str) -> DataFrame:
    return index.check_vectors(stored_index(spark, d))


@query(
    """SELECT query, neighbour, score, rank FROM (SELECT q.vec_id AS query, r.vec_id AS neighbour, round(list_dot_product(q.embedding::DOUBLE[], r.embedding::DOUBLE[]), 6) AS score,
row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_dot_product(q.embedding::DOUBLE[], r.embedding::DOUBLE[]), 6) DESC, r.vec_id)::INT AS rank
FROM embeddings q, embeddings r WHERE q.vec_id % 20 = 0 AND q.vec_id <> r.vec_id) WHERE rank <= 10"""
)
def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings")
    return search.nearest(rows, rows.where("vec_id % 20 = 0"), "vec_id", "embedding", 10)


@query()
def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    """Result rows by lexical and vector ranks over the current release, fused; the vector side is filtered after its top list."""
    return search.search(stored_index(spark, d), ASKED, 20, where=F.col("is_current"))


@query()
def corpora_search(spark: SparkSession, d: str) -> DataFrame:
    """Result rows ranked in each corpus and merged."""
    return search.search(stored_index(spark, d), ASKED, 20, where=F.col("is_current"), corpora=True)


@query(
    """SELECT h.chunk_no AS hit, h.document_id, c.position, c.chunk_no, c.chunk_no = h.chunk_no AS selected FROM chunks h JOIN chunks c ON c.document_id = h.document_id
AND abs(c.position - h.position) <= 1 WHERE h.chunk_no % 20 = 0"""
)
def chunk_context(spark: SparkSession, d: str) -> DataFrame:
    chunks = table(spark, d, "chunks")
    return corpus.neighbours(chunks.where("chunk_no % 20 = 0"), chunks, 1)


# datasets


@query("SELECT event_id FROM events WHERE json_extract_string(props, '$.k') = '7'")
def exact_filter(spark: SparkSession, d: str) -> DataFrame:
    return datasets.query(table(spark, d, "events"), "props", filters={"k": "7"}).select("event_id")


@query("SELECT event_id FROM events WHERE contains(json_extract_string(props, '$.k'), '9')")
def leaf_search(spark: SparkSession, d: str) -> DataFrame:
    return datasets.query(table(spark, d, "events"), "props", search="9").select("event_id")


@query("SELECT c_custkey, c_name, (SELECT count(*) FROM customer WHERE c_mktsegment = 'BUILDING') AS total, (SELECT count(*) FROM customer WHERE c_mktsegment = 'BUILDING') > 60 AS has_more FROM customer WHERE c_mktsegment = 'BUILDING' ORDER BY c_acctbal DESC, c_custkey LIMIT 20 OFFSET 40")
def dataset_page(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'")
    return corpus.page(rows, [F.desc("c_acctbal"), F.col("c_custkey")], 40, 20).select("c_custkey", "c_name", "total", "has_more")


@query(
    """SELECT p_partkey, used FROM (SELECT p_partkey, sum(length(encode(p_name)) + 0) OVER (ORDER BY p_partkey) AS used FROM (SELECT * FROM part ORDER BY p_partkey LIMIT 100)) WHERE used <= 1000"""
    .replace("length(encode(p_name)) + 0", "octet_length(encode('{\"p_partkey\":' || p_partkey || ',\"p_name\":\"' || p_name || '\"}'))")
)
def dataset_byte_budget(spark: SparkSession, d: str) -> DataFrame:
    return corpus.byte_budget(table(spark, d, "part").select("p_partkey", "p_name"), [F.col("p_partkey")], 100, 1000).select("p_partkey", "used")


@query(
    """SELECT o_orderkey, list(p_name ORDER BY l_linenumber, l_partkey) AS names FROM
(SELECT o_orderkey, l_linenumber, l_partkey, p_name FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey) GROUP BY o_orderkey"""
)
def ordered_lookup(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("x"))
    orders = table(spark, d, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", F.transform("x", lambda p: p["l_partkey"]).alias("parts"))
    found = datasets.ordered_lookup(orders, "o_orderkey", "parts", table(spark, d, "part"), "p_partkey", ["p_name"])
    return found.where(F.size("matches") > 0).select("o_orderkey", F.transform("matches", lambda m: m["p_name"]).alias("names"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey = 42")
def unique_fetch(spark: SparkSession, d: str) -> DataFrame:
    return datasets.one(table(spark, d, "customer"), F.col("c_custkey") == 42).select("c_custkey", "c_name")


@query("SELECT DISTINCT link_no FROM links WHERE target_logical_id LIKE '%-103%' AND right(target_logical_id, 5) IN ('-1034', '-1037') OR document_id LIKE '%-4.8'")
def component_connections(spark: SparkSession, d: str) -> DataFrame:
    links = table(spark, d, "links")
    asked = [("1034", "target_logical_id"), ("1037", "target_logical_id"), ("4.8", "document_id")]
    found = [datasets.connections(links, component, [column]).select("link_no") for component, column in asked]
    return found[0].unionByName(found[1]).unionByName(found[2]).distinct()


# graph

_EDGES = """
WITH RECURSIVE e AS (SELECT DISTINCT l.product_version, s.logical_id AS source, l.target_logical_id AS target FROM links l
  JOIN (SELECT DISTINCT id, logical_id FROM documents) s ON s.id = l.document_id
  WHERE EXISTS (SELECT 1 FROM documents t WHERE t.logical_id = l.target_logical_id AND t.product_version = l.product_version) AND s.logical_id <> l.target_logical_id),
a AS (SELECT DISTINCT source, target FROM e)"""


def _edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.release_edges(table(spark, d, "links"), table(spark, d, "documents"))


@query(_EDGES + " SELECT * FROM e")
def link_graph(spark: SparkSession, d: str) -> DataFrame:
    return _edges(spark, d)


@query(_EDGES + " SELECT DISTINCT target, source FROM e")
def reverse_links(spark: SparkSession, d: str) -> DataFrame:
    return graph.reverse_index(_edges(spark, d))


@query(_EDGES + " SELECT target, count(DISTINCT source) AS inbound FROM e GROUP BY target")
def inbound_links(spark: SparkSession, d: str) -> DataFrame:
    return graph.in_degrees(_edges(spark, d))


@query(
    _EDGES
    + """, w AS (SELECT DISTINCT source AS node, 0 AS level FROM a WHERE source LIKE 'server/%'
UNION SELECT a.target, w.level + 1 FROM w JOIN a ON a.source = w.node WHERE w.level < 3) SELECT node, min(level) AS level FROM w GROUP BY node"""
)
def link_neighbours(spark: SparkSession, d: str) -> DataFrame:
    edges = _edges(spark, d)
    return graph.walk(edges, edges.where("source LIKE 'server/%'").select(F.col("source").alias("node")), 3).select("node", "level")


@query(
    _EDGES
    + """, c AS (SELECT DISTINCT logical_id FROM documents WHERE NOT is_current AND corpus = 'mobile'), w AS (SELECT logical_id AS node, 0 AS level FROM c
UNION SELECT a.source, w.level + 1 FROM w JOIN a ON a.target = w.node WHERE w.level < 2) SELECT node, min(level) AS level FROM w GROUP BY node HAVING min(level) > 0"""
)
def change_impact(spark: SparkSession, d: str) -> DataFrame:
    changed = table(spark, d, "documents").where("NOT is_current AND corpus = 'mobile'").select(F.col("logical_id").alias("node"))
    return graph.impact(_edges(spark, d), changed, 2)


@query(_EDGES + " SELECT DISTINCT logical_id AS node FROM documents WHERE logical_id NOT IN (SELECT target FROM e)")
def unlinked_documents(spark: SparkSession, d: str) -> DataFrame:
    return graph.without_inbound(table(spark, d, "documents").select(F.col("logical_id").alias("node")), _edges(spark, d))


@query(
    _EDGES
    + """, w AS (SELECT source AS root, target AS node FROM a UNION SELECT w.root, a.target FROM w JOIN a ON a.source = w.node),
c AS (SELECT x.root AS node, least(x.root, min(x.node)) AS component FROM w x JOIN w y ON x.root = y.node AND x.node = y.root GROUP BY x.root)
SELECT node, component, count(*) OVER (PARTITION BY component) AS members FROM c"""
)
def link_cycles(spark: SparkSession, d: str) -> DataFrame:
    return graph.cycle_members(_edges(spark, d))


@query(
    """SELECT link_no, n AS matches, CASE n WHEN 0 THEN 'not_found' WHEN 1 THEN 'exact' ELSE 'ambiguous' END AS resolution, CASE WHEN n = 1 THEN t END AS target FROM
(SELECT l.link_no, count(DISTINCT d.logical_id) AS n, min(d.logical_id) AS t FROM (SELECT DISTINCT link_no, anchor, product_version FROM links WHERE anchor IS NOT NULL) l
LEFT JOIN documents d ON d.product_version = l.product_version AND lower(split_part(d.title, ' ', 1)) = lower(l.anchor) GROUP BY l.link_no)"""
)
def anchor_resolution(spark: SparkSession, d: str) -> DataFrame:
    named = table(spark, d, "documents").select("product_version", "logical_id", F.substring_index("title", " ", 1).alias("anchor"))
    asked = table(spark, d, "links").select("link_no", "anchor", "product_version")
    return graph.unique_match(asked, named, "anchor", ["product_version"], "logical_id").select("link_no", "matches", "resolution", "target")


@query("SELECT product_version, lower(title) AS name, count(DISTINCT logical_id) AS targets, min(logical_id) AS first_target, list_sort(list(DISTINCT logical_id))[:20] AS examples FROM documents WHERE title IS NOT NULL GROUP BY ALL HAVING count(DISTINCT logical_id) > 1")
def ambiguous_titles(spark: SparkSession, d: str) -> DataFrame:
    return graph.ambiguous_names(table(spark, d, "documents"), "title", ["product_version"], "logical_id")


# code


def _code(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.array_join(code.fenced_code(F.col("text")), "\n").alias("content"))
    return code.code_lines(docs.where("content <> ''"), "doc_id")


@query()
def code_declarations(spark: SparkSession, d: str) -> DataFrame:
    return code.declarations(_code(spark, d), "doc_id")


@query()
def code_identifiers(spark: SparkSession, d: str) -> DataFrame:
    return code.identifiers(_code(spark, d), "doc_id")


@query()
def code_references(spark: SparkSession, d: str) -> DataFrame:
    lines = _code(spark, d)
    return code.references(lines, "doc_id", "Reed", code.declarations(lines, "doc_id"))


# diagnostics


@query("SELECT event_id, ts, user_id FROM events WHERE ts >= '2024-01-05' AND ts < '2024-01-20' AND event_type IN ('click', 'purchase')")
def event_search(spark: SparkSession, d: str) -> DataFrame:
    found = diagnostics.search_events(table(spark, d, "events"), datetime(2024, 1, 5), datetime(2024, 1, 20), ["click", "purchase"])
    return found.select("event_id", "ts", "user_id")


@query("SELECT event_id, ts, true AS has_more FROM events WHERE ts > '2024-01-10' OR (ts = '2024-01-10' AND event_id > 0) ORDER BY ts, event_id LIMIT 50")
def event_page(spark: SparkSession, d: str) -> DataFrame:
    return diagnostics.keyset_page(table(spark, d, "events").select("event_id", "ts"), "ts", "event_id", 50, (datetime(2024, 1, 10), 0))


@query("SELECT DISTINCT user_id, '[USER:' || left(sha256(user_id::VARCHAR), 10) || ']' AS pseudonym FROM events")
def user_pseudonyms(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("user_id", text.pseudonym("user_id").alias("pseudonym")).distinct()


@query(
    """SELECT doc_id, i AS line_no, contains(lower(parts[i]), 'token')::INT + contains(lower(parts[i]), 'session')::INT AS matched
FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1))::INT AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents))
WHERE contains(lower(parts[i]), 'token') OR contains(lower(parts[i]), 'session')"""
)
def multi_needle_match(spark: SparkSession, d: str) -> DataFrame:
    return diagnostics.search_lines(table(spark, d, "documents"), "doc_id", ["token", "session", "Token"]).select("doc_id", "line_no", "matched")


_TRACE = """WITH o AS (SELECT DISTINCT user_id AS operation FROM events WHERE event_type = 'purchase'),
t AS (SELECT 'events' AS source, user_id AS operation, event_id AS record FROM events UNION ALL SELECT 'orders', o_custkey, o_orderkey FROM orders
UNION ALL SELECT 'customer', c_custkey, c_custkey FROM customer) """


def _traced(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    asked = table(spark, d, "events").where("event_type = 'purchase'").select(F.col("user_id").alias("operation"))
    sources = {"events": (table(spark, d, "events"), "user_id", "event_id"), "orders": (table(spark, d, "orders"), "o_custkey", "o_orderkey"), "customer": (table(spark, d, "customer"), "c_custkey", "c_custkey")}
    return diagnostics.trace(sources, asked), asked


@query(_TRACE + "SELECT operation, source, record FROM t JOIN o USING (operation)")
def operation_trace(spark: SparkSession, d: str) -> DataFrame:
    return _traced(spark, d)[0]


@query(
    """SELECT c_custkey AS operation, source FROM customer, (SELECT unnest(['events', 'orders']) AS source) WHERE (source = 'events' AND c_custkey NOT IN (SELECT user_id FROM events))
OR (source = 'orders' AND c_custkey NOT IN (SELECT o_custkey FROM orders))"""
)
def operation_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Customers of whom a source has no record."""
    asked = table(spark, d, "customer").select(F.col("c_custkey").alias("operation"))
    sources = {"events": (table(spark, d, "events"), "user_id", "event_id"), "orders": (table(spark, d, "orders"), "o_custkey", "o_orderkey")}
    return diagnostics.gaps(diagnostics.trace(sources, asked), asked, ["events", "orders"])


@query("SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS event_id FROM events GROUP BY user_id")
def last_event(spark: SparkSession, d: str) -> DataFrame:
    return diagnostics.last_state(table(spark, d, "events"), "user_id", "event_id", "event_type")


@query("SELECT c_custkey FROM customer WHERE contains(lower(concat_ws(' ', c_name, c_mktsegment)), 'machin') AND c_nationkey = 3")
def list_filter(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").where((F.col("c_nationkey") == 3) & diagnostics.contains_anywhere("machin", ["c_name", "c_mktsegment"])).select("c_custkey")


@query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def events_by_hour(spark: SparkSession, d: str) -> DataFrame:
    """Labelled extension: the batch form of the streaming window counts."""
    return streams.counts_by_window(table(spark, d, "events"))
