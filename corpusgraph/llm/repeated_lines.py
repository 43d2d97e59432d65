"""Lines repeated across the documents of one source (problem 2).

For each source and line the documents that have it are kept as bitmaps over persistent document ordinals, in blocks of
32,768 ordinals of which only those in use exist, compressed on their way. Variants of a line (other letter case, digits or white space)
have bitmaps of their own, which are united by OR; their exact cardinality is held against the source's number of documents.
Lines are deleted by looking up their bit in a bitmap of the text's lines.

A line can't stand in more documents than it has rows. Bitmaps are therefore only made for lines with enough rows, which a
count with map-side combining tells exactly; the number of such lines is bounded by 25 times the lines of an average
document. Everything else stays out of the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusgraph.plans.joins import join_checked
from corpusgraph.plans.lineage import cut
from corpusgraph.plans.ordinals import assign_ordinals, block_of, place_of
from corpusgraph.sources.tables import table

#: Bitmaps into which the variants of a line, told apart by the raw line's hash, are divided before they are united: a line with a
#: number in it may have as many variants as documents, and a bitmap for each would cost 4 KB.
VARIANTS = 16
_BLANK = r"[\s\x1c-\x1f\x85\p{Z}]+"


def same_line(line: Column) -> Column:
    """What variants of a line agree in: lower case, digits as one 0, white space as one space and none at the ends."""
    squeezed = F.regexp_replace(F.regexp_replace(F.lower(line), r"\p{Nd}+", "0"), _BLANK, " ")
    return F.trim(squeezed)


def counts_as_line(normal: Column, least_words: int) -> Column:
    """Whether the line has enough space-separated words that contain a letter."""
    return F.size(F.filter(F.split(normal, " "), lambda w: w.rlike(r"\p{L}"))) >= least_words


def repeated_lines(
    records: DataFrame, key: str, source: str, document: str, text: str = "text", percent: int = 4, least_documents: int = 5, least_words: int = 3
) -> DataFrame:
    """Rows ``(record, line_no)`` of every repeated line, lines being numbered from 1.

    A line is repeated if, in records of its source, it stands in at least ``percent`` percent of the source's documents (all
    distinct values of ``document``, also of records without text) and in at least ``least_documents``. Lines are the
    same as told by :func:`same_line`, compared by 96-bit hashes. Lines of fewer than ``least_words`` words with a letter are never repeated.

    Null and empty texts have no such lines. Records with a null source form a source of their own. A null document isn't
    counted, and its lines are removed where others make them repeated. Repeated rows come out as often as they come in.
    Empty tables give none. Extra columns are ignored.
    """
    rows = records.select(F.col(key).alias("record"), F.coalesce(F.col(source).cast("string"), F.lit("\0")).alias("source"), F.col(document).alias("document"), F.col(text).alias("text"))
    ordinals = assign_ordinals(rows, "source", "document", name="document-ordinals")
    totals = ordinals.groupBy("source").agg(F.count("*").alias("documents"))

    split = rows.where(F.col("text").isNotNull()).select("record", "source", "document", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    normal = split.withColumn("normal", same_line("line")).where(counts_as_line(F.col("normal"), least_words))
    lines = cut(
        normal.select(
            "record", "source", "document", (F.col("at") + 1).alias("line_no"), F.struct(F.xxhash64("normal").alias("a"), F.hash("normal").alias("b")).alias("line"),
            F.pmod(F.xxhash64("line"), F.lit(VARIANTS)).cast("int").alias("variant"),
        ),
        "lines",
    )

    floor = F.greatest(F.lit(least_documents), F.ceil(F.col("documents") * percent / 100))
    frequent = (
        lines.groupBy("source", "line").agg(F.count("*").alias("n")).where(F.col("n") >= least_documents).join(totals, "source").where(F.col("n") >= floor).select("source", "line")
    )
    frequent = cut(frequent, "frequent-lines")
    where = join_checked(lines, frequent, ["source", "line"]).select("source", "line", "variant", "document").distinct()
    bitmaps = (
        where.join(ordinals, ["source", "document"])
        .groupBy("source", "line", "variant", block_of("ordinal").alias("block"))
        .agg(F.bitmap_construct_agg(place_of("ordinal")).alias("bitmap"))
    )
    united = bitmaps.groupBy("source", "line", "block").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))
    exact = united.groupBy("source", "line").agg(F.sum(F.bitmap_count("bitmap")).alias("n"))
    repeated = exact.join(totals, "source").where((F.col("n") * 100 >= F.col("documents") * percent) & (F.col("n") >= least_documents)).select("source", "line")
    return join_checked(lines, cut(repeated, "repeated-lines"), ["source", "line"], "left_semi").select("record", "line_no")


def without_lines(records: DataFrame, key: str, found: DataFrame, text: str = "text") -> DataFrame:
    """``records`` with the found lines deleted from ``text``: ``found`` has ``(record, line_no)``.

    The lines to delete form a bitmap for each record, in words of 64 lines; a line stays unless its bit is set. Other lines
    keep their order and their bytes; a text of which no line is left becomes empty, a null one stays null. ``key`` should be unique.
    """
    place = F.col("line_no") - 1
    words = (
        found.groupBy("record", F.shiftright(place, 6).alias("word"))
        .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), place.bitwiseAND(63))).alias("bits"))
        .groupBy("record")
        .agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("__bitmap"))
    )
    marked = records.join(words, records[key] == words["record"], "left").drop(words["record"])

    def stays(line: Column, i: Column) -> Column:
        bits = F.coalesce(F.element_at("__bitmap", F.shiftright(i, 6)), F.lit(0).cast("bigint"))
        return F.call_function("shiftright", bits, i.bitwiseAND(63)).bitwiseAND(1) == 0

    kept = F.array_join(F.filter(F.split(text, "\n"), stays), "\n")
    return marked.withColumn(text, F.when(F.col("__bitmap").isNull(), F.col(text)).otherwise(kept)).drop("__bitmap")


def _found(spark: SparkSession, folder: str) -> DataFrame:
    return repeated_lines(table(spark, folder, "chunks"), "chunk_no", "corpus", "logical_id")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return _found(spark, folder).select(F.col("record").alias("chunk_no"), "line_no")


def p2_clean(spark: SparkSession, folder: str) -> DataFrame:
    """Every chunk's text without the repeated lines."""
    return without_lines(table(spark, folder, "chunks").select("chunk_no", "text"), "chunk_no", _found(spark, folder))


QUERIES = {"p2_found": p2_found, "p2_clean": p2_clean}

_REPEATED = r"""
WITH l AS (SELECT chunk_no, corpus, logical_id, i AS line_no, trim(regexp_replace(regexp_replace(lower(parts[i]), '\p{Nd}+', '0', 'g'), '[\s\x1c-\x1f\x{85}\p{Z}]+', ' ', 'g')) AS line, parts[i] AS raw
  FROM (SELECT chunk_no, corpus, logical_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT *, string_split(text, chr(10)) AS parts FROM chunks))),
n AS (SELECT corpus, count(DISTINCT logical_id) AS documents FROM chunks GROUP BY corpus),
r AS (SELECT corpus, line FROM l JOIN n USING (corpus) WHERE len(list_filter(string_split(line, ' '), lambda w: regexp_matches(w, '\p{L}'))) >= 3
  GROUP BY corpus, line, documents HAVING count(DISTINCT logical_id) * 100 >= documents * 4 AND count(DISTINCT logical_id) >= 5)
"""

SQL = {
    "p2_found": _REPEATED + "SELECT chunk_no, line_no::INT AS line_no FROM l JOIN r USING (corpus, line)",
    "p2_clean": _REPEATED + """
SELECT c.chunk_no, coalesce(t.text, '') AS text FROM chunks c
LEFT JOIN (SELECT chunk_no, string_agg(raw, chr(10) ORDER BY line_no) AS text FROM l WHERE (corpus, line) NOT IN (SELECT (corpus, line) FROM r) GROUP BY chunk_no) t USING (chunk_no)""",
}
