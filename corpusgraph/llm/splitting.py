"""Splitting oversized items at natural boundaries (problem 5).

One regular expression with bounded quantifiers cuts a text: its alternatives stand in the order of boundary strength
(end of text, block, line, sentence, word) and each consumes as much as the limit allows; the last one cuts between
characters. An alternative only counts if its piece fills a fair part of the limit, so a strong boundary early in a
piece doesn't make a tiny one. Overlap looks back from each cut into the piece before it. Everything runs as
built-in array functions in the JVM; a text is read once, whatever its length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusgraph.sources.tables import table

LIMIT, OVERLAP = 1800, 200

#: What a piece may end with, strongest first: blank line, line feed, end of a sentence, white space.
BOUNDARIES = [r"(?<=\n[ \t\r]{0,8}\n)", r"(?<=\n)", r"(?<=[.!?…][\"'»)]?\s)", r"(?<=\s)"]


def cutting_pattern(most: int, least: int) -> str:
    """Pieces of ``least`` to ``most`` characters that end at the strongest boundary, or the rest of the text."""
    if not 0 < least <= most:
        raise ValueError("the least size must lie between 1 and the greatest")
    natural = "".join(f".{{{least},{most}}}{b}|" for b in BOUNDARIES)
    return rf"(?s).{{1,{most}}}\z|{natural}.{{{most}}}"


def pieces(text: Column | str, limit: int = LIMIT, overlap: int = OVERLAP) -> Column:
    """Array of the pieces of ``text``, each of at most ``limit`` code points.

    Every piece after the first starts with the last ``overlap`` characters of the piece before it; without those the pieces
    make up the text. A text within the limit is one piece, an empty one one empty piece, a null one null.
    """
    text = F.col(text) if isinstance(text, str) else text
    most = limit - overlap
    if overlap < 0 or most <= overlap:
        raise ValueError("the overlap must be less than half of the limit")
    least = max(overlap, most // 2, 1)
    cores = F.regexp_extract_all(text, F.lit(cutting_pattern(most, least)), F.lit(0))

    def with_overlap(cores: Column) -> Column:
        def join(core: Column, i: Column) -> Column:
            before = F.get(cores, i - 1)
            return F.when(i == 0, core).otherwise(F.concat(F.substring(before, -overlap, overlap) if overlap else F.lit(""), core))

        return F.transform(cores, join)

    return F.when(F.length(text) <= limit, F.array(text)).when(text.isNotNull(), with_overlap(cores))


def split_oversized(records: DataFrame, text: str = "text", limit: int = LIMIT, overlap: int = OVERLAP, position: str = "piece") -> DataFrame:
    """``records`` with one row a piece: ``text`` holds the piece, ``position`` its number from 0, ``pieces`` how many there are.

    All other columns are kept as they are, but existing ones named as the two new ones are replaced. A record whose text is
    null or within the limit stays one row. Repeated rows are split alike.
    """
    kept = [c for c in records.columns if c not in (text, position, "pieces")]
    made = records.select(*kept, pieces(F.col(text), limit, overlap).alias("__pieces"))
    return made.select(*kept, F.posexplode_outer("__pieces").alias("__at", text), F.greatest(F.size("__pieces"), F.lit(1)).alias("pieces")).select(
        *kept, F.coalesce("__at", F.lit(0)).alias(position), "pieces", text
    )


def _pieces(spark: SparkSession, folder: str) -> DataFrame:
    chunks = table(spark, folder, "chunks").select("chunk_no", "section", "text")
    return split_oversized(chunks, position="position").where("pieces > 1")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return _pieces(spark, folder).where("position = 0").select("chunk_no")


def p5_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """The pieces of every oversized chunk."""
    return _pieces(spark, folder).select("chunk_no", "section", "position", "text")


QUERIES = {"p5_found": p5_found, "p5_pieces": p5_pieces}

SQL = {"p5_found": "SELECT chunk_no FROM chunks WHERE length(text) > 1800"}
