"""Encoding of the whole corpus with a public tokenizer (problem 6).

Long texts are cut into overlapping chunks, which are pre-tokenised and encoded in parallel. Two neighbouring chunks are
stitched at the first place of their overlap where both begin a pre-token: from there on pre-tokenisation, which depends only
on its place and what follows, runs alike in both. A run that leaves no common place (say, a hundred thousand letters without a
break) joins its chunks, which are encoded as one. Decoding concatenates the raw bytes of the ids.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusgraph.llm.bpe import encoder
from corpusgraph.sources.tables import table

#: Characters of a chunk and of the overlap of two chunks.
CHUNK, OVERLAP = 16_384, 256
#: A place so near to a chunk's end isn't trusted: what follows it isn't all in sight.
MARGIN = 8
VOCABULARY = "byte_bpe_50k.tiktoken"


def vocabulary_path(name: str = VOCABULARY) -> str:
    """The usual place of a public vocabulary; every operator takes another path."""
    import public_tokenizers

    return public_tokenizers.path(name)


def load_vocabulary(spark: SparkSession, path: str | None = None):
    """Broadcasts a vocabulary file (of fixed size, under 1 MB) so that only the driver needs its path."""
    with open(path or vocabulary_path(), "rb") as file:
        return spark.sparkContext.broadcast(file.read())


def encode_column(text: Column, vocabulary) -> Column:
    """``array<int>`` of the ids of each text, in Arrow batches; null gives an empty list."""

    @F.pandas_udf("array<int>")
    def ids(texts: pd.Series) -> pd.Series:
        return pd.Series(encoder(vocabulary.value).encode(texts.fillna("").tolist()))

    return ids(text)


def count_column(text: Column, vocabulary) -> Column:
    """The number of ids of each text; null gives 0."""

    @F.pandas_udf("bigint")
    def count(texts: pd.Series) -> pd.Series:
        return pd.Series(encoder(vocabulary.value).count(texts.fillna("").tolist()))

    return count(text)


def stitch(chunks: list[tuple[int, str, np.ndarray, np.ndarray]], encode_with_starts) -> np.ndarray:
    """Ids of a text from its chunks ``(offset, text, ids, starts)`` in order, ``starts`` being places within the chunk.

    Where an overlap has no common start, the text from the last certain start on is joined with the chunks that follow, twice as many each time,
    and encoded as one: the work stays in proportion to the text, however long a piece is.
    """
    done: list[np.ndarray] = []
    offset, text, ids, starts = chunks[0]
    begin, number, more = 0, 1, 1  # the place up to which ids are done; the next chunk; how many to join
    while number < len(chunks):
        end = offset + len(text)
        next_offset, next_text, next_ids, next_starts = chunks[number]
        certain = starts + offset
        certain = certain[(certain > begin) & (certain <= end - MARGIN)]
        common = np.intersect1d(certain, next_starts + next_offset)
        to = int(common[0]) if len(common) else int(certain[-1]) if len(certain) else begin
        done.append(ids[(starts + offset >= begin) & (starts + offset < to)])
        begin = to
        if len(common):
            offset, text, ids, starts = next_offset, next_text, next_ids, next_starts
            number, more = number + 1, 1
            continue
        parts = [text[begin - offset :]]
        for next_offset, next_text, *_ in chunks[number : number + more]:
            parts.append(next_text[end - next_offset :])
            end = next_offset + len(next_text)
        offset, text = begin, "".join(parts)
        ids, starts = encode_with_starts([text])[0]
        number, more = number + more, 2 * more
    done.append(ids[starts + offset >= begin])
    return np.concatenate(done)


def _encode_chunks(vocabulary):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = encoder(vocabulary.value)
        for batch in batches:
            made = own.encode_with_starts(batch["chunk"].tolist())
            yield batch.assign(ids=[i for i, _ in made], starts=[s.astype(np.int32) for _, s in made])

    return run


def _join_chunks(vocabulary, counts: bool):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("offset")
        own = encoder(vocabulary.value)
        chunks = [(int(o), t, np.asarray(i, np.int32), np.asarray(s, np.int64)) for o, t, i, s in zip(group["offset"], group["chunk"], group["ids"], group["starts"])]
        ids = stitch(chunks, own.encode_with_starts)
        return pd.DataFrame({"row": [group["row"].iloc[0]], "record": [group["record"].iloc[0]], "ids": [len(ids) if counts else ids]})

    return run


def encode_texts(
    records: DataFrame, key: str, text: str = "text", vocabulary: str | None = None, chunk: int = CHUNK, overlap: int = OVERLAP, counts: bool = False
) -> DataFrame:
    """One row ``(record, ids array<int>)`` for every record, or ``(record, ids bigint)``, their number, with ``counts``.

    No special tokens are added, and their strings in a text are ordinary text. An empty text and a null one have an empty
    list (0 ids). Repeated rows come out as often as they come in, null keys too. ``vocabulary`` is the path of a rank file as
    read by the driver. Extra columns are ignored.
    """
    if not MARGIN < overlap < chunk:
        raise ValueError(f"the overlap must lie between {MARGIN} and the chunk's size")
    spark = records.sparkSession
    words = load_vocabulary(spark, vocabulary)
    kind = "bigint" if counts else "array<int>"
    rows = records.select(F.col(key).alias("record"), F.col(text).alias("text"))
    single = F.coalesce(F.length("text"), F.lit(0)) <= chunk
    step = chunk - overlap
    short = rows.where(single).select("record", (count_column if counts else encode_column)(F.col("text"), words).alias("ids"))
    # a number that stays with the row, so that repeated keys aren't taken for one text
    long = rows.where(~single).withColumn("row", F.monotonically_increasing_id())
    offsets = F.sequence(F.lit(0), F.greatest(F.lit(0), F.length("text") - overlap - 1), F.lit(step))
    chunks = long.select("row", "record", F.explode(F.transform(offsets, lambda o: F.struct(o.alias("offset"), F.substring(F.col("text"), o + 1, F.lit(chunk)).alias("chunk")))).alias("x"))
    chunks = chunks.select("row", "record", "x.offset", "x.chunk").repartition("row", "offset")
    record_type = chunks.schema["record"].dataType.simpleString()
    encoded = chunks.mapInPandas(_encode_chunks(words), f"row bigint, record {record_type}, offset int, chunk string, ids array<int>, starts array<int>")
    joined = encoded.groupBy("row").applyInPandas(_join_chunks(words, counts), f"row bigint, record {record_type}, ids {kind}").select("record", "ids")
    return short.unionByName(joined)


def decode_column(ids: Column, vocabulary) -> Column:
    """The texts of the ids."""

    @F.pandas_udf("string")
    def text(lists: pd.Series) -> pd.Series:
        own = encoder(vocabulary.value)
        return lists.map(lambda x: None if x is None else own.decode(x))

    return text(ids)


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    return encode_texts(table(spark, folder, "documents"), "doc_id").select(F.col("record").alias("doc_id"), "ids")


QUERIES = {"p6_ids": p6_ids}
SQL: dict[str, str] = {}
