"""Logs and events: bounded search, keyset pages, redaction, tracing by exact identifiers, console lists."""

from __future__ import annotations

from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusgraph.functions import text

#: Fixed bounds: the longest range of an event search, properties of an event, its text.
MAX_RANGE, MAX_PROPERTIES, MAX_TEXT, MAX_NAMES = timedelta(days=31), 100, 8000, 50


def event_range(start: datetime, end: datetime) -> tuple[datetime, datetime]:
    if end <= start or end - start > MAX_RANGE:
        raise ValueError("the range must be positive and at most 31 days long")
    return start, end


def search_events(events: DataFrame, start: datetime, end: datetime, kinds: list[str] | None = None, contains: tuple[str, str] | None = None) -> DataFrame:
    """Events within the bounded range; the range and the kinds are pushed down to the scan."""
    start, end = event_range(start, end)
    if kinds is not None and len(kinds) > MAX_NAMES:
        raise ValueError("too many names")
    at = lambda t: F.lit(t.strftime("%Y-%m-%d %H:%M:%S.%f")).cast(dict(events.dtypes)["ts"])
    out = events.where((F.col("ts") >= at(start)) & (F.col("ts") < at(end)))
    if kinds:
        out = out.where(F.col("event_type").isin(kinds))
    return out.where(F.contains(F.lower(contains[0]), F.lit(contains[1].lower()))) if contains else out


def keyset_page(rows: DataFrame, time: str, key: str, size: int, after: tuple[datetime, int] | None = None) -> DataFrame:
    """The page after an anchor in the order of time and key; ``has_more`` if the page is full. No offset is counted."""
    if not 1 <= size <= 100:
        raise ValueError("size must be between 1 and 100")
    out = rows
    if after:
        t = F.lit(after[0].strftime("%Y-%m-%d %H:%M:%S.%f")).cast(dict(rows.dtypes)[time])
        out = out.where((F.col(time) > t) | ((F.col(time) == t) & (F.col(key) > after[1])))
    page = out.orderBy(time, key).limit(size)
    return page.crossJoin(page.agg((F.count("*") >= size).alias("has_more")))


def redact_properties(properties: Column) -> Column:
    """A map of at most 100 entries; values of sensitive keys are hidden, others redacted and bounded."""
    entries = F.slice(F.map_entries(properties), 1, MAX_PROPERTIES)
    hidden = F.transform(entries, lambda e: F.struct(F.substring(e["key"], 1, 300).alias("key"), F.when(e["key"].rlike(text.SENSITIVE_KEY), F.lit(text.HIDDEN)).otherwise(text.redact(e["value"], MAX_TEXT)).alias("value")))
    return F.map_from_entries(hidden)


def redactions(before: Column, after: Column) -> Column:
    """How many values of a map were changed."""
    return F.size(F.filter(F.map_keys(after), lambda k: ~F.try_element_at(before, k).eqNullSafe(F.try_element_at(after, k))))


def matched_terms(line: Column, needles: list[str]) -> Column:
    """How many distinct needles a line has, without regard to case."""
    tests = [F.contains(F.lower(line), F.lit(n)).cast("int") for n in dict.fromkeys(x.lower() for x in needles)]
    return reduce(lambda a, b: a + b, tests)


def search_lines(rows: DataFrame, key: str, needles: list[str], limit: int | None = None, column: str = "text") -> DataFrame:
    """Lines with at least one needle, redacted, and how many they have; ``limit`` is that of a response."""
    lines = rows.select(key, F.posexplode(F.split(column, "\n")).alias("at", "line")).select(key, (F.col("at") + 1).alias("line_no"), "line")
    hits = lines.withColumn("matched", matched_terms(F.col("line"), needles)).where("matched > 0").withColumn("line", text.compact_line(text.redact("line")))
    return hits.orderBy(key, "line_no").limit(limit) if limit else hits


def trace(sources: dict[str, tuple[DataFrame, str, str]], operations: DataFrame) -> DataFrame:
    """Rows of several sources that belong to exact identifiers, each tagged with its source: never joined with each other.

    ``sources`` maps a name to a table, its column with the identifier and that of the record. ``operations`` has ``operation``.
    """
    asked = operations.select(F.col("operation").cast("bigint")).dropna().distinct()
    parts = [df.select(F.lit(name).alias("source"), F.col(by).cast("bigint").alias("operation"), F.col(record).cast("bigint").alias("record")).join(asked, "operation") for name, (df, by, record) in sources.items()]
    return reduce(DataFrame.unionByName, parts).select("operation", "source", "record")


def gaps(traced: DataFrame, operations: DataFrame, names: list[str]) -> DataFrame:
    """Sources in which an identifier has no row."""
    wanted = operations.select(F.col("operation").cast("bigint")).distinct().select("operation", F.explode(F.array(*[F.lit(n) for n in names])).alias("source"))
    return wanted.join(traced.select("operation", "source").distinct(), ["operation", "source"], "left_anti")


def last_state(updates: DataFrame, key: str, version: str, value: str) -> DataFrame:
    """The newest value of each key."""
    return updates.groupBy(key).agg(F.max_by(value, version).alias(value), F.max(version).alias(version))


def aliased(rows: DataFrame, names: list[str]) -> DataFrame:
    """Allow-listed fields in snake case, taken from the kebab-case column or else the camel-case one; a missing one is null."""

    def pick(name: str) -> Column:
        first, *rest = name.split("_")
        forms = [f for f in (name.replace("_", "-"), first + "".join(r.title() for r in rest)) if f in rows.columns]
        return (F.coalesce(*[F.col(f"`{f}`") for f in forms]) if forms else F.lit(None)).alias(name)

    return rows.select(*[pick(n) for n in names])


def unwrap(payload: Column) -> Column:
    """The items of a list response: a bare list, or that in ``items``, ``data``, ``results`` or ``content``."""
    v = F.try_parse_json(payload)
    forms = ["$", "$.items", "$.data", "$.results", "$.content"]
    return F.coalesce(*[F.try_variant_get(v, f, "array<variant>") for f in forms])


def contains_anywhere(needle: str, columns: list[str]) -> Column:
    """Case-insensitive substring over all non-null values of the columns."""
    return F.contains(F.lower(F.concat_ws(" ", *[F.col(c).cast("string") for c in columns])), F.lit(needle.lower()))


def left_with_errors(asked: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Left join with a catalogue; rows without an entry say so in ``error``."""
    return asked.join(known.withColumn("__known", F.lit(True)), key, "left").withColumn("error", F.when(F.col("__known").isNull(), F.lit("not_found"))).drop("__known")


def match_projects(remote: DataFrame, local: DataFrame, names: list[str]) -> DataFrame:
    """Remote and local projects that share a name without regard to case; ``unique`` if the remote one fits only one."""
    fold = lambda df, k: df.select(F.col("id").alias(k), F.explode(F.array_distinct(F.array_compact(F.array(*[F.lower(n) for n in names])))).alias("name"))
    pairs = fold(remote, "remote").join(fold(local, "local"), "name").select("remote", "local").distinct()
    counts = pairs.groupBy("remote").agg(F.count("*").alias("matches"))
    return pairs.join(counts, "remote").withColumn("unique", F.col("matches") == 1)
