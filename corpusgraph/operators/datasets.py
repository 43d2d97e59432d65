"""Schema-on-read datasets: any-leaf search, exact filters, catalogue, keyed lookups and joins."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed bounds of a request.
MAX_QUERY, MAX_FILTERS, MAX_FIELD, MAX_VALUE, MAX_PAGE, MAX_BYTES = 500, 8, 128, 500, 100, 2 << 20


def leaves(value) -> list[str]:
    """The scalar leaves of a JSON value as text; truth values and null in their usual Python spelling."""
    if isinstance(value, dict):
        return [leaf for child in value.values() for leaf in leaves(child)]
    if isinstance(value, list):
        return [leaf for child in value for leaf in leaves(child)]
    return [str(value)]


@F.pandas_udf(T.ArrayType(T.StringType()))
def json_leaves(rows: pd.Series) -> pd.Series:
    return rows.map(lambda r: leaves(json.loads(r)) if r is not None else [])


def any_leaf_contains(payload: Column, needle: str) -> Column:
    """Whether a value (not a key) of the JSON text contains the needle, without regard to case.

    The cheap test on the whole text comes first, so that only its hits are parsed.
    """
    n = needle.lower()
    if n in "none true false":
        return F.exists(json_leaves(payload), lambda x: F.contains(F.lower(x), F.lit(n)))
    plain = n.isascii() and n.isprintable() and not set(n) & set('"\\')
    exact = F.exists(json_leaves(payload), lambda x: F.contains(F.lower(x), F.lit(n)))
    return F.contains(F.lower(payload), F.lit(n)) & exact if plain else exact


def field_equals(payload: Column, field: str, expected: str) -> Column:
    """Equality of a dotted field with a value without regard to case; any element of a list counts, objects never do."""
    v = F.try_parse_json(payload)
    path = "$." + field
    scalar = F.lower(F.try_variant_get(v, path, "string"))
    listed = F.try_variant_get(v, path, "array<string>")
    kind = F.schema_of_variant(F.try_variant_get(v, path, "variant"))
    is_object = F.coalesce(kind.startswith("OBJECT"), F.lit(False))
    return F.when(is_object, F.lit(False)).when(listed.isNotNull(), F.exists(listed, lambda x: F.lower(x) == expected.lower())).otherwise(F.coalesce(scalar, F.lit("none")) == expected.lower())


def query(rows: DataFrame, payload: str, search: str | None = None, filters: dict[str, str] | None = None) -> DataFrame:
    """Rows whose JSON meets the free-text search and every exact filter."""
    filters = filters or {}
    if search is not None and len(search) > MAX_QUERY or len(filters) > MAX_FILTERS:
        raise ValueError("the search or the list of filters is too long")
    if any(not f or len(f) > MAX_FIELD or len(str(v)) > MAX_VALUE for f, v in filters.items()):
        raise ValueError("a filter has a wrong field or too long a value")
    out = rows
    for field, value in filters.items():
        out = out.where(field_equals(F.col(payload), field, str(value)))
    return out.where(any_leaf_contains(F.col(payload), search)) if search else out


def one(rows: DataFrame, condition: Column) -> DataFrame:
    """The single row that meets the condition; an error if there is none or more than one."""
    found = rows.where(condition).limit(2).count()
    if found != 1:
        raise LookupError("no such row" if not found else "several rows have this key")
    return rows.where(condition)


def adapt_json(value) -> list[dict]:
    """Rows of a JSON document: an object gives key-value rows, a list its elements (scalars boxed), a scalar one row."""
    if isinstance(value, dict):
        return [{"key": k, "value": v} for k, v in value.items()]
    return [v if isinstance(v, dict) else {"value": v} for v in (value if isinstance(value, list) else [value])]


def ordered_lookup(rows: DataFrame, key: str, keys: str, target: DataFrame, target_key: str, columns: list[str]) -> DataFrame:
    """Left join of a list column with a table, the list's order kept: ``matches`` has a struct for every key found.

    The first target of a key, by its columns, counts; unknown keys are left out. The list is bounded by its row.
    """
    first = target.groupBy(F.col(target_key).alias("k")).agg(F.min(F.struct(*columns)).alias("match"))
    exploded = rows.select(key, F.posexplode(keys).alias("at", "k")).join(first, "k")
    lists = exploded.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("at", "match"))).alias("found"))
    return rows.join(lists, key, "left").withColumn("matches", F.coalesce(F.transform("found", lambda x: x["match"]), F.array())).drop("found")


def connections(edges: DataFrame, component: str, sources: list[str]) -> DataFrame:
    """Connections that name the component, or an id that ends with it, in one of the columns."""
    test = None
    for c in sources:
        hit = (F.col(c) == component) | F.col(c).endswith("-" + component)
        test = hit if test is None else test | hit
    return edges.where(F.coalesce(test, F.lit(False)))


def catalog(parts: list[dict]) -> list[dict]:
    """Checks a dataset catalogue: ids composed and unique, relative paths, known formats, hashes of 64 hex digits."""
    import re

    seen = set()
    for p in parts:
        expected = f"{p['corpus']}.{p['product_version']}.{p['name']}"
        problems = [
            p["id"] != expected, p["id"] in seen, p["format"] not in ("json", "jsonl"), not re.fullmatch("[0-9a-f]{64}", p["sha256"]),
            p["path"].startswith("/") or ".." in p["path"].split("/"), p.get("records") is not None and p["records"] < 0,
        ]
        if any(problems):
            raise ValueError(f"invalid catalogue entry: {p['id']}")
        seen.add(p["id"])
    return parts
