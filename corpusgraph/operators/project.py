"""The evidence-carrying dependency graph of a source project, from elements and facts of files.

Nodes, edges and issues are tables built by joins; each edge says how sure it is, how it was resolved and where its evidence
stands. A name counts only if it fits exactly one target (``graph.unique_match``).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusgraph.functions import text
from corpusgraph.operators import graph
from corpusgraph.operators.code import EXTERNAL_ROOTS

#: Element kinds that nothing needs to refer to, and what makes a visibility public.
ROOT_KINDS = ["Project", "Subsystem", "Resources"]


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def _node(kind: str, *parts: Column | str) -> Column:
    return text.stable_id(kind, *parts)


def owners(elements: DataFrame) -> DataFrame:
    """Which element owns a file: ``(path, element)``, the element being its node id; the last element of a file counts."""
    files = elements.select(_node("element", "metadata_path").alias("element"), F.explode(F.concat(F.array("metadata_path"), "implementation_files")).alias("path"))
    return files.groupBy("path").agg(F.max("element").alias("element"))


def nodes(elements: DataFrame, facts: DataFrame) -> DataFrame:
    """Nodes ``(id, type, name, path, kind)`` of elements, files, subsystems and symbols."""
    parts = [
        elements.select(_node("element", "metadata_path").alias("id"), F.lit("element").alias("type"), "name", F.col("metadata_path").alias("path"), F.col("element_kind").alias("kind")),
        facts.select("path").unionByName(owners(elements).select("path")).distinct().select(_node("file", "path").alias("id"), F.lit("file").alias("type"), F.substring_index("path", "/", -1).alias("name"), "path"),
        elements.where(F.col("subsystem").isNotNull()).select(_node("subsystem", "subsystem").alias("id"), F.lit("subsystem").alias("type"), F.col("subsystem").alias("name")),
        facts.where("fact_type = 'declaration'").select(_node("symbol", "path", F.lower("value"), "line_no").alias("id"), F.lit("symbol").alias("type"), F.col("value").alias("name"), "path"),
    ]
    return _union(parts).dropDuplicates(["id"])


def _edge(df: DataFrame, kind: str, confidence: Column | str, resolution: Column | str, basis: str) -> DataFrame:
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    evidence = F.struct("path", F.col("line_no").cast("int").alias("line"), F.lit(basis).alias("basis"), F.col("value").cast("string").alias("value"))
    return df.select("source", "target", F.lit(kind).alias("type"), lit(confidence).alias("confidence"), lit(resolution).alias("resolution"), evidence.alias("evidence"))


def edges(elements: DataFrame, facts: DataFrame) -> DataFrame:
    """Edges ``(id, source, target, type, confidence, resolution, evidence)``, each evidence once."""
    known = elements.withColumn("element", _node("element", "metadata_path"))
    own = owners(elements)
    located = facts.join(own, "path", "left").withColumn("source", F.coalesce("element", _node("file", "path")))
    none = F.lit(None)
    plain = lambda df: df.withColumn("line_no", none.cast("int")).withColumn("value", none.cast("string"))
    structural = [
        _edge(plain(known.select(F.col("element").alias("source"), _node("file", "metadata_path").alias("target"), F.col("metadata_path").alias("path"))), "metadata_file", "high", "explicit", "element metadata path"),
        _edge(plain(known.select(F.col("element").alias("source"), F.explode("implementation_files").alias("path")).withColumn("target", _node("file", "path"))), "companion_file", "high", "explicit", "same folder and stem"),
        _edge(plain(known.where(F.col("subsystem").isNotNull()).select(F.col("element").alias("source"), _node("subsystem", "subsystem").alias("target"), F.col("metadata_path").alias("path"))), "belongs_to_subsystem", "high", "explicit", "nearest subsystem manifest"),
        _edge(facts.where("fact_type = 'declaration'").withColumn("source", _node("file", "path")).withColumn("target", _node("symbol", "path", F.lower("value"), "line_no")), "declares", "high", "explicit", "declaration"),
    ]
    by_name = known.select(F.col("name").alias("key"), "element")
    by_id = known.where(F.col("element_id").isNotNull()).groupBy(F.lower("element_id").alias("key")).agg(F.min_by("element", "metadata_path").alias("element"))
    subsystems = known.where(F.col("subsystem").isNotNull()).select(F.col("subsystem").alias("key"), _node("subsystem", "subsystem").alias("element"))

    def match(rows: DataFrame, key: Column, targets: DataFrame) -> DataFrame:
        hits = graph.unique_match(rows.withColumn("key", key).drop("element"), targets, "key", [], "element")
        return hits.where("resolution = 'exact' AND source <> target").drop("resolution")

    of = lambda fact: located.where(F.col("fact_type") == fact)
    lines = facts.where("fact_type = 'import'").select("path", "line_no").distinct()
    named = [
        _edge(match(of("import"), F.substring_index("value", "::", 1), subsystems), "imports_subsystem", "high", "explicit", "import"),
        _edge(match(of("using"), F.substring_index("value", "::", 1), subsystems), "uses_subsystem", "high", "explicit", "list of used subsystems"),
        _edge(match(of("import").where("value LIKE '%::%'"), text.last_name("value"), by_name), "imports_element", "high", "explicit_name", "qualified import"),
        _edge(match(of("type"), text.last_name("value"), by_name), "yaml_type_reference", "medium", "syntax_aware_name_match", "type of a known element's name"),
        _edge(match(of("uuid"), F.lower("value"), by_id), "yaml_id_reference", "high", "exact_id", "element id"),
        _edge(match(of("identifier").join(lines, ["path", "line_no"], "left_anti"), F.col("value"), by_name), "lexical_reference", "medium", "lexical_name_match", "identifier in code"),
    ]
    handled = handlers(elements, facts).where("matches = 1")
    handler_edges = _edge(handled.withColumnRenamed("element", "source"), "yaml_handler", F.when(F.col("local"), "high").otherwise("medium"), F.when(F.col("local"), "companion_declaration").otherwise("unique_project_declaration"), "handler")
    made = _union([*structural, *named, handler_edges])
    e = F.col("evidence")
    unique = made.dropDuplicates(["source", "target", "type", "evidence"])
    return unique.select(text.stable_id("edge", "source", "target", "type", e["path"], e["line"], e["value"]).alias("id"), "*")


def handlers(elements: DataFrame, facts: DataFrame) -> DataFrame:
    """Handlers with their declaration: of the element's own sources first, otherwise of the project; ``matches`` counts what fits."""
    declared = facts.where("fact_type = 'declaration'").select(F.lower("value").alias("key"), F.col("path").alias("at"), _node("symbol", "path", F.lower("value"), "line_no").alias("symbol"))
    asked = facts.where("fact_type = 'handler'").join(owners(elements), "path").withColumn("key", F.lower("value"))
    sources = elements.select(_node("element", "metadata_path").alias("element"), F.explode("implementation_files").alias("at"))
    group = ["path", "line_no", "value", "element"]
    near = asked.join(sources, "element").join(declared, ["key", "at"]).groupBy(*group).agg(F.count("*").alias("near"), F.min("symbol").alias("near_symbol"))
    any_where = declared.groupBy("key").agg(F.count("*").alias("far"), F.min("symbol").alias("far_symbol"))
    out = asked.join(near, group, "left").join(any_where, "key", "left").withColumn("local", F.col("near").isNotNull())
    return out.select(*group, "local", F.coalesce("near", "far", F.lit(0)).alias("matches"), F.coalesce("near_symbol", "far_symbol").alias("target"))


def issues(elements: DataFrame, facts: DataFrame) -> DataFrame:
    """Issues ``(code, severity, path, line, value)``, ordered by path, line and code."""
    known = elements.withColumn("element", _node("element", "metadata_path"))
    row = lambda df, code, severity, path="path", line=None, value="value": df.select(F.lit(code).alias("code"), F.lit(severity).alias("severity"), F.col(path).alias("path"), (F.col(line) if line else F.lit(None)).cast("int").alias("line"), F.col(value).alias("value"))
    ids = known.where(F.col("element_id").isNotNull()).withColumn("key", F.lower("element_id"))
    first = ids.groupBy("key").agg(F.min("metadata_path").alias("first"))
    names = known.groupBy(F.lower("name").alias("value")).agg(F.count("*").alias("n"), F.min("metadata_path").alias("path")).where("n > 1")
    sources = facts.where("fact_type IN ('identifier', 'import', 'declaration')").select("path").distinct()
    orphan = sources.join(owners(elements).select("path"), "path", "left_anti").withColumn("value", F.lit(None).cast("string"))
    subsystems = known.where(F.col("subsystem").isNotNull()).select(F.col("subsystem").alias("key"), F.col("subsystem").alias("element"))
    used = facts.where("fact_type IN ('import', 'using')").withColumn("key", F.substring_index("value", "::", 1)).where(~F.lower("key").isin(EXTERNAL_ROOTS))
    roots = graph.unique_match(used, subsystems, "key", [], "element")
    handled = handlers(elements, facts)
    parts = [
        row(ids.join(first, "key").where("metadata_path <> first"), "duplicate_element_id", "error", "metadata_path", None, "element_id"),
        row(names, "ambiguous_element_name", "warning"),
        row(orphan, "orphan_source_file", "warning"),
        row(roots.where("resolution = 'not_found'"), "unresolved_import", "warning", line="line_no"),
        row(roots.where("resolution = 'ambiguous'"), "ambiguous_import", "warning", line="line_no"),
        row(handled.where("matches = 0"), "missing_handler", "error", line="line_no"),
        row(handled.where("matches > 1"), "ambiguous_handler", "warning", line="line_no"),
    ]
    return _union(parts).orderBy("path", F.coalesce("line", F.lit(0)), "code")


def structure_status(found: DataFrame) -> DataFrame:
    """Errors and warnings, and whether the project is valid."""
    return found.agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings")).withColumn("status", F.when(F.col("errors") > 0, "invalid").otherwise("valid"))


def overview(elements: DataFrame) -> DataFrame:
    """Elements by kind and subsystem, with how many have sources and how many are metadata only."""
    paired = F.size("implementation_files") > 0
    return elements.groupBy("element_kind", "subsystem").agg(F.count("*").alias("elements"), F.count_if(paired).alias("with_sources"), F.count_if(~paired).alias("metadata_only"))


def list_elements(elements: DataFrame, kind: str | None = None, subsystem: str | None = None, search: str | None = None) -> DataFrame:
    """Elements of a kind and a subsystem that contain the search text, all without regard to case."""
    out = elements
    for column, value in (("element_kind", kind), ("subsystem", subsystem)):
        if value:
            out = out.where(F.lower(column) == value.lower())
    if search:
        parts = F.concat_ws(" ", "name", "element_kind", "element_id", "subsystem", "metadata_path")
        out = out.where(F.contains(F.lower(parts), F.lit(search.lower())))
    return out.orderBy(F.lower("name"), "metadata_path")


def select_element(elements: DataFrame, asked: str) -> DataFrame:
    """Elements whose name, id or path is the asked one, with ``resolution``: exact, selection_required or not at all."""
    a = asked.lower()
    found = elements.where((F.lower("name") == a) | (F.lower("element_id") == a) | (F.lower("metadata_path") == a))
    total = found.agg(F.count("*").alias("n"))
    return found.crossJoin(total).withColumn("resolution", F.when(F.col("n") == 1, "exact").otherwise("selection_required")).drop("n").orderBy("metadata_path").limit(20)


def dependency_page(all_edges: DataFrame, page: DataFrame, lexical: bool = False) -> DataFrame:
    """Dependency edges with both ends on a page of nodes."""
    kinds = [k for k in graph.DEPENDENCY if lexical or k not in graph.LEXICAL]
    inside = all_edges.where(F.col("type").isin(kinds))
    on = page.select("id").distinct()
    return inside.join(on.withColumnRenamed("id", "source"), "source", "left_semi").join(on.withColumnRenamed("id", "target"), "target", "left_semi")


def path_confidence(confidences: Column) -> Column:
    """The confidence of a path: medium if any of its edges isn't high."""
    return F.when(F.exists(confidences, lambda c: c != "high"), "medium").otherwise("high")


def unused(elements: DataFrame, all_edges: DataFrame, public: Column | None = None) -> DataFrame:
    """Elements to which no dependency leads; roots and, if told apart, public ones aside. A hint only: confidence low."""
    depends = all_edges.where(F.col("type").isin(graph.DEPENDENCY)).select(F.col("target").alias("id"))
    candidates = elements.where(~F.col("element_kind").isin(ROOT_KINDS)).withColumn("id", _node("element", "metadata_path"))
    if public is not None:
        candidates = candidates.where(~public)
    return candidates.join(depends, "id", "left_anti").withColumn("confidence", F.lit("low"))


def changed_files(files: DataFrame, cached: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files whose facts must be made anew (new or of another hash), and cached paths that are gone."""
    fresh = files.join(cached.select("path", "sha256"), ["path", "sha256"], "left_anti")
    return fresh, cached.select("path").distinct().join(files.select("path"), "path", "left_anti")


def subsystem_summary(elements: DataFrame, facts: DataFrame) -> DataFrame:
    """By subsystem: elements, kinds, methods and imports; ``Unknown`` where there is none."""
    name = F.coalesce("subsystem", F.lit("Unknown")).alias("subsystem")
    kinds = elements.groupBy(name, F.coalesce("element_kind", F.lit("Unknown")).alias("kind")).agg(F.count("*").alias("n"))
    per = kinds.groupBy("subsystem").agg(F.sum("n").alias("elements"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("kind", "n")))).alias("kinds"))
    where = elements.select(name, F.explode(F.concat(F.array("metadata_path"), "implementation_files")).alias("path"))
    counts = facts.join(where, "path").groupBy("subsystem").agg(F.count_if(F.col("fact_type") == "declaration").alias("methods"), F.count_if(F.col("fact_type") == "import").alias("imports"))
    return per.join(counts, "subsystem", "left").fillna(0, ["methods", "imports"])
