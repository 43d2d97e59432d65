"""Links, dependency graphs and reachability over node and edge tables.

Edges are rows ``(source, target)`` and more. Walks run frontier by frontier: one join a level, each level written once so that
plans don't grow, the visited set kept by anti-joins. No adjacency list is ever gathered.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusgraph.functions import text
from corpusgraph.plans.lineage import cut

#: Edge kinds that tell a dependency, structure, and a mere occurrence of a name.
DEPENDENCY = ["imports_subsystem", "imports_element", "uses_subsystem", "yaml_id_reference", "yaml_type_reference", "yaml_handler", "lexical_reference"]
LEXICAL = ["lexical_reference"]
STRUCTURAL = ["metadata_file", "companion_file", "belongs_to_subsystem", "environment", "visibility", "declares"]
MAX_DEPTH = 5
EXAMPLES = 20
#: Edges that one task may finish: some megabytes.
FEW_EDGES = 100_000


def document_links(documents: DataFrame) -> DataFrame:
    """Links ``(source, href)`` in the documents' Markdown, fragments cut, each once a document."""
    found = documents.select(F.col("id").alias("source"), F.explode(F.array_distinct(text.links("text"))).alias("href"))
    return found.where("href <> ''")


def resolve_links(links: DataFrame, documents: DataFrame, url: str = "source_uri") -> DataFrame:
    """Edges between documents: the target has the address, or else the address with a slash; the last document of an address counts.

    Links to itself and repeats are dropped.
    """
    known = documents.where(F.col(url).isNotNull()).groupBy(F.col(url).alias("address")).agg(F.max("id").alias("target"))
    both = links.select("source", F.posexplode(F.array(F.col("href"), F.concat("href", F.lit("/")))).alias("nth", "address"), "href")
    hits = both.join(known, "address").groupBy("source", "href").agg(F.min_by("target", "nth").alias("target"))
    return hits.where("source <> target").select("source", "target").distinct()


def release_edges(links: DataFrame, documents: DataFrame) -> DataFrame:
    """Edges between logical ids within each release: a link counts if both its ends are there. Repeats count once, self-links don't."""
    ends = documents.select("id", "logical_id", "product_version").distinct()
    source = ends.select(F.col("id").alias("document_id"), F.col("logical_id").alias("source")).distinct()
    target = ends.select(F.col("logical_id").alias("target_logical_id"), "product_version").distinct()
    real = links.where(F.col("target_logical_id").isNotNull()).select("document_id", "product_version", "target_logical_id").distinct()
    joined = real.join(source, "document_id").join(target, ["target_logical_id", "product_version"])
    return joined.where("source <> target_logical_id").select("product_version", "source", F.col("target_logical_id").alias("target")).distinct()


def reverse_index(edges: DataFrame) -> DataFrame:
    """Distinct sources of each target, one row each: no list grows with a popular target."""
    return edges.select("target", "source").distinct()


def in_degrees(edges: DataFrame) -> DataFrame:
    return edges.groupBy("target").agg(F.countDistinct("source").alias("inbound"))


def walk(edges: DataFrame, starts: DataFrame, depth: int, direction: str = "outgoing") -> DataFrame:
    """Nodes within ``depth`` steps of the starts: ``(node, level, via)``, ``via`` being the least node one step before.

    ``starts`` has a column ``node``; starts are level 0. ``direction`` is outgoing, incoming or both.
    """
    if not 1 <= depth <= MAX_DEPTH:
        raise ValueError(f"depth must be between 1 and {MAX_DEPTH}")
    out = edges.select(F.col("source").alias("node"), F.col("target").alias("next"))
    into = edges.select(F.col("target").alias("node"), F.col("source").alias("next"))
    steps = {"outgoing": out, "incoming": into, "both": out.unionByName(into)}[direction]
    steps = cut(steps.dropna().distinct(), "steps")
    frontier = cut(starts.select("node").dropna().distinct().select("node", F.lit(0).alias("level"), F.lit(None).cast("string").alias("via")), "level")
    visited = frontier
    for level in range(1, depth + 1):
        met = frontier.select("node").join(steps, "node").groupBy(F.col("next").alias("node")).agg(F.min("node").cast("string").alias("via"))
        frontier = cut(met.join(visited.select("node"), "node", "left_anti").select("node", F.lit(level).alias("level"), "via"), "level")
        visited = visited.unionByName(frontier)
    return visited


def limited_walk(edges: DataFrame, starts: DataFrame, depth: int, nodes: int, direction: str = "outgoing") -> DataFrame:
    """The nearest ``nodes`` nodes of a walk (a limit of the response), with ``truncated`` if there are more."""
    found = walk(edges, starts, depth, direction)
    total = found.agg(F.count("*").alias("total"))
    return found.orderBy("level", "node").limit(nodes).crossJoin(total).withColumn("truncated", F.col("total") > nodes).drop("total")


def impact(edges: DataFrame, changed: DataFrame, depth: int) -> DataFrame:
    """What depends on the changed nodes, within ``depth`` steps: the changed nodes themselves aside."""
    return walk(edges, changed, depth, "incoming").where("level > 0").select("node", "level")


def without_inbound(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes to which no edge leads."""
    return nodes.select("node").distinct().join(edges.select(F.col("target").alias("node")), "node", "left_anti")


def cycle_members(edges: DataFrame, few: int = FEW_EDGES) -> DataFrame:
    """Nodes on cycles of more than one node: ``(node, component, members)``, the component being the least node of the strongly connected
    component. Null ends and self-links don't count; edges may repeat.

    Nodes are ordered by a hash. Every node learns the first node that reaches it and the first one that it reaches, by doubling;
    where both agree, it lies on a cycle with that node or is that node. Edges between nodes whose pairs differ can't lie on a
    cycle and go; what is left is taken again. The rounds are logarithmic in the number of nodes, whatever the length of paths and cycles,
    and end when no edge is left. Once a count proves that at most ``few`` edges are left, one task finishes them.
    """
    ranked = lambda c: F.struct(F.xxhash64(c).alias("rank"), F.col(c).alias("name"))
    live = cut(edges.select("source", "target").dropna().where("source <> target").select(ranked("source").alias("source"), ranked("target").alias("target")).distinct(), "live")
    done: DataFrame | None = None
    while True:
        live = cut(_peeled(_peeled(live)), "live")
        left = live.count()
        if left <= few:
            if left:
                last = live.select(F.col("source.name").alias("source"), F.col("target.name").alias("target"), F.lit(0).alias("all")).groupBy("all").applyInPandas(_components, "node string, root string")
                found = last.select(*[ranked(c).alias(c) for c in ("node", "root")])
                done = found if done is None else done.unionByName(found)
            break
        reached_by, reaches = _first_reaching(live, "source", "target"), _first_reaching(live, "target", "source")
        labels = cut(reached_by.select("node", F.col("first").alias("from")).join(reaches.select("node", F.col("first").alias("to")), "node"), "labels")
        found = labels.where(F.col("from") == F.col("to")).select("node", F.col("from").alias("root"))
        done = found if done is None else done.unionByName(found)
        open_ = labels.where(F.col("from") != F.col("to")).select("node", F.struct("from", "to").alias("pair"))
        ends = live.join(open_.select(F.col("node").alias("source"), F.col("pair").alias("a")), "source").join(open_.select(F.col("node").alias("target"), F.col("pair").alias("b")), "target")
        live = ends.where(F.col("a") == F.col("b")).select("source", "target")
    if done is None:
        return edges.select(F.col("source").alias("node"), F.col("source").alias("component"), F.lit(1).cast("bigint").alias("members")).limit(0)
    sizes = done.groupBy("root").agg(F.min("node.name").alias("component"), F.count("*").alias("members")).where("members > 1")
    return done.join(sizes, "root").select(F.col("node.name").alias("node"), "component", "members")


def _components(live: pd.DataFrame) -> pd.DataFrame:
    """``(node, root)`` of a bounded set of edges: nodes in the order in which a search leaves them, then searches against the edges in reverse order."""
    ends, names = pd.factorize(pd.concat([live["source"], live["target"]]), sort=True)
    a, b = ends[: len(live)], ends[len(live) :]

    def neighbours(of: np.ndarray, to: np.ndarray) -> list[np.ndarray]:
        order = np.argsort(of, kind="stable")
        return np.split(to[order], np.searchsorted(of[order], np.arange(1, len(names))))

    def searched(starts, steps: list[np.ndarray]):
        seen = np.zeros(len(names), bool)
        for start in starts:
            if seen[start]:
                continue
            seen[start] = True
            stack, left = [(start, iter(steps[start]))], []
            while stack:
                node, rest = stack[-1]
                step = next((n for n in rest if not seen[n]), None)
                if step is None:
                    left.append(stack.pop()[0])
                else:
                    seen[step] = True
                    stack.append((step, iter(steps[step])))
            yield left

    leaving = [n for left in searched(range(len(names)), neighbours(a, b)) for n in left]
    rows = [(names[n], names[min(part)]) for part in searched(reversed(leaving), neighbours(b, a)) for n in part]
    return pd.DataFrame(rows, columns=["node", "root"])


def _peeled(live: DataFrame) -> DataFrame:
    """The edges whose source has a way in and whose target has a way out: a cheap step that cycles don't need to be found."""
    into, out = live.select(F.col("target").alias("source")).distinct(), live.select(F.col("source").alias("target")).distinct()
    return live.join(into, "source", "left_semi").join(out, "target", "left_semi").select("source", "target")


def _first_reaching(live: DataFrame, source: str, target: str) -> DataFrame:
    """``(node, first)``: the first node that reaches each one along the edges, or itself.

    A round takes over what the neighbours know, and follows what is known three times: the stretch that a node sees grows by a factor.
    """
    first = cut(live.select(F.explode(F.array("source", "target")).alias("node")).distinct().withColumn("first", F.col("node")), "labels")
    while True:
        known = first.select(F.col("node").alias("at"), F.col("first").alias("next"))
        sent = live.join(known, live[source] == F.col("at")).select(F.col(target).alias("node"), F.col("next").alias("first"))
        twice = first.join(known, F.col("first") == F.col("at")).select("node", F.col("next").alias("first"))
        further = twice.select(F.col("node").alias("at"), F.col("first").alias("next"))
        four = twice.join(further, F.col("first") == F.col("at")).select("node", F.col("next").alias("first"))
        told = first.withColumn("was", F.col("first")).unionByName(sent.unionByName(four).withColumn("was", F.lit(None).cast(first.schema["first"].dataType)))
        now = cut(told.groupBy("node").agg(F.min("first").alias("first"), F.max("was").alias("was")), "labels")
        if now.where(F.col("first") != F.col("was")).isEmpty():
            return now.select("node", "first")
        first = now.select("node", "first")


def unique_match(asked: DataFrame, named: DataFrame, name: str, scope: list[str], target: str) -> DataFrame:
    """Resolves names without regard to case: ``resolution`` exact with its ``target``, ambiguous or not_found. Null names aren't asked."""
    fold = F.lower(name).alias("__name")
    known = named.where(F.col(name).isNotNull()).select(*scope, fold, target).distinct().groupBy(*scope, "__name").agg(F.count("*").alias("matches"), F.min(target).alias("target"))
    out = asked.where(F.col(name).isNotNull()).withColumn("__name", F.lower(name)).join(known, [*scope, "__name"], "left")
    n = F.coalesce("matches", F.lit(0)).cast("bigint")
    label = F.when(n == 0, "not_found").when(n == 1, "exact").otherwise("ambiguous")
    return out.withColumn("resolution", label).withColumn("target", F.when(n == 1, F.col("target"))).withColumn("matches", n).drop("__name")


def ambiguous_names(named: DataFrame, name: str, scope: list[str], target: str) -> DataFrame:
    """Names of several targets within their scope, with at most 20 of them as examples."""
    fold = F.lower(name).alias("name")
    each = named.where(F.col(name).isNotNull()).select(*scope, fold, target).distinct()
    place = F.row_number().over(Window.partitionBy(*scope, "name").orderBy(target))
    few = each.withColumn("place", place).where(F.col("place") <= EXAMPLES)  # every task keeps its own first ones only
    examples = few.groupBy(*scope, "name").agg(F.sort_array(F.collect_list(target)).alias("examples"))
    counts = each.groupBy(*scope, "name").agg(F.count("*").alias("targets")).where("targets > 1")
    return counts.join(examples, [*scope, "name"]).select(*scope, "name", "targets", F.col("examples")[0].alias("first_target"), "examples")


def nearest_ancestor(paths: DataFrame, path: str, folders: DataFrame, folder: str) -> DataFrame:
    """For each path the deepest listed folder that encloses it, or null: prefixes are exploded and joined by equality."""
    parts = F.split(path, "/")
    depths = F.when(F.size(parts) > 1, F.sequence(F.lit(1), F.size(parts) - 1)).otherwise(F.array().cast("array<int>"))
    above = F.transform(depths, lambda i: F.struct(i.alias("depth"), F.array_join(F.slice(parts, F.lit(1), i), "/").alias("folder")))
    each = paths.select(path).distinct().select(path, F.explode_outer(above).alias("x")).select(path, "x.depth", F.col("x.folder").alias("folder"))
    listed = folders.select(F.col(folder).alias("folder")).distinct().withColumn("listed", F.lit(True))
    found = each.join(listed, "folder", "left")
    return found.groupBy(path).agg(F.max_by("folder", F.when(F.col("listed"), F.col("depth"))).alias("enclosing"))


def map_changes(changes: DataFrame, owners: DataFrame) -> DataFrame:
    """Maps changed files ``(path, old_path)`` to elements: by path, else by the old path, else by a unique name, else not at all."""
    by = owners.groupBy("path").agg(F.max("element").alias("element"))
    stem = F.regexp_replace(F.substring_index(F.col("path"), "/", -1), r"\.[^.]+$", "")
    by_stem = owners.select(stem.alias("stem"), "element").distinct().groupBy("stem").agg(F.count("*").alias("n"), F.min("element").alias("by_stem")).where("n = 1").drop("n")
    out = (
        changes.join(by.withColumnRenamed("element", "by_path"), "path", "left")
        .join(by.select(F.col("path").alias("old_path"), F.col("element").alias("by_old_path")), "old_path", "left")
        .withColumn("stem", stem)
        .join(by_stem, "stem", "left")
    )
    mapping = F.when(F.col("by_path").isNotNull(), "exact_owner").when(F.col("by_old_path").isNotNull(), "old_path_owner").when(F.col("by_stem").isNotNull(), "name_inference").otherwise("unmapped")
    return out.select("path", "old_path", F.coalesce("by_path", "by_old_path", "by_stem").alias("element"), mapping.alias("mapping"))


def valid_path(path: str) -> str:
    """A relative path with forward slashes; absolute ones, ``..``, NUL and empty ones are errors."""
    clean = path.replace("\\", "/")
    if not clean or "\0" in clean or clean.startswith("/") or ":" in clean.split("/")[0] or ".." in clean.split("/"):
        raise ValueError(f"not a relative path: {path!r}")
    return clean
