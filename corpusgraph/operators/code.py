"""Code intelligence over source files ``(path, content)``: code spans, declarations, references, elements, facts.

The one stateful step, telling code from comments and strings, blanks everything else in an Arrow function; what follows are
regular expressions and joins in the JVM.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusgraph.functions import text

#: Fixed values of the languages: modifiers and keywords of declarations, with the kind each stands for.
MODIFIERS = "static|abstract|async|export|override|статический|абстрактный|асинх|экспорт|переопределение"
KINDS = {
    "method": "method", "метод": "method", "structure": "structure", "структура": "structure",
    "enum": "enumeration", "перечисление": "enumeration", "exception": "exception", "исключение": "exception",
}
TYPE_KINDS = ["structure", "enumeration", "exception"]
DECLARATION = rf"(?iU)^(\s*(?:(?:{MODIFIERS})\s+)*)({'|'.join(KINDS)})(\s+)([^\W\d]\w*)"
IDENTIFIER = r"(?U)[^\W\d]\w*"
IMPORT = r"(?iU)^(\s*(?:import|импорт)\s+)([^\s;/]+)"
SCALAR = r"^(\s*)([^\s:#][^:]*):(?:\s*(.*))?$"
KIND_KEYS = ["ElementKind", "ВидЭлемента"]
MANIFEST_KINDS = {"Project.yaml": "Project", "Проект.yaml": "Project", "Subsystem.yaml": "Subsystem", "Подсистема.yaml": "Subsystem", "Resources.yaml": "Resources", "Ресурсы.yaml": "Resources"}
EXTERNAL_ROOTS = ["std", "стд", "system", "система"]

_TOKEN = re.compile(r"//[^\n]*|/\*|\*/|\\.|\\\n|[$%]\{|[\"{}\n]", re.S)


def blank_non_code(source: str) -> str:
    """The source with comments and strings blanked, line ends and columns kept.

    Strings run over lines and take escapes; ``${`` and ``%{`` inside them return to code, with braces counted and inner strings
    blanked. In an interpolation a line comment hides the rest of its line.
    """
    out: list[str] = []
    state, depth, at = "code", 0, 0  # code, comment, string, inner (string in an interpolation)

    def put(part: str, code: bool) -> None:
        out.append(part if code else "".join("\n" if c == "\n" else " " for c in part))

    below = "code"
    for m in _TOKEN.finditer(source):
        if m.start() < at:
            continue
        mark, code = m[0], state == "code"
        put(source[at : m.start()], code)
        at = m.end()
        if state == "comment":
            put(mark, False)
            state = below if mark == "*/" else state
            continue
        if code and mark.startswith("//"):
            put(mark, False)
        elif mark.startswith("//"):
            at = m.start() + 1  # slashes inside a string are nothing special
            put("/", False)
        elif code and mark == "/*":
            put(mark, False)
            state, below = "comment", "code"
        elif mark == '"':
            put(mark, False)
            state = {"code": "inner" if depth else "string", "string": "code", "inner": "code"}[state]
            if state == "code" and depth == 0:
                below = "code"
        elif state == "string" and mark[0] in "$%" and mark.endswith("{"):
            put(mark, False)
            state, depth = "code", 1
        elif code and depth and mark.endswith("{"):
            put(mark, True)
            depth += 1
        elif code and depth and mark == "}":
            put(mark, False)
            depth -= 1
            state = "code" if depth else "string"
        elif code and mark[0] == "\\":
            at = m.start() + 1
            put("\\", True)
        else:
            put(mark, code)
    put(source[at:], state == "code")
    return "".join(out)


@F.pandas_udf(T.StringType())
def code_only(source: pd.Series) -> pd.Series:
    return source.map(lambda s: None if s is None else blank_non_code(s))


def fenced_code(text: Column) -> Column:
    """The code blocks of a Markdown text, without their fences."""
    return F.regexp_extract_all(text, F.lit(r"(?ms)^```[^\n]*\n(.*?)^```"), F.lit(1))


def code_lines(files: DataFrame, key: str, content: str = "content", mask: bool = True) -> DataFrame:
    """Lines ``(key, line_no, line, code)`` where ``code`` has what isn't code blanked."""
    prepared = files.where(F.col(content).isNotNull()).withColumn("__code", code_only(content) if mask else F.col(content))
    pairs = F.arrays_zip(F.split(content, "\n").alias("line"), F.split("__code", "\n").alias("code"))
    return prepared.select(key, F.posexplode(pairs).alias("at", "x")).select(key, (F.col("at") + 1).alias("line_no"), F.col("x.line").alias("line"), F.col("x.code").alias("code"))


def declarations(lines: DataFrame, key: str) -> DataFrame:
    """Declarations ``(key, symbol_id, name, symbol_kind, line_no, column_no, text)`` in code lines."""
    part = lambda i: F.regexp_extract("code", DECLARATION, i)
    kinds = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])
    found = lines.where(F.col("code").rlike(DECLARATION)).select(key, "line_no", "line", part(1).alias("a"), part(2).alias("word"), part(3).alias("b"), part(4).alias("name"))
    column = (F.length("a") + F.length("word") + F.length("b") + 1).alias("column_no")
    kind = kinds[F.lower("word")]
    return found.select(key, text.stable_id("symbol", F.col(key), F.col("name"), kind, F.col("line_no")).alias("symbol_id"), "name", kind.alias("symbol_kind"), "line_no", column, text.compact_line(F.trim("line")).alias("text"))


def lookup(symbols: DataFrame, name: str, exact: bool = True, kind: str = "all") -> DataFrame:
    """Symbols by name without regard to case, exact names first; ``resolution`` tells how many there are: exact or ambiguous."""
    n = name.lower()
    hit = F.lower("name") == n if exact else F.contains(F.lower("name"), F.lit(n))
    kinds = {"all": F.lit(True), "type": F.col("symbol_kind").isin(TYPE_KINDS)}.get(kind, F.col("symbol_kind") == kind)
    found = symbols.where(hit & kinds)
    total = found.agg(F.count("*").alias("total"))
    label = F.when(F.col("total") == 1, "exact").otherwise("ambiguous")
    return found.crossJoin(total).withColumn("resolution", label).orderBy((F.lower("name") == n).desc(), "line_no")


def references(lines: DataFrame, key: str, name: str, symbols: DataFrame) -> DataFrame:
    """Occurrences of an identifier in code, at identifier boundaries; those that declare it have the role declaration."""
    quoted = re.escape(name)
    near = lines.where(F.contains("code", F.lit(name)))
    edge = rf"(?U)(?<![\w]){quoted}(?![\w])"
    pieces = F.split("code", edge, -1)
    # the place of each occurrence: the lengths of the pieces before it and of the names between them
    at = F.transform(F.sequence(F.lit(1), F.size("p") - 1), lambda i: F.aggregate(F.slice("p", F.lit(1), i), F.lit(0), lambda a, x: a + F.length(x)) + (i - 1) * len(name) + 1)
    found = near.withColumn("p", pieces).where(F.size("p") > 1).select(key, "line_no", F.explode(at).alias("column_no"))
    declared = symbols.where(F.col("name") == name).select(key, "line_no", "column_no", F.lit(True).alias("declared"))
    return found.join(declared, [key, "line_no", "column_no"], "left").select(key, "line_no", "column_no", F.when(F.col("declared"), "declaration").otherwise("reference").alias("role"))


def identifiers(lines: DataFrame, key: str) -> DataFrame:
    """Identifiers of each file: first line and how often, without regard to case."""
    each = lines.select(key, "line_no", F.explode(F.regexp_extract_all("code", F.lit(IDENTIFIER), F.lit(0))).alias("name"))
    return each.groupBy(key, F.lower("name").alias("value")).agg(F.min("line_no").alias("line_no"), F.count("*").alias("n"))


def top_level_values(content: Column) -> Column:
    """Unindented ``key: value`` lines of a YAML text as a map, quotes removed, empty values left out, the last one of a key winning."""
    lines = F.filter(F.split(content, "\r?\n"), lambda line: line.rlike(r"^[^\s#:][^:]*:\s*\S"))
    pairs = F.transform(lines, lambda line: F.struct(F.trim(F.regexp_extract(line, r"^([^:]+):", 1)).alias("k"), F.regexp_replace(F.trim(F.regexp_extract(line, r"^[^:]+:\s*(.*)$", 1)), r"^(['\"])(.*)\1$", "$2").alias("v")))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.greatest(F.size(pairs), F.lit(1))), lambda q: q["k"] == p["k"]))
    return F.map_from_entries(last)


def elements(files: DataFrame) -> DataFrame:
    """Metadata elements of a project: YAML files that are manifests or name a kind, with their companion sources.

    Companions lie in the same folder and share the stem, or their names start with it and a dot. ``subsystem`` is the nearest
    enclosing folder with a subsystem manifest.
    """
    from corpusgraph.operators.graph import nearest_ancestor

    name = F.substring_index("path", "/", -1)
    folder = F.when(F.contains("path", F.lit("/")), F.regexp_replace("path", "/[^/]*$", "")).otherwise(F.lit(""))
    known = files.withColumn("file", name).withColumn("folder", folder)
    yaml = known.where(F.lower("file").rlike(r"\.ya?ml$")).withColumn("values", top_level_values(F.col("content")))
    manifest = F.element_at(F.create_map(*[F.lit(x) for pair in MANIFEST_KINDS.items() for x in pair]), F.col("file"))
    kind = F.coalesce(manifest, *[F.try_element_at("values", F.lit(k)) for k in KIND_KEYS])
    own = F.coalesce(F.try_element_at("values", F.lit("Name")), F.try_element_at("values", F.lit("Имя")), F.substring_index("folder", "/", -1))
    stem = F.regexp_replace("file", r"\.[^.]+$", "")
    made = yaml.withColumn("element_kind", kind).where(F.col("element_kind").isNotNull()).select(own.alias("name"), "element_kind", F.try_element_at("values", F.lit("Id")).alias("element_id"), "folder", stem.alias("stem"), F.col("path").alias("metadata_path"))
    sources = known.where(~F.lower("file").rlike(r"\.ya?ml$")).select("folder", F.col("path").alias("source"), "file", F.explode(_stems(F.col("file"))).alias("stem"))
    own_sources = made.join(sources, ["folder", "stem"]).groupBy("metadata_path").agg(F.sort_array(F.collect_set("source")).alias("implementation_files"))
    subsystems = yaml.where(F.col("file").isin("Subsystem.yaml", "Подсистема.yaml")).select(F.col("folder").alias("subsystem_folder"))
    inside = nearest_ancestor(made.select("metadata_path"), "metadata_path", subsystems, "subsystem_folder")
    return (
        made.join(own_sources, "metadata_path", "left")
        .join(inside, "metadata_path", "left")
        .select("name", "element_kind", "element_id", F.substring_index("enclosing", "/", -1).alias("subsystem"), "metadata_path", F.coalesce("implementation_files", F.array().cast("array<string>")).alias("implementation_files"))
    )


def _stems(file: Column) -> Column:
    """Every leading part of a file name up to a dot: the stems whose companion it is."""
    parts = F.split(file, r"\.")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(parts) - 1)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "."))


def _listed_uses(meta: DataFrame) -> DataFrame:
    """Items of the lists below a ``Using`` key: indented deeper than the key and before the next line that isn't."""
    indent = F.length(F.regexp_extract("line", r"^(\s*)", 1))
    key = F.lower(F.regexp_extract("line", r"^\s*([^\s:#]+):\s*$", 1)).isin("using", "использование")
    by_file = Window.partitionBy("path").orderBy("line_no")  # a file's own lines
    kept = meta.where(F.trim("line") != "").withColumn("indent", indent).withColumn("key", key)
    started = kept.withColumn("at", F.last(F.when(F.col("key") | F.col("line").rlike(SCALAR), F.struct("key", "indent")), True).over(by_file))
    item = F.regexp_extract("line", r"^\s*-\s*([^#]+?)\s*$", 1)
    value = F.regexp_replace(item, r"^(['\"])(.*)\1$", "$2")
    return started.where(F.col("at.key") & ~F.col("key") & (F.col("indent") > F.col("at.indent"))).withColumn("value", value).where("value <> ''")


def facts(files: DataFrame) -> DataFrame:
    """Facts of files in long form: ``(path, fact_type, value, line_no)``: imports, declarations, handlers, types, used subsystems, UUIDs and identifiers."""
    code = code_lines(files.where(~F.lower("path").rlike(r"\.ya?ml$")), "path")
    meta = code_lines(files.where(F.lower("path").rlike(r"\.ya?ml$")), "path", mask=False)
    imported = code.where(F.col("code").rlike(IMPORT)).select("path", F.lit("import").alias("fact_type"), F.regexp_extract("code", IMPORT, 2).alias("value"), "line_no")
    declared = declarations(code, "path").select("path", F.lit("declaration").alias("fact_type"), F.col("name").alias("value"), "line_no")
    keyed = meta.where(F.col("line").rlike(SCALAR)).select("path", F.lower(F.trim(F.regexp_extract("line", SCALAR, 2))).alias("key"), F.regexp_replace(F.trim(F.regexp_extract("line", SCALAR, 3)), r"^(['\"])(.*)\1$", "$2").alias("value"), "line_no").where("value <> ''")
    handlers = keyed.where(F.col("key").isin("handler", "обработчик")).select("path", F.lit("handler").alias("fact_type"), "value", "line_no")
    types = keyed.where(F.col("key").isin("type", "тип")).select("path", F.lit("type").alias("fact_type"), F.explode(F.regexp_extract_all("value", F.lit(r"(?U)[^\W\d]\w*(?:(?:::|\.)[^\W\d]\w*)*"), F.lit(0))).alias("value"), "line_no")
    uses = _listed_uses(meta).select("path", F.lit("using").alias("fact_type"), "value", "line_no")
    ids = meta.select("path", F.lit("uuid").alias("fact_type"), F.explode(text.uuids("line")).alias("value"), "line_no")
    names = identifiers(code, "path").select("path", F.lit("identifier").alias("fact_type"), "value", "line_no")
    out = imported
    for df in (declared, handlers, types, uses, ids, names):
        out = out.unionByName(df)
    return out
