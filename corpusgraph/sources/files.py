"""File sources: lines of JSON, trees of pages, archives, inventories, logs."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corpusgraph.functions import html, text
from corpusgraph.operators.corpus import extension_of

#: Fixed bounds of a source file, of a log window and of a log listing; log names that may be read.
MAX_SOURCE_BYTES, LOG_WINDOW, MAX_LOGS = 2_000_000, 512 << 10, 100
LOG_NAME = r"(?i)^(?:launcher(?:_\d+)?|server|clients|unclosed_resources|debugger|access|console-executor)(?:[._-][A-Za-z0-9]+)*\.log(?:\.\d+)?$"


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def utf8(content: Column | str) -> Column:
    """Bytes as text, with the replacement character for what isn't UTF-8."""
    return F.make_valid_utf8(text.col(content).cast("string"))


def json_lines(spark: SparkSession, path: str, schema: StructType | str, strict: bool = False) -> DataFrame:
    """Rows of a file with one JSON object a line; blank lines are skipped. A missing file is empty, or an error if ``strict``, as is bad JSON."""
    if not _exists(spark, path):
        if strict:
            raise FileNotFoundError(path)
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "PERMISSIVE").json(path)


def binary_files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """Files below ``root`` as ``(path, bytes, content)``, the path being relative. Spark skips names that begin with a dot or an underscore."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/").removeprefix("file://")
    return raw.select(F.regexp_replace(F.regexp_replace("path", r"^file:(//)?", ""), "^" + re.escape(base) + "/", "").alias("path"), F.col("length").alias("bytes"), "content")


def file_inventory(files: DataFrame) -> DataFrame:
    """Path, size, extension, top directory and hash of every file."""
    return files.select("path", "bytes", extension_of(F.col("path")).alias("extension"), F.substring_index("path", "/", 1).alias("top_directory"), F.sha2("content", 256).alias("sha256"))


def source_texts(files: DataFrame, limit: int = MAX_SOURCE_BYTES) -> DataFrame:
    """Text files ``(path, content)`` within the size, and those that aren't with the reason in ``error``."""
    decoded = F.try_validate_utf8("content")
    plain = F.regexp_replace(decoded, r"^\x{FEFF}", "")
    error = F.when(F.col("bytes") > limit, "too large").when(decoded.isNull(), "not UTF-8").when(F.contains(decoded, F.lit("\0")), "binary")
    return files.select("path", F.when(error.isNull(), plain).alias("content"), error.alias("error"))


def walk_filter(files: DataFrame, ignored: tuple[str, ...] = ("node_modules", "build", "dist")) -> DataFrame:
    """Leaves out hidden files and folders, and those with an ignored name."""
    names = "|".join(map(re.escape, ignored))
    return files.where(~F.col("path").rlike(rf"(^|/)(\.|({names})/)"))


def project_roots(files: DataFrame, manifests: tuple[str, ...]) -> DataFrame:
    """Folders that hold a root manifest."""
    return files.where(F.substring_index("path", "/", -1).isin(list(manifests))).select(F.regexp_replace("path", r"/?[^/]*$", "").alias("root")).distinct()


def html_pages(files: DataFrame, tag: str = "div", css: str | None = None) -> DataFrame:
    """Pages as documents: Markdown text, title (or the folder's name), route, address and modification time."""
    parsed = files.withColumn("page", html.page_column(utf8("content"), tag, css))
    folder = F.element_at(F.split("path", "/"), -2)
    return parsed.select("path", text.route("path").alias("route"), "page.text", F.coalesce("page.title", F.when(F.contains("path", F.lit("/")), folder), F.lit("")).alias("title"), "page.source_uri", "page.modified")


def zip_members(files: DataFrame, prefix: str = "", most: int = 64 << 20) -> DataFrame:
    """Members of archives ``(archive, member, bytes, content, error)`` in order; an unreadable archive gives one row with its error.

    A member over ``most`` bytes is listed without content and with an error.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as archive:
                        for info in sorted(archive.infolist(), key=lambda i: i.filename):
                            if info.is_dir() or not info.filename.startswith(prefix):
                                continue
                            big = info.file_size > most
                            yield pd.DataFrame({"archive": [path], "member": [info.filename], "bytes": [info.file_size], "content": [None if big else archive.read(info)], "error": ["too large" if big else None]})
                except Exception as e:  # noqa: BLE001
                    yield pd.DataFrame({"archive": [path], "member": [None], "bytes": [None], "content": [None], "error": [type(e).__name__]})

    return files.select("path", "content").mapInPandas(run, "archive string, member string, bytes bigint, content binary, error string")


def archive_packages(members: DataFrame) -> DataFrame:
    """Classes by package in each archive, with the first of them as a sample."""
    classes = members.where(F.col("member").endswith(".class") & ~F.contains("member", F.lit("META-INF/")))
    package = F.regexp_replace(F.regexp_replace("member", r"/?[^/]*$", ""), "/", ".")
    return classes.groupBy("archive", package.alias("package")).agg(F.count("*").alias("classes"), F.min("member").alias("first_class"))


def manifest_values(content: Column) -> Column:
    """An archive's manifest as a map: continuation lines unfolded, each line split at its first colon."""
    lines = F.filter(F.split(F.regexp_replace(content, "\r?\n ", ""), "\r?\n"), lambda line: F.contains(line, F.lit(":")))
    pairs = F.transform(lines, lambda line: F.struct(F.trim(F.substring_index(line, ":", 1)).alias("k"), F.trim(F.regexp_replace(line, "^[^:]*:", "")).alias("v")))
    first = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, F.lit(1), i), lambda q: q["k"] == p["k"]))
    return F.map_from_entries(first)


def source_maps(spark: SparkSession, path: str) -> DataFrame:
    """Original sources in source maps: dependency folders and loader code left out, address prefixes cut."""
    raw = spark.read.schema("sources array<string>, sourcesContent array<string>").option("multiLine", "true").json(path)
    pairs = raw.select(F.explode(F.arrays_zip("sources", "sourcesContent")).alias("x")).select(F.col("x.sources").alias("source"), F.col("x.sourcesContent").alias("content"))
    kept = pairs.where(F.col("content").isNotNull() & ~F.col("source").rlike(r"node_modules|webpack/(runtime|bootstrap)|^external "))
    return kept.select(F.regexp_replace("source", r"^[a-z]+://[^/]*/(\./)?", "").alias("source"), "content")


def guides(files: DataFrame) -> DataFrame:
    """Markdown guides with their title: the first heading of level one, else the file's stem."""
    content = utf8("content")
    title = F.regexp_extract(content, r"(?m)^#\s+(.+)$", 1)
    stem = F.regexp_replace(F.substring_index("path", "/", -1), r"\.[^.]+$", "")
    return files.where(F.lower("path").endswith(".md")).select("path", F.when(title == "", stem).otherwise(F.trim(title)).alias("title"), content.alias("text"))


def logs(files: DataFrame) -> DataFrame:
    """Direct log files with an allowed name, at most 100 (the feature of the listing), by name."""
    return files.where(~F.contains("path", F.lit("/")) & F.col("path").rlike(LOG_NAME)).orderBy(F.lower("path")).limit(MAX_LOGS)


def log_window(files: DataFrame, window: int = LOG_WINDOW) -> DataFrame:
    """The last bytes of each log as redacted lines: ``(path, line_no, line)``; a NUL makes it binary, without lines.

    Bytes that aren't UTF-8 become the replacement character. A window that starts inside the file drops its first, partial line.
    """
    part = F.expr(f"substring(content, greatest(1, length(content) - {int(window)} + 1))")
    decoded = utf8(part)
    cut = F.when(F.col("bytes") > window, F.regexp_replace(decoded, r"(?s)^[^\n]*\n", "")).otherwise(decoded)
    shown = files.where(~F.contains(decoded, F.lit("\0")))
    return shown.select("path", F.posexplode(F.split(F.regexp_replace(cut, r"\r?\n$", ""), r"\r?\n")).alias("at", "line")).select("path", (F.col("at") + 1).alias("line_no"), text.redact("line").alias("line"))


def api_bundles(files: DataFrame) -> DataFrame:
    """API operations ``(path, method, route, title)`` in script bundles: embedded, compressed specifications in ``JSON.parse('…')``.

    A script may hold several. Of specifications with one method and route the last file counts.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import base64
        import json
        import zlib

        for batch in batches:
            rows = []
            for path, script in zip(batch["path"], batch["script"]):
                for literal in re.findall(r"JSON\.parse\('((?:[^'\\]|\\.)*)'\)", script or ""):
                    try:
                        value = json.loads(literal.replace("\\'", "'").replace("\\\\", "\\"))
                        spec = json.loads(zlib.decompress(base64.b64decode(value["api"])))
                    except (ValueError, KeyError, TypeError, zlib.error):
                        continue
                    rows.append((path, str(spec.get("method", "")).upper(), spec.get("path"), value.get("title")))
            yield pd.DataFrame(rows, columns=["path", "method", "route", "title"])

    found = files.select("path", utf8("content").alias("script")).mapInPandas(run, "path string, method string, route string, title string")
    return found.groupBy("method", "route").agg(F.max_by(F.struct("path", "title"), "path").alias("x")).select("x.path", "method", "route", "x.title")
