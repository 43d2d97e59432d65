from __future__ import annotations

import base64
import io
import json
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from corpusgraph.operators import corpus
from corpusgraph.sources import files as src
from corpusgraph.sources import sinks
from corpusgraph.streaming import events as streams


def put(root, path, content):
    target = root / path
    target.parent.mkdir(parents=True, exist_ok=True)
    target.write_bytes(content if isinstance(content, bytes) else content.encode())


def archive(**members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in members.items():
            z.writestr(name.replace("__", "/"), text)
    return out.getvalue()


def test_json_lines(spark, tmp_path):
    put(tmp_path, "a.jsonl", '{"a": 1}\n\n{"a": 2}\n')
    put(tmp_path, "bad.jsonl", '{"a": 1}\nnonsense\n')
    assert sorted(r.a for r in src.json_lines(spark, str(tmp_path / "a.jsonl"), "a int").collect()) == [1, 2]
    assert src.json_lines(spark, str(tmp_path / "none.jsonl"), "a int").collect() == []
    with pytest.raises(FileNotFoundError):
        src.json_lines(spark, str(tmp_path / "none.jsonl"), "a int", strict=True)
    with pytest.raises(Exception):
        src.json_lines(spark, str(tmp_path / "bad.jsonl"), "a int", strict=True).collect()


def test_trees_archives_and_inventories(spark, tmp_path):
    put(tmp_path, "docs/x/index.html", '<article><h1>Page</h1><p>Hi</p></article>')
    put(tmp_path, "docs/bad.txt", b"\xff\xfe")
    put(tmp_path, "docs/nul.txt", "a\0b")
    put(tmp_path, "docs/bom.md", "﻿# Guide\nx")
    put(tmp_path, ".hidden/y.txt", "no")
    put(tmp_path, "lib/a.jar", archive(**{"org__A.class": "x", "org__B.class": "y", "META-INF__MANIFEST.MF": "Name: v:1\r\n w\r\nOther: z\r\n"}))
    put(tmp_path, "lib/broken.jar", b"no archive")
    put(tmp_path, "Project.yaml", "Id: 1")
    all_files = src.binary_files(spark, str(tmp_path))
    rows = {r.path: r for r in src.file_inventory(all_files).collect()}
    assert rows["docs/x/index.html"].extension == ".html" and rows["docs/x/index.html"].top_directory == "docs" and len(rows) == 7  # Spark's file sources skip hidden names
    assert {r.path for r in src.walk_filter(all_files).select("path").collect()} == set(rows)
    assert {r.path: r.error for r in src.source_texts(all_files.where("path like 'docs/%'")).collect()} == {"docs/x/index.html": None, "docs/bad.txt": "not UTF-8", "docs/nul.txt": "binary", "docs/bom.md": None}
    page = src.html_pages(all_files.where("path like '%.html'"), "article").collect()[0]
    assert (page.route, page.title, page.text) == ("docs/x", "Page", "# Page\n\nHi\n")
    members = src.zip_members(all_files.where("path like '%.jar'"))
    assert [(r.member, r.error) for r in members.where("archive = 'lib/broken.jar'").collect()] == [(None, "BadZipFile")]
    assert [(r.package, r.classes, r.first_class) for r in src.archive_packages(members).collect()] == [("org", 2, "org/A.class")]
    manifest = members.where("member like '%MANIFEST.MF'").select(src.manifest_values(F.decode("content", "UTF-8")).alias("m")).collect()[0].m
    assert manifest == {"Name": "v:1w", "Other": "z"}
    assert [r.root for r in src.project_roots(all_files, ("Project.yaml",)).collect()] == [""]
    assert [r.title for r in src.guides(src.source_texts(all_files).select("path", F.encode("content", "UTF-8").alias("content"))).collect()] == ["Guide"]


def test_logs_are_windowed_and_redacted(spark, tmp_path):
    put(tmp_path, "server.log", "first a@b.co\nsecond password=x\n")
    put(tmp_path, "access.log", b"bad \xff byte\n")
    put(tmp_path, "clients.log", "a\0b")
    put(tmp_path, "random.txt", "x")
    put(tmp_path, "deep/server.log", "x")
    listed = src.logs(src.binary_files(spark, str(tmp_path)))
    assert [r.path for r in listed.select("path").collect()] == ["access.log", "clients.log", "server.log"]
    lines = {(r.path, r.line_no): r.line for r in src.log_window(listed).collect()}
    assert lines == {("server.log", 1): "first [EMAIL]", ("server.log", 2): "second password=[HIDDEN]", ("access.log", 1): "bad � byte"}
    short = src.log_window(listed.where("path = 'server.log'"), 20).collect()
    assert [r.line for r in short] == ["second password=[HIDDEN]"]


def test_bundles_and_source_maps(spark, tmp_path):
    spec = base64.b64encode(zlib.compress(json.dumps({"method": "get", "path": "/x"}).encode())).decode()
    put(tmp_path, "b.js", "x=JSON.parse('" + json.dumps({"api": spec, "title": "T"}) + "');y=JSON.parse('{\"a\":1}')")
    assert [(r.method, r.route, r.title) for r in src.api_bundles(src.binary_files(spark, str(tmp_path), "*.js")).collect()] == [("GET", "/x", "T")]
    put(tmp_path, "m.map", json.dumps({"sources": ["webpack://app/./src/a.ts", "webpack://app/node_modules/b.js", "c"], "sourcesContent": ["A", "B"]}))
    assert [(r.source, r.content) for r in src.source_maps(spark, str(tmp_path / "m.map")).collect()] == [("src/a.ts", "A")]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("a", 'T "q"', "# body")], "id string, title string, text string")
    assert sinks.markdown_with_front_matter(rows, ["id", "title"]).collect()[0].file == '---\nid: "a"\ntitle: "T \\"q\\""\n---\n\n# body'
    sinks.write_json_lines(rows, str(tmp_path / "j"))
    assert src.json_lines(spark, str(tmp_path / "j"), "id string").collect()[0].id == "a"
    docs = spark.createDataFrame([("i", "c", "1", "x")], "id string, corpus string, product_version string, text string")
    bad = spark.createDataFrame([("hashes", 1)], "check_name string, failures long")
    target = str(tmp_path / "published")
    path = sinks.publish(spark, {"documents": docs}, target)
    assert sinks.active(spark, target) == path and spark.read.parquet(f"{path}/documents.parquet").count() == 1
    with pytest.raises(ValueError):
        sinks.publish(spark, {"documents": docs}, target, bad)
    assert sinks.active(spark, target) == path
    entry = sinks.catalog_of(spark, {"documents": docs}, "c", "1").collect()[0]
    assert entry.id == "c.1.documents" and entry.records == 1 and len(entry.sha256) == 64


def test_validation_and_golden(spark):
    docs = spark.createDataFrame([("1", "x", "bad"), ("1", "", None), ("2", None, None)], "id string, text string, sha256 string")
    chunks = spark.createDataFrame([("c", "1", "t", None), ("d", "9", "t", None)], "id string, document_id string, text string, sha256 string")
    got = {r.check_name: r.failures for r in corpus.validation(docs, chunks).collect()}
    assert got == {"unique-document-ids": 1, "unique-chunk-ids": 0, "document-hashes": 1, "chunk-hashes": 0, "orphan-chunks": 1, "empty-documents": 2}
    actual = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    golden = spark.createDataFrame([("a", 1), ("b", 3), ("c", 4)], "k string, v int")
    assert sorted(r.k for r in corpus.golden_mismatches(actual, golden, "k", "v").collect()) == ["b", "c"]


def test_streams_agree_with_batches(spark, tmp_path):
    rows = [(1, "2024-01-01 10:05:00", "a", 1.0, 7), (2, "2024-01-01 10:55:00", "a", 2.0, 7), (3, "2024-01-01 12:00:00", "b", 3.0, 8), (3, "2024-01-01 12:00:00", "b", 3.0, 8)]
    df = spark.createDataFrame(rows, "event_id long, ts string, event_type string, value double, user_id long").withColumn("ts", F.to_timestamp_ntz("ts"))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    query = streams.counts_by_window(stream).writeStream.outputMode("complete").format("memory").queryName("windows").start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    key = lambda r: tuple(map(str, r))
    assert sorted(map(key, spark.table("windows").collect())) == sorted(map(key, streams.counts_by_window(df).collect()))
    assert streams.once(df).count() == 3 and {(r.user_id, r.n) for r in streams.sessions(df).collect()} == {(7, 1), (8, 2)}
