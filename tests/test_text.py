from __future__ import annotations

import hashlib
import re
import time
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusgraph.functions import html, markdown, text

from corpusgraph.operators import code, corpus, datasets, diagnostics, features, graph, index, project, search
from corpusgraph.plans.lineage import cut, shared_dir


def one(spark, expression, value):
    return spark.createDataFrame([(value,)], "x string").select(expression.alias("y")).collect()[0].y


@pytest.mark.parametrize(
    "expression, value, want",
    [
        (lambda: text.slug("x"), "  Ёлка & Co./v1.2 -- x!", "ёлка-co./v1.2-x"),
        (lambda: text.slug("x"), "!!!", "document"),
        (lambda: text.route("x"), "a/b/index.html", "a/b"),
        (lambda: text.route("x"), "index.html", "index"),
        (lambda: text.route("x"), "/a/b.html", "a/b"),
        (lambda: text.tokens("x"), "Café a::B x", ["caf", "a::b"]),
        (lambda: text.token_parts("x"), "foo_bar12::x", ["foo", "bar", "12"]),
        (lambda: text.clean_characters("x"), "a\r\nb\rc\u00a0d\u200b\u0000e  \nf", "a\nb\nc de\nf"),
        (lambda: text.last_name("x"), "a::B.C[]?", "C"),
        (lambda: text.version_key("x"), "4.10.3-5", [4, 10, 3, 5]),
        (lambda: text.links("x"), "[a](b#c) ![i](img.png) [x](#y)", ["b", "img.png", ""]),
        (lambda: text.join_route("x", F.lit("/b//c")), "a/", "a/b/c"),
        (lambda: text.compact_line("x", 5), "abcdefg", "abcd…"),
        (lambda: text.utf16_offset("x", F.lit(3)), "😀ab", 3),
        (lambda: text.pseudonym("x"), "u1", "[USER:" + hashlib.sha256(b"u1").hexdigest()[:10] + "]"),
        (lambda: text.imports("x"), "import a.b\nx\n  import c;", ["a.b", "c"]),
    ],
)
def test_text_functions(spark, expression, value, want):
    assert one(spark, expression(), value) == want
    one(spark, expression(), None)


def test_snippets_cut_at_words(spark):
    assert one(spark, text.snippet("x", 10), "aaa  bbb cccc ddd") == "aaa bbb…"
    assert one(spark, text.snippet("x", 10), "a" * 30) == "a" * 10 + "…"


def test_redaction_order_and_cut(spark):
    u = "[USER:" + hashlib.sha256(b"me").hexdigest()[:10] + "]"
    assert one(spark, text.redact("x"), "Bearer abc.def password=x,y mail a.b@c.de userId: me; userId=me") == f"Bearer [HIDDEN] password=[HIDDEN],y mail [EMAIL] userId: {u}; userId={u}"
    assert one(spark, text.redact("x", 7), "a@b.co 12345") == "[EMAIL]"


def test_instants_need_a_zone(spark):
    got = spark.createDataFrame([("2024-01-01T10:00:00+02:00",), ("2024-01-01T10:00:00",)], "x string").select(text.instant("x").cast("long").alias("y")).collect()
    assert [r.y for r in got] == [1704096000, None]


def test_markdown_keeps_fences():
    assert markdown.collapse_blanks("\n\na\n\n\nb\n```\nx\n\n\ny\n```\n\n\n") == "a\n\nb\n```\nx\n\n\ny\n```\n"


def test_chunks_pack_merge_and_split():
    made = markdown.chunk("pre\n\n# A\n\n" + "x" * 1000 + "\n\n" + "y" * 1000 + "\n\n```\n# no heading\n```\n# A\nshort", "T")
    assert [c["section"] for c in made] == ["T", "A", "A"]
    assert made[2]["text"].endswith("# no heading\n```\n\n# A\nshort")
    long = "\n".join(f"line {i} " + "z" * 90 for i in range(60))
    parts = markdown.slices(f"```py\n{long}\n```")
    assert all(p.startswith("```py\n") and p.endswith("\n```") for p in parts) and len(parts) > 3
    a, b = parts[0].split("\n")[1:-1], parts[1].split("\n")[1:-1]
    assert a[-3:] == b[:3]
    assert markdown.slices("w" * 4000)[0] == "w" * 1800
    assert markdown.chunk("", "T") == []


def test_html_to_markdown():
    page = (
        '<head><link rel="canonical" href="u"></head><nav>no</nav><div class="doc x"><h1>Title</h1><p>a <b>b</b> , c <a href="#f">d</a> <a href="t.html">e</a>'
        "<time datetime='2024'></time><script>s</script></p><ul><li>one<ol><li>two</li></ol></li></ul><pre>x  y\n</pre><table><tr><th>k</th><td>v</td></tr></table><img alt='i' src='s.png'></div><p>out</p>"
    )
    got = html.to_markdown(page, "div", "doc")
    assert got["title"] == "Title" and got["source_uri"] == "u" and got["modified"] == "2024"
    assert got["text"] == "# Title\n\na b, c d [e](t.html)\n\n- one\n  1. two\n\n```\nx  y\n```\n\n| k | v |\n![i](s.png)\n"


def test_code_is_told_from_comments_and_strings():
    source = 'a // b\n"s /* t" c /* d\ne */ f "x ${g + "h" + {i}} j" k\n"l\nm" n'
    got = code.blank_non_code(source)
    assert [len(x) for x in got.split("\n")] == [len(x) for x in source.split("\n")]
    assert got.split() == ["a", "c", "f", "g", "+", "+", "{i", "k", "n"]


@pytest.fixture(scope="module")
def files(spark):
    rows = [
        ("Project.yaml", "Id: p\nName: Demo\n"),
        ("Sales/Subsystem.yaml", "Name: Sales\n"),
        ("Sales/Orders.yaml", "ElementKind: CommonModule\nName: Orders\nId: 6d6ee9ba-6b8b-4b7a-9a2e-0c9b3f0f1a11\nHandler: OnOpen\nType: OrderDto\n"),
        ("Sales/Orders.xbsl", "import OrderDto\nexport method OnOpen(): Orders\n// Orders\nval x = \"Orders\"\nOrderDto Other\n"),
        ("Sales/OrderDto.yaml", "ElementKind: Structure\nName: OrderDto\nRef: 6d6ee9ba-6b8b-4b7a-9a2e-0c9b3f0f1a11\n"),
    ]
    return spark.createDataFrame(rows, "path string, content string")


def test_elements_declarations_and_references(spark, files):
    got = {r.metadata_path: (r.name, r.element_kind, r.subsystem, r.implementation_files) for r in code.elements(files).collect()}
    assert got["Sales/Orders.yaml"] == ("Orders", "CommonModule", "Sales", ["Sales/Orders.xbsl"])
    assert got["Project.yaml"][1] == "Project" and got["Project.yaml"][2] is None
    lines = code.code_lines(files.where("path like '%.xbsl'"), "path")
    found = code.declarations(lines, "path")
    assert [(r.name, r.symbol_kind, r.line_no, r.column_no) for r in found.collect()] == [("OnOpen", "method", 2, 15)]
    roles = sorted((r.line_no, r.column_no, r.role) for r in code.references(lines, "path", "OnOpen", found).unionByName(code.references(lines, "path", "Orders", found)).collect())
    assert roles == [(2, 15, "declaration"), (2, 25, "reference")]
    assert code.lookup(found, "onopen").collect()[0].resolution == "exact"


def test_the_project_graph(spark, files):
    extra = [
        ("Sales/OrderDto.xbsl", "import Sales::Orders\nimport Nowhere\nimport std::x\nmethod Twice()\n"),
        ("Using.yaml", "ElementKind: Part\nName: orders\nUsing:\n  - Sales\n  - 'Gone'\nHandler: Twice\nOther: 1\n"),
        ("Lost.yaml", "ElementKind: Part\nName: Lost\nHandler: Missing\nId: 6D6EE9BA-6b8b-4b7a-9a2e-0c9b3f0f1a11\n"),
        ("Alone.xbql", "x\n"),
    ]
    all_files = files.unionByName(spark.createDataFrame(extra, files.schema))
    elements, facts = (cut(df(all_files)) for df in (code.elements, code.facts))
    edges, issues = cut(project.edges(elements, facts)), cut(project.issues(elements, facts))
    name = {r.id: r.path or r.name for r in project.nodes(elements, facts).collect()}
    got = {(name[r.source], name[r.target], r.type, r.confidence) for r in edges.where(F.col("type").isin(graph.DEPENDENCY)).collect()}
    o, d, u, lost = "Sales/Orders.yaml", "Sales/OrderDto.yaml", "Using.yaml", "Lost.yaml"
    kinds = {(a, b, t) for a, b, t, _ in got}
    assert {(o, d, "yaml_type_reference"), (d, "Sales", "imports_subsystem"), (u, "Sales", "uses_subsystem"), (o, "Sales/Orders.xbsl", "yaml_handler"), (u, "Sales/OrderDto.xbsl", "yaml_handler")} <= kinds
    found = {(r.code, r.path, r.value) for r in issues.collect()}
    assert found == {
        ("duplicate_element_id", o, "6d6ee9ba-6b8b-4b7a-9a2e-0c9b3f0f1a11"), ("ambiguous_element_name", o, "orders"), ("orphan_source_file", "Alone.xbql", None),
        ("unresolved_import", "Sales/OrderDto.xbsl", "Nowhere"), ("unresolved_import", "Sales/Orders.xbsl", "OrderDto"), ("unresolved_import", u, "Gone"), ("missing_handler", lost, "Missing"),
    }
    assert project.structure_status(issues).collect()[0].status == "invalid"
    assert [r.name for r in project.unused(elements, edges).select("name").orderBy("name").collect()][-1] == "orders"
    assert project.select_element(elements, "ORDERS").collect()[0].resolution == "selection_required"
    assert [r.name for r in project.list_elements(elements, kind="structure", search="dto").collect()] == ["OrderDto"]
    summary = {r.subsystem: r for r in project.subsystem_summary(elements, facts).collect()}
    assert summary["Sales"].elements == 3 and summary["Sales"].methods == 2 and summary["Unknown"].kinds["Part"] == 2
    page = project.nodes(elements, facts).where("type = 'element'").select("id")
    assert {r.type for r in project.dependency_page(edges, page).collect()} == {"yaml_type_reference", "yaml_id_reference"}
    assert {r.element_kind: r.with_sources for r in project.overview(elements).collect()}["CommonModule"] == 1


def test_incremental_facts(spark):
    files = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "path string, sha256 string")
    cached = spark.createDataFrame([("a", "1"), ("b", "0"), ("d", "4")], "path string, sha256 string")
    fresh, gone = project.changed_files(files, cached)
    assert sorted(r.path for r in fresh.collect()) == ["b", "c"] and [r.path for r in gone.collect()] == ["d"]


def test_walks_cycles_and_matches(spark):
    ring = [(f"n{i:03}", f"n{(i + 1) % 40:03}") for i in range(40)] + [("in", "n000"), ("n005", "out"), ("x", "y"), ("y", "x"), ("s", "s"), (None, "x")]
    edges = spark.createDataFrame(ring, "source string, target string")
    got = {(r.component, r.members) for r in graph.cycle_members(edges).collect()}
    assert got == {("n000", 40), ("x", 2)}
    starts = spark.createDataFrame([("n003",)], "node string")
    walked = {r.node: r.level for r in graph.walk(edges, starts, 3).collect()}
    assert walked == {"n003": 0, "n004": 1, "n005": 2, "n006": 3, "out": 3}
    assert {r.node for r in graph.impact(edges, starts, 2).collect()} == {"n002", "n001"}
    assert graph.limited_walk(edges, starts, 3, 2).collect()[0].truncated
    with pytest.raises(ValueError):
        graph.walk(edges, starts, 6)
    assert graph.cycle_members(edges.where("source = 'in'")).collect() == []


def test_long_rings_and_paths(spark):
    """Names go up along one ring and down along the other, a path of the same length has no cycle."""
    n = 2500
    rows = [(f"a{i:05}", f"a{(i + 1) % n:05}") for i in range(n)] + [(f"b{(i + 1) % n:05}", f"b{i:05}") for i in range(n)] + [(f"c{i:05}", f"c{i + 1:05}") for i in range(n)]
    rows += [("a00007", "b00009"), ("c00100", "a00000"), ("b00000", "c00200")]
    began = time.time()
    got = {(r.component, r.members) for r in graph.cycle_members(spark.createDataFrame(rows, "source string, target string")).select("component", "members").distinct().collect()}
    assert got == {("a00000", n), ("b00000", n)}
    assert time.time() - began < 60


def test_components_agree_with_a_plain_search(spark):
    rng = np.random.default_rng(8)
    rows = sorted({(f"n{a}", f"n{b}") for a, b in rng.integers(0, 60, (70, 2))})
    reach = {f"n{i}": {b for a, b in rows if a == f"n{i}"} for i in range(60)}
    for _ in range(60):
        reach = {a: bs | {c for b in bs for c in reach[b]} for a, bs in reach.items()}
    want = {(a, min(b for b in bs if a in reach[b]), sum(a in reach[b] for b in bs)) for a, bs in reach.items() if a in bs and sum(a in reach[b] for b in bs) > 1}
    edges = spark.createDataFrame(rows, "source string, target string")
    assert {tuple(r) for r in graph.cycle_members(edges).collect()} == want
    assert {tuple(r) for r in graph.cycle_members(edges, few=0).collect()} == want


def test_unique_match_and_paths(spark):
    named = spark.createDataFrame([("A", "1"), ("a", "2"), ("b", "3"), (None, "4")], "name string, id string")
    asked = spark.createDataFrame([("a",), ("B",), ("c",), (None,)], "name string")
    got = {r.name: (r.resolution, r.target) for r in graph.unique_match(asked, named, "name", [], "id").collect()}
    assert got == {"a": ("ambiguous", None), "B": ("exact", "3"), "c": ("not_found", None)}
    paths = spark.createDataFrame([("a/b/c/x",), ("a/y",), ("z",)], "p string")
    folders = spark.createDataFrame([("a",), ("a/b",)], "f string")
    assert {r.p: r.enclosing for r in graph.nearest_ancestor(paths, "p", folders, "f").collect()} == {"a/b/c/x": "a/b", "a/y": "a", "z": None}
    changes = spark.createDataFrame([("a/X.yaml", None), ("new", "old"), ("q/Y.xbsl", None), ("?", None)], "path string, old_path string")
    owners = spark.createDataFrame([("a/X.yaml", "X"), ("old", "O"), ("b/Y.yaml", "Y")], "path string, element string")
    assert {r.path: r.mapping for r in graph.map_changes(changes, owners).collect()} == {"a/X.yaml": "exact_owner", "new": "old_path_owner", "q/Y.xbsl": "name_inference", "?": "unmapped"}
    assert graph.valid_path("a\\b") == "a/b"
    for bad in ("", "/a", "a/../b", "C:/x"):
        with pytest.raises(ValueError):
            graph.valid_path(bad)


def test_document_links(spark):
    docs = spark.createDataFrame([("1", "u1", "[a](u2) [b](u2#x) [c](u3) [d](u1)"), ("2", "u2", ""), ("3", "u3/", None), ("9", "u2", "")], "id string, source_uri string, text string")
    got = {(r.source, r.target) for r in graph.resolve_links(graph.document_links(docs), docs).collect()}
    assert got == {("1", "9"), ("1", "3")}


def test_datasets(spark):
    rows = spark.createDataFrame([(1, '{"m": "GET", "p": {"q": ["x", "Y"]}, "n": null}'), (2, '{"m": "POST", "get": true}'), (3, "[1]"), (4, None)], "id int, js string")
    ids = lambda df: sorted(r.id for r in df.collect())
    assert ids(datasets.query(rows, "js", filters={"m": "get"})) == [1]
    assert ids(datasets.query(rows, "js", filters={"p.q": "y"})) == [1]
    assert ids(datasets.query(rows, "js", search="get")) == [1]
    assert ids(datasets.query(rows, "js", search="true")) == [2]
    with pytest.raises(ValueError):
        datasets.query(rows, "js", search="x" * 501)
    with pytest.raises(LookupError):
        datasets.one(rows, F.col("id") > 1)
    ops = spark.createDataFrame([(1, ["b", "a", "zz"]), (2, [])], "op int, refs array<string>")
    target = spark.createDataFrame([("a", "A"), ("b", "B"), ("b", "C")], "k string, t string")
    got = {r.op: [m.t for m in r.matches] for r in datasets.ordered_lookup(ops, "op", "refs", target, "k", ["t"]).collect()}
    assert got == {1: ["B", "A"], 2: []}
    assert datasets.adapt_json({"a": 1}) == [{"key": "a", "value": 1}] and datasets.adapt_json([1, {"b": 2}]) == [{"value": 1}, {"b": 2}]


def test_search_paths_agree(spark):
    rows = [(i, f"t{i % 3}", None, ["x"], "alpha beta " * (i % 4) + "gamma " * (i % 5)) for i in range(40)]
    chunks = spark.createDataFrame(rows, "chunk_no long, title string, section string, tags array<string>, text string")
    made = index.build_index(chunks, "chunk_no", shared_dir(spark) + f"/index-{uuid.uuid4().hex}")
    best = search.bm25(made, "alpha gamma", 10).collect()
    assert {r.term for r in made.postings.select("term").distinct().collect()} == {"t0", "t1", "t2", "x", "alpha", "beta", "gamma"}
    tf = {(r.term, r.chunk_no): r.tf for r in made.postings.collect()}
    assert best and all((("alpha", r.chunk_no) in tf or ("gamma", r.chunk_no) in tf) for r in best)
    with pytest.raises(ValueError):
        search.bm25(made, "!", 5)
    v = {r.chunk_no: r.embedding for r in made.vectors.collect()}
    assert abs(sum(x * x for x in v[7]) - 1) < 1e-5 and made.idf.count() == 384
    assert {r.failures for r in index.check_vectors(made).collect()} == {0}
    lex, vec = search.bm25(made, "alpha", 5), search.vector_search(made, "alpha", 5)
    first, near = ({r.chunk_no: r[rank] for r in side.collect()} for side, rank in ((lex, "lexical_rank"), (vec, "vector_rank")))
    for r in search.fuse(lex, vec, ["chunk_no"]).collect():
        assert r.score == round((2 / (50 + first[r.chunk_no]) if r.chunk_no in first else 0) + (0.65 / (50 + near[r.chunk_no]) if r.chunk_no in near else 0), 8)
    rows = search.search(made, "alpha gamma", 5).collect()
    assert [r.score for r in rows] == sorted((r.score for r in rows), reverse=True) or len(rows) == 5
    for wrong in ({"query": "a"}, {"query": "alpha", "limit": 21}):
        with pytest.raises(ValueError):
            search.search(made, **wrong)
    assert search.vector_search(made, "§§§", 5).count() == 0


def test_features_are_words_parts_trigrams_and_pairs():
    def listed(value):
        """By the definition, one feature after the other."""
        import unicodedata

        words, grams = [], []
        for token in re.findall(text.TOKEN, unicodedata.normalize("NFKC", value)):
            token = token.lower()
            words += [token, *[("part", p) for p in re.findall(text.PART, token) if len(p) > 1]]
            bare = "".join(re.findall(text.PART, token))
            if 5 <= len(bare) <= 80:
                ends = "^" + bare + "$"
                grams += [ends[i : i + 3] for i in range(len(bare))]
        return words + [("gram", g) for g in grams] + [("pair", p) for p in zip(words, words[1:])]

    texts = ["", "a", "foo_bar12::x ＦＵＬＬ №5", "Ёлка ёлка-ёлка foo_bar12", "x" * 90 + " " + "y" * 80, "a/b c.d", "İstanbul ﬁne"]
    hashes, of = features.hashed_features(texts)
    want = [listed(t) for t in texts]
    assert np.bincount(of, minlength=len(texts)).tolist() == [len(w) for w in want]
    known = {}
    for i, w in enumerate(want):  # equal features have equal hashes, and only they
        for f in set(w):
            known.setdefault(f, []).append((i, w.count(f)))
    counts = {}
    for h, i in zip(hashes.tolist(), of.tolist()):
        counts.setdefault(h, {}).setdefault(i, 0)
        counts[h][i] += 1
    assert sorted(sorted(c.items()) for c in counts.values()) == sorted(sorted(c) for c in known.values())


def test_compatibility_forms_and_accents(spark):
    assert one(spark, text.tokens("x"), "ＦＵＬＬ-ｗidth ①② и\u0306од") == ["full-width", "12", "йод"]
    assert one(spark, text.slug("x"), "Ｓlug ²") == "slug-2"
    assert one(spark, text.words("x"), "Café ÉCOLE Ünïcode мой") == ["cafe", "ecole", "unicode", "мой"]


def test_redaction_of_the_standards_forms(spark):
    assert one(spark, text.redact("x"), "basic YWJj+/~== x, a.b+c@sub-d.example.org; userId=, user") == "basic [HIDDEN] x, [EMAIL]; userId=, user"


def test_nearest_leaves_out_odd_vectors(spark):
    rows = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, [1.0])], "vec_id long, embedding array<float>")
    got = [(r.query, r.neighbour, r.rank) for r in search.nearest(rows, rows.where("vec_id = 0"), "vec_id", "embedding", 2).orderBy("rank").collect()]
    assert got == [(0, 1, 1), (0, 2, 2)]
    assert [(r.query, r.neighbour) for r in search.nearest(rows, rows, "vec_id", "embedding", 1, block=1).where("query = 4").collect()] == []


def test_events_and_lists(spark):
    assert one(spark, F.to_json(diagnostics.redact_properties(F.create_map(F.lit("password"), F.col("x"), F.lit("a"), F.col("x")))), "q@r.st") == '{"password":"[HIDDEN]","a":"[EMAIL]"}'
    dto = spark.createDataFrame([("1", "s", 5)], "`display-name` string, sourceId string, hidden int")
    assert diagnostics.aliased(dto, ["display_name", "source_id", "status"]).collect()[0].asDict() == {"display_name": "1", "source_id": "s", "status": None}
    assert one(spark, F.size(diagnostics.unwrap(F.col("x"))), '{"results": [1, 2]}') == 2
    assert one(spark, F.size(diagnostics.unwrap(F.col("x"))), "[1]") == 1
    remote = spark.createDataFrame([(1, "A", None), (2, "b", "c")], "id int, n string, p string")
    local = spark.createDataFrame([(7, "a", "c"), (8, "z", "a")], "id int, n string, p string")
    assert {(r.remote, r.local, r.unique) for r in diagnostics.match_projects(remote, local, ["n", "p"]).collect()} == {(1, 7, False), (1, 8, False), (2, 7, True)}


def test_records_and_chunk_ids(spark):
    pages = spark.createDataFrame([("l/a", "1", "s", "T", "# A\r\n\r\n\r\ntext", ["b", "a", "b"], "c"), ("l/b", "1", "s", "T", None, None, "c")], "logical_id string, product_version string, source_version string, title string, text string, tags array<string>, corpus string")
    docs = corpus.document_records(pages)
    rows = {r.logical_id: r for r in docs.collect()}
    assert rows["l/a"].id == "l/a@1|s" and rows["l/a"].tags == ["a", "b"] and rows["l/a"].text == "# A\n\ntext\n"
    made = corpus.chunk_documents(docs).collect()
    assert [(c.document_id, c.position, c.section) for c in made] == [("l/a@1|s", 0, "A")]
    assert made[0].id == "l/a@1|s#c0000-" + hashlib.sha256(b"# A\n\ntext").hexdigest()[:12]
