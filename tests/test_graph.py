"""Linking rules over one small tree, and seeds of diffs against it."""

import pytest
from pyspark.sql import functions as F

from ripplemark.operators import linking
from ripplemark.operators.seeds import changed_lines, diff_table, numbered_lines, seed_nodes, seeds_or_first
from ripplemark.sources.files import files_from_dict

TREE = {
    "auth/service.py": "from auth.token import decode\n\ndef check(t):\n    return decode(t)\n\ndef login(u):\n    return check(u)\n",
    "auth/token.py": "def decode(t):\n    if t:\n        return decode(t[1:])\n    return t\n",
    "billing/service.py": "def check(x):\n    return x\n",
    "core/work.py": "from auth.service import check as verify\n\n\nclass Job:\n    def run(self, a):\n        self.step(a)\n        return verify(a)\n\n    def step(self, a):\n        return ghost(a)\n",
    "core/more.py": "from core.work import Job\n\n\nclass Mid(Job):\n    pass\n\n\nclass Late(Mid):\n    def run(self, b):\n        return b\n\n    def step(self, a, b):\n        return a\n\n\ndef loose(x):\n    return wander(x)\n",
    "lib/a/far.py": "def wander(x):\n    return x\n",
    "lib/b/far.py": "def wander(x):\n    return x\n",
    "web/dup.js": "class Shape {\n}\nclass Circle extends Shape {\n  draw(x) {\n    paint(x);\n  }\n}\nfunction paint(x) {\n}\n",
    "tests/test_core.py": "from auth.service import check, login\n\n\ndef test_check():\n    check(1)\n    login(2)\n",
}


@pytest.fixture(scope="module")
def graph(spark):
    g = linking.build_graph(files_from_dict(spark, TREE))
    return linking.Graph(g.nodes.cache(), g.edges.cache())


def edges(graph, kind):
    return sorted((r["src"], r["dst"], r["confidence"], r["resolution_method"]) for r in graph.edges.filter(F.col("edge_type") == kind).collect())


def test_calls_by_rule(graph):
    got = {(s.split(":ref:")[0].rsplit(":", 1)[0], d): (c, m) for s, d, c, m in edges(graph, "E_invoke")}
    assert got["auth/service.py:L4", "auth/token.py:L1:def:decode"] == (0.95, "import_exact")
    assert got["auth/service.py:L7", "auth/service.py:L3:def:check"] == (0.95, "local_exact")
    assert got["auth/token.py:L3", "auth/token.py:L1:def:decode"] == (0.95, "local_exact")
    assert got["core/work.py:L6", "core/work.py:L9:def:Job.step"] == (1.0, "intra_class")
    assert got["core/work.py:L7", "auth/service.py:L3:def:check"] == (0.95, "import_exact")
    assert got["tests/test_core.py:L5", "auth/service.py:L3:def:check"] == (0.95, "import_exact")
    assert got["web/dup.js:L5", "web/dup.js:L8:C9:def:paint"] == (0.95, "local_exact")
    assert not any("ghost" in s for s, *_ in edges(graph, "E_invoke"))


def test_unsure_calls_are_candidates(graph):
    got = edges(graph, "E_invoke_candidate")
    assert [(d, c, m) for _, d, c, m in got] == [("lib/a/far.py:L1:def:wander", 0.35, "repo_ambiguous"), ("lib/b/far.py:L1:def:wander", 0.35, "repo_ambiguous")]
    row = graph.edges.filter("edge_type = 'E_invoke_candidate'").first()
    assert row["is_candidate"] and "wander" in row["evidence"]


def test_recursion_is_marked(graph):
    rows = graph.edges.filter("is_recursive").collect()
    assert [(r["src"].split(":C")[0], r["dst"]) for r in rows] == [("auth/token.py:L3", "auth/token.py:L1:def:decode")]


def test_imports(graph):
    got = {(s, d) for s, d, *_ in edges(graph, "E_import")}
    assert ("core/work.py:L1:def:work.py", "auth/service.py:L1:def:service.py") in got
    assert ("core/work.py:L1:def:work.py", "auth/service.py:L3:def:check") in got
    assert not any("billing" in d for _, d in got)


def test_inheritance_and_overrides(graph):
    assert {(s, d) for s, d, *_ in edges(graph, "E_inherit")} == {("core/more.py:L4:def:Mid", "core/work.py:L4:def:Job"), ("core/more.py:L8:def:Late", "core/more.py:L4:def:Mid"), ("web/dup.js:L3:C6:def:Circle", "web/dup.js:L1:C6:def:Shape")}
    # through an empty parent; one more required argument breaks the contract
    assert {(s, d) for s, d, *_ in edges(graph, "E_override")} == {("core/more.py:L9:def:Late.run", "core/work.py:L5:def:Job.run")}


def test_containment(graph):
    got = {(s, d) for s, d, *_ in edges(graph, "E_contain")}
    assert ("core/work.py:L1:def:work.py", "core/work.py:L4:def:Job") in got and ("core/work.py:L4:def:Job", "core/work.py:L5:def:Job.run") in got
    assert ("core/work.py:L5:def:Job.run", "core/work.py:L6:C8:ref:step") in got
    assert graph.nodes.select("node_id").distinct().count() == graph.nodes.count()
    first = [r["node_id"] for r in graph.nodes.orderBy("node_seq").limit(3).collect()]
    assert first == ["auth/service.py:L1:def:service.py", "auth/service.py:L3:def:check", "auth/service.py:L6:def:login"]


def test_helpers(graph):
    assert linking.edge_types_between(graph.edges, "core/more.py:L4:def:Mid", "core/work.py:L4:def:Job") == ["E_inherit"]
    counts = linking.graph_counts(graph)
    assert counts["nodes"] == graph.nodes.count() and counts["edges"] == graph.edges.count()


def test_upsert_keeps_place_and_last_values(spark):
    rows = spark.createDataFrame([(1, "a", "b", "k", 0.1), (5, "a", "b", "k", 0.5), (3, "a", "b", "k", 0.3), (4, "a", "b", "j", 0.4)], "edge_seq long, src string, dst string, key string, confidence double")
    got = {r["key"]: (r["edge_seq"], r["confidence"]) for r in linking.upsert_edges(rows).collect()}
    assert got == {"k": (1, 0.5), "j": (4, 0.4)}
    assert [(r["edge_seq"], r["key"], r["confidence"]) for r in linking.upsert_edges(rows, multigraph=False).collect()] == [(1, "k", 0.5)]


def test_ancestry_ends_on_cycles(spark):
    pairs = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "a")], "sub string, super string")
    got = {(r["sub"], r["super"]) for r in linking.ancestry(pairs).collect()}
    assert got == {(s, t) for s in "abcx" for t in "abc" if s != t}


def lines_of(spark, text):
    return sorted((r["file"], r["line"]) for r in changed_lines(numbered_lines(diff_table(spark, text))).collect())


def test_changed_lines(spark):
    assert lines_of(spark, "--- a/s.py\n+++ b/s.py\n@@ -10,3 +10,4 @@ def f\n ctx\n-old\n+new\n+more\n ctx\n") == [("s.py", 11), ("s.py", 12)]
    assert lines_of(spark, "+++ b/s.py\n@@ -1 +1 @@\n+x\n+++ /dev/null\n@@ -3 +7 @@\n+y\n--- z\n+w\n") == [("s.py", 1), ("s.py", 7), ("s.py", 8)]
    assert lines_of(spark, "+lonely\n@@ -1 +0,0 @@\n+z") == [] and lines_of(spark, "") == []


def test_seeds(spark, graph):
    def of(file, *lines):
        return sorted(r["node_id"] for r in seed_nodes(graph.nodes, spark.createDataFrame([(file, n) for n in lines], "file string, line int")).collect())

    got = of("auth/token.py", 4)
    assert "auth/token.py:L1:def:decode" in got
    assert of("repo/lib/a/far.py", 40) == ["lib/a/far.py:L1:def:far.py", "lib/a/far.py:L1:def:wander"]
    # lines of JavaScript definitions end at 0, so a change in a file's first lines reaches all of them
    assert len(of("web/dup.js", 1)) == graph.nodes.filter("file = 'web/dup.js'").count()
    assert of("nowhere.py", 1) == []
    none = graph.nodes.limit(0).select("node_id")
    assert seeds_or_first(graph.nodes, none).first()["node_id"] == "auth/service.py:L3:def:check"


def test_calls_are_resolved_before_definitions_are_joined(spark, monkeypatch):
    """40 calls of each kind and 60 definitions of one name: no written table has a row for each call and definition."""
    defs = spark.createDataFrame([(f"d{i}", "go", f"pkg{i % 3}/m{i}.py") for i in range(60)], "node_id string, name string, file string")
    made = [(f"far{i}", "go", f"else/{i}.py") for i in range(40)] + [(f"near{i}", "go", f"pkg0/other{i}.py") for i in range(40)] + [(f"use{i}", "go", f"use/{i}.py") for i in range(40)] + [("two", "go", "use/0.py"), ("two", "go", "use/41.py")]
    refs = spark.createDataFrame([(*r, "", "") for r in made], "ref_id string, name string, file string, scope string, receiver string")
    imports = [(f"use/{i}.py", "go", "pkg1.m1" if i % 2 else "no.such", "", 0) for i in range(42)]
    imports += [("else/0.py", "go", "1", "", 0), ("else/1.py", "go", "long.way.pkg2.m2", "", 0)]  # one name ends with the other, not at a dot
    imports = spark.createDataFrame(imports, "file string, alias string, module string, symbol string, item int")
    sizes = []
    keep = linking.written
    monkeypatch.setattr(linking, "written", lambda df, name: sizes.append((name, (out := keep(df, name)).count())) or out)
    got = linking.resolve_calls(refs, defs, imports, spark.createDataFrame([], "module string, target string")).collect()
    assert sizes and max(n for _, n in sizes) <= 2 * len(made), sizes
    by = {}
    for r in got:
        by.setdefault(r["ref_id"], []).append((r["target"], r["method"]))
    every = {f"d{i}" for i in range(60)}
    assert all(len(x) == len(set(x)) for x in by.values())
    assert {t for t, _ in by["far7"]} == every and {m for _, m in by["far7"]} == {"repo_ambiguous"}
    assert sorted(by["near3"]) == sorted((f"d{i}", "sibling_module") for i in range(0, 60, 3))
    assert by["use1"] == [("d1", "import_exact")] and by["two"] == [("d1", "import_exact")] and by["far1"] == [("d2", "import_exact")]
    assert {t for t, _ in by["use2"]} == every and {m for _, m in by["use2"]} == {"import_fallback"}
    assert {t for t, m in by["far0"]} == {f"d{i}" for i in range(60) if i % 10 == 1} and {m for _, m in by["far0"]} == {"import_exact"}
