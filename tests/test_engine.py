"""Sources, the whole analysis, the server and streams."""

import base64
import json
import subprocess
import threading
import urllib.request
from http.server import ThreadingHTTPServer

import pytest

from ripplemark.engine import ImpactEngine
from ripplemark.operators import report
from ripplemark.server import Analyses, handler
from ripplemark.sources.files import commits_from_git, commits_from_list, commits_from_log, files_from_dir, working_diff
from ripplemark.sources.hosted import HostedRepository
from ripplemark.sources.sinks import as_json_lines, rows_of

TREE = {
    "auth/service.py": "from auth.token import decode\n\ndef check(token):\n    return decode(token)\n",
    "auth/token.py": "def decode(token):\n    return token\n",
    "core/work.py": "from auth.service import check\n\n\ndef handle(request):\n    return check(request)\n",
    "tests/test_auth.py": "from auth.service import check\n\n\ndef test_check():\n    assert check(1)\n",
}
DIFF = "--- a/auth/service.py\n+++ b/auth/service.py\n@@ -3,2 +3,2 @@\n-def check(token):\n+def check(token: str, tenant: str):\n"


@pytest.fixture(scope="module")
def analysis(spark):
    commits = commits_from_list(spark, [("1", ["auth/service.py", "core/work.py"]), ("2", ["auth/service.py", "tests/test_auth.py"]), ("3", ["core/work.py"])])
    return ImpactEngine.from_source(spark, TREE).analyse(DIFF, 2, commits, "demo")


def test_analysis(analysis):
    a = analysis
    assert a["success"] and len(a) == 21 and a["k_hops"] == 2
    assert [s["name"] for s in a["seed_nodes"]] == ["service.py", "check", "decode"]
    assert a["affected_files"] == ["auth/service.py", "auth/token.py", "core/work.py", "tests/test_auth.py"]
    first = a["ranked_impact_nodes"][0]
    assert first["rank"] == 1 and 0 < first["impact_score"] <= 1
    callers = {n["id"]: n["status"] for n in a["nodes"]}
    assert callers["core/work.py:L5:C11:ref:check"] == "direct_caller" and callers["tests/test_auth.py:L5:C11:ref:check"] == "test"
    assert {e["error_type"].split(":")[0] for e in a["predicted_errors"]} == {"TypeError", "AssertionError / TestFailure"}
    assert {c["target_file"]: c["jaccard_score"] for c in a["git_co_changes"]} == {"tests/test_auth.py": 0.5, "core/work.py": 0.3333}
    assert a["test_recommendations"][0]["classification"] == "directly_related" and a["test_recommendations"][0]["test_name"] == "test_check"
    assert a["hybrid_rankings"][0]["rank"] == 1 and "structural_graph" in a["hybrid_rankings"][0]["evidence_sources"]
    assert "core/work.py" in a["markdown_report"] and a["evidence_paths"]
    json.dumps(a, default=str)


def test_context_is_cut(spark, analysis):
    nodes = spark.createDataFrame([(1, "a", "pay", "a.py", 1, "function", "def", "x" * 50, "", "", 3)], "node_seq long, node_id string, name string, file string, line int, category string, type string, snippet string, docstring string, signature string, end_line int")
    edges = spark.createDataFrame([], "edge_seq long, src string, dst string, edge_type string, confidence double")
    seeds = spark.createDataFrame([("a",)], "node_id string")
    assert "FUNCTION: pay [changed] (line 1)" in report.serialize_context(nodes, edges, seeds)
    assert report.serialize_context(nodes, edges, seeds, most_chars=60).startswith("=== CONTEXT") and "truncated" in report.serialize_context(nodes, edges, seeds, most_chars=60)
    assert report.write_report({"seeds": [], "direct": [], "indirect": [], "files": []}, model=lambda p: 1 / 0).startswith("# Impact")
    assert report.compact_report([{"file": "b", "name": "x", "line": 2}, {"file": "a", "name": "y", "line": 1}, {"file": "b", "name": "z", "line": 1, "is_direct": True}]).startswith("b: x, z (lines 1, 2)")


def test_folder_source(spark, tmp_path):
    for path, text in {"a.py": b"x = 1", "sub/b.js": b"let \xff y", "sub/c.txt": b"no", "node_modules/d.js": b"no", ".hid/e.py": b"no"}.items():
        (tmp_path / "repo" / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "repo" / path).write_bytes(text)
    assert [(r["seq"], r["path"], r["content"]) for r in files_from_dir(spark, str(tmp_path / "repo")).orderBy("seq").collect()] == [(0, "a.py", "x = 1"), (1, "sub/b.js", "let  y")]


def test_git_sources(spark, tmp_path):
    git = lambda *a: subprocess.run(["git", "-c", "user.name=t", "-c", "user.email=t@t", *a], cwd=tmp_path, check=True, capture_output=True, text=True).stdout
    git("init", "-q")
    for n, names in enumerate((["a.py", "b.py"], ["a.py"], ["a.py", "c.py"])):
        for name in names:
            (tmp_path / name).write_text(f"v{n}\n")
        git("add", "-A")
        git("commit", "-qm", f"c{n}")
    head = git("rev-parse", "HEAD").strip()
    got = commits_from_git(spark, str(tmp_path)).groupBy("ord").count().orderBy("ord").collect()
    assert [r["count"] for r in got] == [2, 1, 2]
    assert commits_from_git(spark, str(tmp_path), before_commit=head).filter("file = 'c.py'").isEmpty()
    assert commits_from_git(spark, str(tmp_path), most=1).select("hash").distinct().count() == 1
    assert "c.py" in working_diff(str(tmp_path))
    assert commits_from_log(spark, "").isEmpty() and working_diff(str(tmp_path / "none")) == ""


def test_hosted_source(spark):
    def transport(url, headers):
        path = url.split("/repos/o/r")[1]
        if path == "":
            return {"default_branch": "trunk"}
        if path.startswith("/git/trees/trunk"):
            return {"tree": [{"type": "blob", "path": "a.py"}, {"type": "tree", "path": "d"}, {"type": "blob", "path": "b.md"}, {"type": "blob", "path": "d/c.go"}]}
        if path.startswith("/contents/"):
            return {"content": base64.b64encode(path.encode()).decode()}
        if path == "/commits?per_page=1":
            return [{"sha": "abc"}]
        if path == "/commits/abc":
            return "diff!"
        raise OSError(path)

    repo = HostedRepository("o/r", transport=transport)
    assert repo.default_branch() == "trunk" and repo.paths() == ["a.py", "d/c.go"] and repo.paths(most=1) == ["a.py"]
    assert repo.diff() == "diff!" and repo.diff(pull=7) == "" and repo.content("x") == "/contents/x"
    assert sorted(map(tuple, repo.load_files(spark, slices=2).collect())) == [(0, "a.py", "/contents/a.py"), (1, "d/c.go", "/contents/d/c.go")]
    with pytest.raises(ValueError):
        HostedRepository("not a slug")


def test_server(spark):
    class Fake(Analyses):
        made = 0

        def analyse(self, request):
            Fake.made += 1
            if request.get("boom"):
                raise RuntimeError("boom")
            return super().analyse(request) if not request.get("k") else {"k": request["k"]}

    server = ThreadingHTTPServer(("127.0.0.1", 0), handler(Fake(spark)))
    threading.Thread(target=server.serve_forever, daemon=True).start()

    def ask(path, body=None):
        data = body if isinstance(body, bytes) or body is None else json.dumps(body).encode()
        try:
            with urllib.request.urlopen(urllib.request.Request(f"http://127.0.0.1:{server.server_port}{path}", data=data)) as r:
                return r.status, json.loads(r.read())
        except urllib.error.HTTPError as e:
            return e.code, json.loads(e.read())

    assert ask("/api/health") == (200, {"status": "ok"})
    assert ask("/api/analyze", {"k": 2}) == ask("/api/analyze", {"k": 2}) == (200, {"k": 2}) and Fake.made == 1
    assert ask("/nope")[0] == 404 and ask("/api/analyze", b"{")[0] == 400 and ask("/api/analyze", {})[0] == 400 and ask("/api/analyze", {"boom": 1})[0] == 500
    server.shutdown()


def test_json_rows(spark):
    df = spark.createDataFrame([(1, "a")], "x int, y string")
    assert as_json_lines(df).first()[0] == '{"x":1,"y":"a"}' and rows_of(df) == [{"x": 1, "y": "a"}]


def test_streams(spark, sf_dir, tmp_path):
    from ripplemark.streaming import live

    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "events"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "events"))
    query = live.event_windows(stream, late="60 days").writeStream.outputMode("complete").format("memory").queryName("windows").start()
    query.processAllAvailable()
    query.stop()
    key = lambda df: sorted((str(r["window_start"]), r["event_type"], r["events"], round(r["total"], 6)) for r in df.collect())
    assert key(spark.table("windows")) == key(live.event_windows(events))
    add = live.into_pair_counts(str(tmp_path / "pairs"))
    commits = commits_from_list(spark, [("1", ["a", "b"]), ("2", ["a", "b", "c"])])
    add(commits.filter("hash = '1'"), 0)
    add(commits.filter("hash = '2'"), 1)
    add(commits.filter("hash = '2'"), 1)
    assert {(r["f1"], r["f2"]): r["together"] for r in live.summed_pairs(spark, str(tmp_path / "pairs")).collect()} == {("a", "b"): 2, ("a", "c"): 1, ("b", "c"): 1}


def test_watched_tree(spark, tmp_path):
    from ripplemark.streaming import live

    root = tmp_path / "src"
    root.mkdir()
    (root / "a.py").write_text("def f(): pass")
    changed = live.changed_files(live.watched_files(spark, str(root)))
    query = changed.writeStream.outputMode("append").format("memory").queryName("watched").option("checkpointLocation", str(tmp_path / "c")).start()
    query.processAllAvailable()
    (root / "b.py").write_text("def g(): pass")
    query.processAllAvailable()
    query.stop()
    assert sorted((r["path"].split("/")[-1], r["content"], r["version"]) for r in spark.table("watched").collect()) == [("a.py", "def f(): pass", 1), ("b.py", "def g(): pass", 1)]
