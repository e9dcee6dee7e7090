"""A small service with tests: its graph, rankings, tests to run and evaluation, node by node."""

import pytest

from ripplemark.operators.evaluation import call_sites_of, evaluation, lexical_candidates, seed_by_symbol
from ripplemark.operators.linking import Graph, build_graph, graph_counts, relative_targets, resolve_imports
from ripplemark.operators.metrics import retrieval_metrics
from ripplemark.operators.seeds import changed_lines, diff_table, numbered_lines, seed_nodes
from ripplemark.operators.test_selection import relevant_tests
from ripplemark.operators.traversal import ego_nodes, impact_roles, induced_edges, rank_impact
from ripplemark.sources.files import DEFAULT_DIFF, files_from_dict

TREE = {
    "auth/service.py": """from auth.token import decode_token

def validate_token(token: str, admin: bool = False) -> bool:
    # who may pass
    found = decode_token(token)
    if not found:
        return False
    if admin and found.get("kind") != "root":
        return False
    return True

def login_user(token: str) -> dict:
    # the answer to a form
    if validate_token(token):
        return {"in": 1}
    return {"in": 0}
""",
    "auth/token.py": """def decode_token(token: str) -> dict:
    # nothing is signed here
    if not token:
        return {}
    return {"kind": "root"}
""",
    "core/service.py": """from auth.service import validate_token

class CoreProcessor:
    def process_request(self, token: str, body: dict) -> dict:
        # only for those let in
        if not validate_token(token):
            raise PermissionError("no")
        return {"done": body}
""",
    "models/user.py": """class User:
    def __init__(self, key: str, kind: str):
        self.key = key
        self.kind = kind

def get_user_profile(key: str) -> User:
    # always the same kind
    return User(key, "guest")
""",
    "tests/test_auth.py": """import sys
import os

# where the service lies
_root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
if _root:
    sys.path.insert(0, _root)

# another package of that name
# may come first

try:
    _core = os.path.join(_root, "core")
    if _core:
        sys.path.insert(0, _core)
except ImportError:
    pass

from auth.service import validate_token, login_user
from core.service import CoreProcessor

def test_validate_token_success():
    assert validate_token("x") is True

def test_login_user():
    got = login_user("x")
    assert got["in"] == 1

def test_core_processor():
    worker = CoreProcessor()
    got = worker.process_request("x", {"n": 1})
    assert got["done"]
""",
}


@pytest.fixture(scope="module")
def graph(spark):
    from ripplemark.durable import written

    g = build_graph(files_from_dict(spark, TREE))
    return Graph(written(g.nodes, "nodes"), written(g.edges, "edges"))


def seed(spark, graph, whole_diff):
    if whole_diff:
        return seed_nodes(graph.nodes, changed_lines(numbered_lines(diff_table(spark, DEFAULT_DIFF))))
    return seed_by_symbol(graph.nodes, graph.edges, "validate_token")


@pytest.fixture(scope="module")
def rankings(spark, graph):
    from ripplemark.durable import written

    return {whole: written(rank_impact(graph.nodes, graph.edges, seed(spark, graph, whole), 2), "ranking") for whole in (False, True)}


def test_nodes_and_edges(graph):
    assert graph_counts(graph) == {"nodes": 32, "edges": 44, "E_contain": 27, "E_import": 9, "E_invoke": 8}
    kinds = {r["category"]: r["count"] for r in graph.nodes.groupBy("category").count().collect()}
    assert kinds == {"file": 5, "function": 7, "method": 2, "class": 2, "call": 16}
    calls = sorted((r["symbol"], r["call_site_line"], r["confidence"], r["resolution_method"]) for r in graph.edges.filter("edge_type = 'E_invoke'").collect())
    exact = [("CoreProcessor", 30), ("decode_token", 5), ("login_user", 26), ("validate_token", 6), ("validate_token", 23)]
    assert calls == sorted([(n, at, 0.95, "import_exact") for n, at in exact] + [("User", 8, 0.95, "local_exact"), ("validate_token", 14, 0.95, "local_exact"), ("process_request", 31, 0.5, "repo_unique")])


def test_neighbourhoods(spark, graph):
    one, three = (seed(spark, graph, whole) for whole in (False, True))
    assert three.count() == 3
    sizes = []
    for seeds in (one, three):
        for k in (1, 2):
            ego = graph.nodes.join(ego_nodes(graph.edges, seeds, k).select("node_id"), "node_id", "left_semi")
            sizes.append((ego.count(), induced_edges(graph.edges, ego).count()))
    assert sizes == [(9, 11), (23, 32), (12, 18), (24, 34)]
    ego = graph.nodes.join(ego_nodes(graph.edges, one, 2).select("node_id"), "node_id", "left_semi")
    roles = impact_roles(ego, induced_edges(graph.edges, ego), one).join(graph.nodes.select("node_id", "name", "line", "file"), "node_id").collect()
    assert sorted((r["file"], r["line"]) for r in roles if r["is_direct"]) == [("auth/service.py", 14), ("core/service.py", 6), ("tests/test_auth.py", 23)]
    assert sorted(r["name"].split(".")[-1] for r in roles if r["is_indirect"]) == ["CoreProcessor", "decode_token", "login_user", "process_request", "test_core_processor", "test_login_user", "test_validate_token_success"]


@pytest.mark.parametrize("whole", [False, True])
def test_ranking(rankings, whole):
    got = rankings[whole].orderBy("rank").collect()
    assert len(got) == 21
    shown = [(r["name"].split(".")[-1], r["line"], round(r["impact_score"], 4), r["hop_distance"], r["primary_relationship"], r["severity"]) for r in got]
    one = [
        ("test_auth", 1, 0.6425, 1, "E_import", "MEDIUM"),
        ("validate_token", 23, 0.5638, 1, "E_invoke", "HIGH"),
        ("validate_token", 6, 0.5419, 1, "E_invoke", "HIGH"),
        ("validate_token", 14, 0.5376, 1, "E_invoke", "HIGH"),
        ("service", 1, 0.3494, 1, "E_import", "MEDIUM"),
        ("test_validate_token_success", 22, 0.1811, 2, "E_contain", "MEDIUM"),
        ("service", 1, 0.1782, 1, "E_contain", "MEDIUM"),
        ("decode_token", 5, 0.1727, 1, "E_contain", "MEDIUM"),
        ("get", 8, 0.1677, 1, "E_contain", "MEDIUM"),
        ("process_request", 4, 0.1633, 2, "E_contain", "MEDIUM"),
    ]
    three = [
        ("test_auth", 1, 0.6425, 1, "E_import", "MEDIUM"),
        ("validate_token", 23, 0.5261, 1, "E_invoke", "HIGH"),
        ("validate_token", 6, 0.5073, 1, "E_invoke", "HIGH"),
        ("validate_token", 14, 0.5068, 1, "E_invoke", "HIGH"),
        ("service", 1, 0.3553, 1, "E_import", "MEDIUM"),
        ("login_user", 12, 0.2001),
        ("decode_token", 1, 0.1909, 1, "E_invoke", "HIGH"),
        ("test_validate_token_success", 22, 0.1647),
        ("get", 8, 0.1580),
        ("login_user", 26, 0.1463, 2, "E_invoke", "LOW"),
    ]
    for row, want in zip(shown, three if whole else one, strict=False):
        assert row[0].removesuffix(".py").split(".")[-1] in (want[0], "py") and row[1] == want[1] and row[2] == pytest.approx(want[2], abs=1.01e-4) and row[3 : len(want)] == want[3:]
    if not whole:
        assert [r[2] for r in shown[14:20]] == pytest.approx([0.0989] * 6, abs=1.01e-4) and {r[5] for r in shown[14:20]} == {"LOW"}


def test_tests_to_run(spark, graph, rankings):
    got = relevant_tests(graph.nodes, graph.edges, seed(spark, graph, False), rankings[False]).collect()
    assert [(r["test_name"], r["classification"], round(r["impact_score"], 2)) for r in got] == [("test_validate_token_success", "directly_related", 0.85), ("test_auth.py", "candidate_review", 0.45), ("test_login_user", "candidate_review", 0.45), ("test_core_processor", "candidate_review", 0.45)]


def test_evaluation(spark, graph):
    files = files_from_dict(spark, TREE)
    tables = evaluation(files, "validate_token", DEFAULT_DIFF, file_part="test_auth", name_part="validate")
    got = {name: tuple(row.values()) for name, row in tables["table_3_ablation"].items()}
    ranked = (3, 7, 0, 30.0, 100.0, 46.15, 0.5, 73.28)
    assert got == {"m_base": (3, 0, 0, 100.0, 100.0, 100.0, 1.0, 100.0), "m_no_weight": (3, 7, 0, 30.0, 100.0, 46.15, 1.0, 100.0), "m_weight": ranked, "m_hybrid": ranked, "m_complete": ranked}
    assert tuple(tables["table_4_test_impact"].values()) == (1, 3, 1, 25.0, 50.0, 33.33, 1.0, 61.31) and tables["evaluation_symbol"] == "validate_token"
    seeds = seed(spark, graph, False)
    assert tuple(retrieval_metrics(lexical_candidates(files, graph.nodes, "validate_token"), call_sites_of(graph.edges, seeds)).first())[:6] == (3, 3, 0, 50.0, 100.0, 66.67)
    assert [r["node_id"].split(":")[-1] for r in seed_by_symbol(graph.nodes, graph.edges, "nowhere").collect()] == ["validate_token"]


def test_relative_imports(spark):
    files = files_from_dict(spark, {p: "" for p in ("a/b/c.py", "a/b/d.py", "a/e/__init__.py", "a/x.py", "web/view.js", "web/go.ts", "lib/index.jsx", "top.py")})
    asked = [("a/b/c.py", ".d"), ("a/b/c.py", "..e"), ("a/b/c.py", "..x"), ("a/b/c.py", "..."), ("a/b/c.py", "....top"), ("a/b/c.py", "x"), ("web/view.js", "./go"), ("web/view.js", "../lib"), ("web/view.js", "./../web/./go"), ("web/view.js", "go"), ("web/view.js", "../nothing"), ("top.py", ".a.x")]
    imports = spark.createDataFrame(asked, "file string, module string")
    got = {(r["file"], r["module"]): r["target"] for r in relative_targets(imports, files).collect()}
    assert got == {("a/b/c.py", ".d"): "a/b/d.py", ("a/b/c.py", "..e"): "a/e/__init__.py", ("a/b/c.py", "..x"): "a/x.py", ("a/b/c.py", "....top"): "top.py", ("web/view.js", "./go"): "web/go.ts", ("web/view.js", "../lib"): "lib/index.jsx", ("web/view.js", "./../web/./go"): "web/go.ts", ("top.py", ".a.x"): "a/x.py"}
    plain, more = (resolve_imports(imports, files, relative).count() for relative in (False, True))
    assert more == plain + len(got)
