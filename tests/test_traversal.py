"""Walks, ranks and paths against plain Python on small random graphs."""

import heapq
import math
import random

import pytest
from pyspark.sql import functions as F

from ripplemark.functions.scoring import edge_weight, safe_cost, severity
from ripplemark.functions.text import code_tokens
from ripplemark.operators import fusion, history, traversal
from ripplemark.operators.metrics import retrieval_metrics
from ripplemark.operators.test_selection import relevant_tests
from ripplemark.schema import BASE_WEIGHTS, EDGE_TYPES

NODES = "node_seq long, node_id string, name string, file string, line int, category string, type string, snippet string, docstring string"


@pytest.fixture(scope="module")
def small(spark):
    rng = random.Random(11)
    ids = [f"n{i:02d}" for i in range(18)]
    rows = [(i, n, f"name_{n}", f"{'tests/' if i % 4 == 0 else ''}f{i % 5}.py", i, ["function", "class", "call", "file"][i % 4], "ref" if i % 4 == 2 else "def", "x", "") for i, n in enumerate(ids)]
    edges = []
    for k in range(40):
        a, b = rng.sample(ids, 2)
        edges.append((k, a, b, rng.choice(EDGE_TYPES), rng.choice([1.0, 0.95, 0.5, None, 0.35])))
    return rows, edges, spark.createDataFrame(rows, NODES).cache(), spark.createDataFrame(edges, "edge_seq long, src string, dst string, edge_type string, confidence double").cache()


def seeds_of(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "node_id string")


def projected(rows, edges):
    """The arrows of the projection, the last one of a pair."""
    place = {r[1]: r[0] for r in rows}
    first = {}
    for k, a, b, _, _ in edges:
        first.setdefault((a, b), k)
    out = {}
    for _, a, b, kind, conf in sorted(edges, key=lambda e: (place[e[1]], first[e[1], e[2]], e[0])):
        w = max(1e-4, min(1.0, BASE_WEIGHTS[kind] * (1.0 if conf is None else conf)))
        if kind in ("E_invoke", "E_invoke_candidate"):
            pairs = [(b, a, w), (a, b, w * 0.3)]
        elif kind == "E_override":
            pairs = [(b, a, w), (a, b, w * 0.8)]
        elif kind == "E_contain":
            pairs = [(a, b, w * 0.6), (b, a, w * 0.6)]
        else:
            pairs = [(b, a, w)]
        for x, y, v in pairs:
            out[x, y] = (v, kind)
    return out


def plain_pagerank(ids, arrows, seeds, rounds, alpha=0.85):
    p0 = {i: (1 / len(seeds) if i in seeds else 0.0) for i in ids}
    total = {i: sum(w for (a, _), (w, _) in arrows.items() if a == i) for i in ids}
    p = dict(p0)
    for _ in range(rounds):
        q = {i: (1 - alpha) * p0[i] for i in ids}
        for (a, b), (w, _) in arrows.items():
            q[b] += alpha * p[a] * w / total[a]
        lost = sum(p[i] for i in ids if not total[i])
        for i in ids:
            q[i] += alpha * lost * p0[i]
        p = q
    return p


def plain_paths(arrows, seed):
    best, heap = {}, [(0.0, 0, (seed,))]
    while heap:
        cost, hops, path = heapq.heappop(heap)
        if path[-1] in best:
            continue
        best[path[-1]] = (cost, hops, path)
        for (a, b), (w, _) in arrows.items():
            if a == path[-1] and b not in best:
                heapq.heappush(heap, (cost - math.log(max(1e-4, min(1.0, w))), hops + 1, (*path, b)))
    return best


def test_projection_keeps_the_last_arrow(small):
    rows, edges, nodes, table = small
    got = {(r["src"], r["dst"]): (r["weight"], r["edge_type"]) for r in traversal.impact_projection(table, nodes).collect()}
    want = projected(rows, edges)
    assert got.keys() == want.keys()
    assert all(got[k][1] == want[k][1] and got[k][0] == pytest.approx(want[k][0]) for k in want)


def test_pagerank(spark, small):
    rows, edges, nodes, table = small
    arrows = traversal.impact_projection(table, nodes).cache()
    for tolerance in (None, 0.0):
        got = {r["node_id"]: r["ppr"] for r in traversal.personalized_pagerank(nodes.select("node_id"), arrows, seeds_of(spark, "n00", "n05"), iterations=6, tolerance=tolerance).collect()}
        want = plain_pagerank([r[1] for r in rows], projected(rows, edges), {"n00", "n05"}, 6)
        assert got == {k: pytest.approx(v, abs=1e-12) for k, v in want.items()}
    assert sum(got.values()) == pytest.approx(1.0)
    assert traversal.personalized_pagerank(nodes.select("node_id"), arrows, seeds_of(spark, "absent")).isEmpty()


def test_cheapest_paths_and_ranking(spark, small):
    rows, edges, nodes, table = small
    arrows = projected(rows, edges)
    table_arrows = traversal.impact_projection(table, nodes).cache()
    got = {(r["seed"], r["node_id"]): (r["cost"], r["hops"], tuple(r["path"])) for r in traversal.cheapest_paths(table_arrows, seeds_of(spark, "n00", "n05")).collect()}
    want = {(s, n): v for s in ("n00", "n05") for n, v in plain_paths(arrows, s).items()}
    assert got.keys() == want.keys()
    for k in want:
        assert got[k][0] == pytest.approx(want[k][0]) and got[k][1:] == want[k][1:]
    ppr = plain_pagerank([r[1] for r in rows], arrows, {"n00", "n05"}, 8)
    top = max(v for k, v in ppr.items() if k not in ("n00", "n05"))
    scores = {}
    for (_, n), (_, hops, path) in want.items():
        if 0 < hops <= 3 and n not in ("n00", "n05"):
            energy = math.prod(arrows[p, q][0] * 0.75 for p, q in zip(path, path[1:], strict=False))
            scores[n] = max(scores.get(n, 0), energy)
    ranking = traversal.rank_impact(nodes, table, seeds_of(spark, "n00", "n05"), 3, iterations=8, tolerance=None).orderBy("rank").collect()
    assert {r["node_id"]: pytest.approx(r["impact_score"]) for r in ranking} == {n: min(1.0, 0.65 * e + 0.35 * ppr[n] / top) for n, e in scores.items()}
    assert [r["rank"] for r in ranking] == list(range(1, len(ranking) + 1))
    assert all(len(r["evidence_path"]) == r["hop_distance"] and r["evidence_path"][-1]["edge_type"] == r["primary_relationship"] for r in ranking)


def test_a_dear_short_path_does_not_stand_in(spark):
    arrows = spark.createDataFrame([("s", "t", 0.001, 6.9), ("s", "a", 1.0, 0.0), ("a", "b", 1.0, 0.0), ("b", "t", 1.0, 0.0)], "src string, dst string, weight double, cost double").withColumns({"edge_type": F.lit("E"), "confidence": F.lit(1.0)})
    paths = traversal.path_edges(traversal.cheapest_paths(arrows, seeds_of(spark, "s")), arrows)
    assert {r["node_id"] for r in traversal.best_energies(paths, 2).collect()} == {"a", "b"}


def test_neighbourhoods(spark):
    edges = spark.createDataFrame([(1, "a", "b", "E_invoke"), (2, "b", "c", "E_contain"), (3, "c", "d", "E_invoke_candidate"), (4, "x", "a", "E_import")], "edge_seq long, src string, dst string, edge_type string")
    hops = lambda k, **kw: {r["node_id"]: r["hop"] for r in traversal.ego_nodes(edges, seeds_of(spark, "b"), k, **kw).collect()}
    assert hops(1) == {"b": 0, "a": 1, "c": 1}
    assert hops(2) == {"b": 0, "a": 1, "c": 1, "x": 2}
    assert hops(2, include_candidates=True)["d"] == 2
    assert hops(2, edge_types={"E_contain", "E_invoke_candidate"}) == {"b": 0, "c": 1, "d": 2}
    both = seeds_of(spark, "c", "d", "b")
    assert {r["edge_type"] for r in traversal.induced_edges(edges, both).collect()} == {"E_contain", "E_invoke_candidate"}
    assert {r["node_id"] for r in traversal.reachable(edges, seeds_of(spark, "x")).collect()} == set("abcdx")


def test_roles_status_and_errors(spark):
    nodes = spark.createDataFrame([(1, "s", "pay", "a.py", 1, "function", "def", "", ""), (2, "r1", "pay", "b.py", 5, "call", "ref", "pay()", ""), (3, "r2", "pay", "tests/t.py", 7, "call", "ref", "pay()", ""), (4, "m", "C.pay", "c.py", 2, "method", "def", "", ""), (5, "q", "pay", "d.py", 3, "call", "ref", "", ""), (6, "f", "other", "b.py", 4, "function", "def", "", ""), (7, "z", "callee", "z.py", 1, "function", "def", "", "")], NODES)
    edges = spark.createDataFrame([(1, "r1", "s", "E_invoke", 1.0), (2, "r2", "s", "E_invoke", 1.0), (3, "m", "s", "E_override", 1.0), (4, "q", "s", "E_invoke_candidate", 0.35), (5, "f", "r1", "E_contain", 1.0), (6, "s", "z", "E_invoke", 1.0), (7, "r1", "s", "E_invoke_candidate", 0.35)], "edge_seq long, src string, dst string, edge_type string, confidence double")
    seeds = seeds_of(spark, "s")
    roles = traversal.impact_roles(nodes, edges, seeds)
    got = {r["node_id"]: tuple(r)[1:] for r in roles.collect()}
    assert got == {"r1": (True, False, False, False), "r2": (True, False, False, False), "m": (True, False, False, False), "q": (False, True, False, False), "f": (False, False, False, True), "z": (False, False, True, False)}
    status = traversal.node_status(nodes, roles, seeds)
    assert {r["node_id"]: r["status"] for r in status.collect()} == {"s": "seed", "r1": "direct_caller", "r2": "test", "m": "direct_caller", "q": "normal", "f": "indirect_caller", "z": "callee"}
    assert traversal.file_rollup(nodes, status).first()["file"] == "a.py"
    diff = lambda t: spark.createDataFrame([(x,) for x in t.split("\n")], "line string")
    kinds = lambda t: sorted((r["severity"], r["error_type"].split(":")[0].split(" ")[0], r["file"]) for r in traversal.predicted_errors(nodes, edges, seeds, diff(t)).collect())
    assert kinds("+def pay(a: int):") == [("CRITICAL", "TypeError", "b.py"), ("HIGH", "AssertionError", "tests/t.py"), ("HIGH", "LiskovSubstitutionViolation", "c.py")]
    assert kinds("+x")[0] == ("HIGH", "AssertionError", "tests/t.py")
    assert {r["param"] for r in traversal.added_parameters(diff("+def f(token: str, tenant_id: str):")).collect()} == {"token"}


def test_weights_and_severities(spark):
    rows = spark.createDataFrame([("E_invoke", 0.5), ("E_contain", None), ("E_x", 1.0), ("E_invoke", float("nan")), ("E_invoke", -1.0), ("E_invoke", 9.0)], "k string, c double")
    got = [(r["w"], r["c"]) for r in rows.select(edge_weight(F.col("k"), F.col("c")).alias("w"), safe_cost(edge_weight(F.col("k"), F.col("c"))).alias("c")).collect()]
    assert [w for w, _ in got] == [0.5, 0.5, 0.4, 0.5, 0.5, 1.0] and got[0][1] == pytest.approx(math.log(2)) and got[5][1] == 0
    assert spark.range(1).select(safe_cost(F.lit(float("nan"))).alias("c")).first()["c"] == 10.0
    cases = spark.createDataFrame([(0.7, 1, "E_invoke", "call"), (0.5, 1, "E_inherit", "class"), (0.5, 2, "E_contain", "method"), (0.3, 2, "E_contain", "class"), (0.2, 3, "E_import", "file"), (0.1, 1, "E_import", "file"), (0.5, 1, "E_invoke_candidate", "call"), (0.1, 1, "E_invoke_candidate", "call")], "s double, h int, r string, c string")
    assert [r[0] for r in cases.select(severity(F.col("s"), F.col("h"), F.col("r"), F.col("c"))).collect()] == ["CRITICAL", "HIGH", "HIGH", "MEDIUM", "MEDIUM", "LOW", "MEDIUM", "LOW"]


def test_evidence_paths_list_short_ones_first(spark):
    nodes = spark.createDataFrame([(i, c, c, "f", i, "function", "def", "", "") for i, c in enumerate("stab")], NODES)
    edges = spark.createDataFrame([(1, "s", "t", "E_contain", 1.0), (2, "t", "a", "E_invoke", 1.0), (3, "a", "s", "E_invoke", 1.0), (4, "b", "s", "E_invoke", 0.5)], "edge_seq long, src string, dst string, edge_type string, confidence double")
    got = {}
    for r in traversal.evidence_paths(nodes, edges, seeds_of(spark, "s")).orderBy("target", "path_no").collect():
        got.setdefault(r["target"], []).append(tuple(r["path"]))
    assert got == {"t": [("s", "t"), ("s", "a", "t")], "a": [("s", "a"), ("s", "t", "a")], "b": [("s", "b")]}


def test_history(spark):
    rows = [("c1", f) for f in ("auth.py", "test_auth.py")] + [("c2", "auth.py")] + [("big", f"f{i}") for i in range(41)] + [("late", "auth.py"), ("late", "x.py")]
    commits = spark.createDataFrame(rows, "hash string, file string")
    exclude = spark.createDataFrame([("late",)], "hash string")
    usable = history.usable_commits(commits, exclude=exclude)
    assert {r["file"]: r["commits"] for r in history.file_counts(usable).collect()} == {"auth.py": 2, "test_auth.py": 1}
    assert history.analysed_commits(commits).first()[0] == 4
    seed = spark.createDataFrame([("auth.py",)], "file string")
    r = history.co_changed_files(usable, seed).collect()
    assert [(x["target_file"], x["jaccard_score"], x["confidence"], x["support"]) for x in r] == [("test_auth.py", 0.5, 0.5, 1)]
    assert {x["file"]: x["evolution"] for x in history.evolution_scores(usable, seed).collect()} == {"test_auth.py": 0.5}


def test_tokens_and_fusion(spark, small):
    got = spark.createDataFrame([("def validateToken(user_id): return HTTPServer2x",), (None,)], "t string").select(code_tokens(F.col("t")).alias("k")).collect()
    assert set(got[0]["k"]) == {"def", "validatetoken", "validate", "token", "user_id", "user", "return", "httpserver2x", "http", "server2x"} and got[1]["k"] == []
    assert fusion.normalized_weights(0, 0, 0) == (0.65, 0.20, 0.15) and fusion.normalized_weights(1, 0, 0) == (1.0, 0.0, 0.0)
    _, _, nodes, table = small
    seeds = seeds_of(spark, "n00")
    ranking = traversal.rank_impact(nodes, table, seeds, 3, iterations=5, tolerance=None).cache()
    none = spark.createDataFrame([], "file string, evolution double")
    fused = fusion.fuse(nodes, seeds, ranking, none, fusion.lexical_scores(nodes, ""), 1.0, 0.0, 0.0, top_k=5).collect()
    assert len(fused) == 5 and all(r["hybrid_score"] == r["graph_score"] > 0 and r["evolution_score"] == r["semantic_score"] == 0 for r in fused)


def test_test_selection(spark):
    nodes = spark.createDataFrame([(1, "s", "pay", "a.py", 1, "function", "def", "", ""), (2, "t1", "test_pay", "tests/t.py", 1, "function", "def", "", ""), (3, "r1", "pay", "tests/t.py", 2, "call", "ref", "", ""), (4, "t2", "test_far", "tests/t.py", 5, "function", "def", "", ""), (5, "tf", "t.py", "tests/t.py", 1, "file", "def", "", ""), (6, "t3", "test_old", "tests/old.py", 1, "function", "def", "", "")], NODES)
    edges = spark.createDataFrame([(1, "t1", "r1", "E_contain", 1.0), (2, "r1", "s", "E_invoke", 0.95), (3, "tf", "s", "E_import", 1.0)], "edge_seq long, src string, dst string, edge_type string, confidence double")
    ranking = spark.createDataFrame([("t1", 0.3, 2, "E_contain", "test_pay")], "node_id string, impact_score double, hop_distance int, primary_relationship string, name string")
    co = spark.createDataFrame([("a.py", "tests/old.py", 0.5, 0.5, 3), ("a.py", "tests/gone.py", 1.0, 1.0, 2), ("a.py", "b.py", 1.0, 1.0, 2)], "source_file string, target_file string, jaccard_score double, confidence double, support long")
    got = [(r["test_node_id"], r["classification"], round(r["impact_score"], 4), r["requires_execution"]) for r in relevant_tests(nodes, edges, seeds_of(spark, "s"), ranking, co).collect()]
    assert got == [
        ("t1", "directly_related", 0.85, True),
        ("file:tests/gone.py", "historically_associated", 0.8, True),
        ("t3", "historically_associated", 0.45, True),
        ("t2", "candidate_review", 0.45, False),
        ("tf", "candidate_review", 0.45, False),
    ]


def test_metrics(spark):
    ranking = spark.createDataFrame([("x", 1), ("a", 2), ("b", 3), ("y", 4)], "item string, rank int")
    truth = spark.createDataFrame([("a",), ("b",), ("c",)], "item string")
    r = retrieval_metrics(ranking, truth, 3).first()
    ideal = 1 + 1 / math.log2(3) + 0.5
    assert (r["tp"], r["fp"], r["fn"], r["precision"], r["recall"], r["mrr"]) == (2, 1, 1, 66.67, 66.67, 0.5)
    assert r["ndcg"] == pytest.approx(100 * (1 / math.log2(3) + 0.5) / ideal, abs=0.01)


def test_paths_of_few_hops_are_the_cheapest_of_all(spark, monkeypatch):
    """Costs settle over any number of hops, in tables without paths; ties go to the smaller path."""
    rows = [(f"n{i}", f"n{(i * k + k) % 37}", ((i * 7 + k * 3) % 5) / 4) for i in range(37) for k in (1, 2, 5, 11)]
    rows = [r for r in rows if r[0] != r[1]] + [("n1", "n1", 0.0)]
    arrows = spark.createDataFrame(sorted({(a, b): c for a, b, c in rows}.items()), "p struct<src string, dst string>, cost double").select("p.*", "cost")
    seeds = spark.createDataFrame([("n0",), ("n3",)], "node_id string")
    every = sorted(tuple(r) for r in traversal.cheapest_paths(arrows, seeds).collect())
    wide = []
    keep = traversal.written
    monkeypatch.setattr(traversal, "written", lambda df, name: wide.append((name, str(df.schema))) or keep(df, name))
    for most in (0, 2, 3):
        got = sorted(tuple(r) for r in traversal.cheapest_paths(arrows, seeds, most).collect())
        assert got == [r for r in every if r[3] <= most]
    assert any(r[3] > 3 for r in every) and not any("path'" in s for name, s in wide if name == "paths")


def test_ranking_in_one_stage_is_that_of_the_loops(spark):
    kinds = ["E_invoke", "E_contain", "E_inherit", "E_override", "E_invoke_candidate", "other"]
    pairs = [(i, (i * 7 + j * j + 3) % 40) for i in range(40) for j in range(3) if i != (i * 7 + j * j + 3) % 40]
    one = {frozenset(p): p for p in pairs}.values()  # one edge for any two nodes
    edges = [(k, f"m{a:02}", f"m{b:02}", kinds[k % 6], [0.9, 0.5, None][k % 3]) for k, (a, b) in enumerate(one)]
    edges += [(900, "absent", "m01", "E_invoke", 1.0), (901, "m02", "gone", "E_contain", 1.0), (902, "m03", "m03", "E_invoke", 0.9)]
    e = spark.createDataFrame(edges, "edge_seq long, src string, dst string, edge_type string, confidence double")
    n = spark.createDataFrame([(i, f"m{i:02}", f"f{i % 4}", f"x{i}", 1, "function") for i in range(40)], "node_seq long, node_id string, file string, name string, line int, category string")
    seeds = spark.createDataFrame([("m00",), ("m05",), ("absent",)], "node_id string")
    want = {r["node_id"]: r.asDict() for r in traversal.rank_impact(n, e, seeds, 4).collect()}
    got = {r["node_id"]: r.asDict() for r in traversal.rank_linked(n, traversal.impact_links(e), seeds, 4).collect()}
    assert len(want) > 10 and got.keys() == want.keys()
    for k, row in want.items():
        assert got[k].pop("impact_score") == pytest.approx(row.pop("impact_score"), abs=1e-12)
        assert got[k] == row
    assert traversal.rank_linked(n.union(n.limit(1)), traversal.impact_links(e), seeds, 2) is None


def test_whole_ranking_writes_no_table_a_round(spark, sf_dir, monkeypatch):
    from ripplemark.plans import catalogue

    names, real = [], traversal.written
    for module in (traversal, catalogue, catalogue.bridge):
        monkeypatch.setattr(module, "written", lambda df, name: names.append(name) or real(df, name))
    monkeypatch.setattr(catalogue, "_RANKINGS", {})
    catalogue._whole_ranking(spark, sf_dir)
    assert "whole-ranking" in names and not {"ppr", "paths", "impact", "bridge-edges", "bridge-nodes"} & set(names)
