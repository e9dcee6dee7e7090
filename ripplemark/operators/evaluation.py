"""How well rankings find a symbol's call sites and tests: five set-ups, and the test selection alone."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..durable import written
from ..schema import INVOKE
from . import fusion, history
from .linking import Graph, build_graph
from .metrics import most_called, retrieval_metrics
from .test_selection import relevant_tests
from .traversal import ego_nodes, impact_roles, induced_edges, rank_impact, ranked, seed_pagerank

#: The set-ups, in order: one edge a pair and one step; all edges and two steps; ranked; fused; fused with tests.
SETUPS = ("m_base", "m_no_weight", "m_weight", "m_hybrid", "m_complete")


def seed_by_symbol(nodes: DataFrame, edges: DataFrame, symbol: str) -> DataFrame:
    """(node_id) of the definitions named symbol; without any, of the definition that most call edges lead to."""
    named = nodes.filter((F.col("type") == "def") & (F.col("name") == symbol)).select("node_id")
    if not named.isEmpty():
        return named
    return most_called(nodes, edges)


def call_sites_of(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(item) of the nodes with a call edge into a seed."""
    into = edges.filter(F.col("edge_type") == INVOKE).join(seeds.select(F.col("node_id").alias("dst")), "dst", "left_semi")
    return into.select(F.col("src").alias("item")).distinct()


def lexical_candidates(files: DataFrame, nodes: DataFrame, symbol: str) -> DataFrame:
    """(item, rank) of the nodes on lines that hold symbol, in order of files, lines and nodes."""
    lines = files.select("seq", F.col("path").alias("file"), F.posexplode(F.split("content", "\r\n|\n|\r")).alias("at", "text"))
    hits = lines.filter(F.col("text").contains(symbol)).select("seq", "file", (F.col("at") + 1).alias("line"))
    found = nodes.join(hits, ["file", "line"]).groupBy("node_id").agg(F.min(F.struct("seq", "line", "node_seq")).alias("place"))
    return ranked(found.select(F.col("node_id").alias("item"), F.lit(0).alias("same"), "place"), "same", "place").select("item", "rank")


def _in_order(rows: DataFrame, *order: str) -> DataFrame:
    """(item, rank) of the rows (node_id, ...) of one answer, in order."""
    place = F.struct(*order)
    return ranked(rows.select(F.col("node_id").alias("item"), F.lit(0).alias("same"), place.alias("place")), "same", "place").select("item", "rank")


def _callers(graph: Graph, seeds: DataFrame, k: int, flags: tuple[str, ...]) -> DataFrame:
    """(item, rank) of the nodes of the k-step neighbourhood with one of the roles, role by role."""
    ego = graph.nodes.join(ego_nodes(graph.edges, seeds, k).select("node_id"), "node_id", "left_semi")
    roles = impact_roles(ego, induced_edges(graph.edges, ego), seeds).join(graph.nodes.select("node_id", "node_seq"), "node_id")
    kind = reduce(lambda out, f: out.when(F.col(f[1]), f[0]), enumerate(flags), F.when(F.lit(False), -1))
    return _in_order(roles.withColumn("kind", kind).filter("kind is not null"), "kind", "node_seq")


def _built(files: DataFrame, multigraph: bool = True) -> Graph:
    made = build_graph(files, multigraph)
    return Graph(written(made.nodes, "nodes"), written(made.edges, "edges"))


def ablation(files: DataFrame, symbol: str, diff_text: str, commits: DataFrame | None = None, k: int = 10, full: Graph | None = None) -> DataFrame:
    """(setup, tp, fp, fn, precision, recall, f1, mrr, ndcg) of finding the call sites of symbol. full: the graph, if it is there."""
    spark = files.sparkSession
    full, flat = full or _built(files), _built(files, multigraph=False)
    seeds = written(seed_by_symbol(full.nodes, full.edges, symbol), "seeds")
    truth = written(call_sites_of(full.edges, seeds), "truth")
    ppr = seed_pagerank(full.nodes, full.edges, seeds)
    near, wide = (written(rank_impact(full.nodes, full.edges, seeds, hops, ppr=ppr), "ranking") for hops in (2, 3))
    seed_files = full.nodes.join(seeds, "node_id", "left_semi").select("file").distinct()
    evolution = history.evolution_scores(history.usable_commits(commits), seed_files) if commits is not None else spark.createDataFrame([], "file string, evolution double")
    fused = written(fusion.fuse(full.nodes, seeds, wide, evolution, fusion.lexical_scores(full.nodes, diff_text)).select(F.col("node_id").alias("item"), "rank"), "fused")
    tests = relevant_tests(full.nodes, full.edges, seeds, near)
    answers = {
        "m_base": _callers(flat, seeds, 1, ("is_direct",)),
        "m_no_weight": _callers(full, seeds, 2, ("is_direct", "is_indirect")),
        "m_weight": near.select(F.col("node_id").alias("item"), "rank"),
        "m_hybrid": fused,
        "m_complete": _after(fused, tests_in_order(tests)),
    }
    every = reduce(DataFrame.unionByName, [rows.select(F.lit(name).alias("setup"), "item", F.col("rank").cast("int").alias("rank")) for name, rows in answers.items()])
    setups = spark.createDataFrame([(name,) for name in SETUPS], "setup string")
    return retrieval_metrics(every, setups.crossJoin(F.broadcast(truth)), k, ["setup"])  # five rows beside the truth


def _after(first: DataFrame, then: DataFrame) -> DataFrame:
    """Two rankings as one, items of the first before those that only the second has."""
    both = first.select("item", F.lit(0).alias("part"), "rank").unionByName(then.select("item", F.lit(1).alias("part"), "rank"))
    place = both.groupBy("item").agg(F.min(F.struct("part", "rank")).alias("place"))
    return ranked(place.select("item", F.lit(0).alias("same"), "place"), "same", "place").select("item", "rank")


def tests_in_order(tests: DataFrame) -> DataFrame:
    """(item, rank) of selected tests, in the order in which they are listed."""
    numbered = written(tests.withColumn("place", F.monotonically_increasing_id()), "tests")  # rows come sorted
    return ranked(numbered.select(F.col("test_node_id").alias("item"), F.lit(0).alias("same"), "place"), "same", "place").select("item", "rank")


def test_benchmark(graph: Graph, symbol: str, file_part: str, name_part: str, commits: DataFrame | None = None, k: int = 5) -> DataFrame:
    """tp ... ndcg of the tests selected for a change of symbol, against the nodes whose file and name hold the parts."""
    nodes, edges = graph.nodes, graph.edges
    seeds = written(seed_by_symbol(nodes, edges, symbol), "seeds")
    ranking = written(rank_impact(nodes, edges, seeds, 2), "ranking")
    seed_files = nodes.join(seeds, "node_id", "left_semi").select("file").distinct()
    co = history.co_changed_files(history.usable_commits(commits), seed_files) if commits is not None else None
    truth = nodes.filter(F.col("file").contains(file_part) & F.lower("name").contains(name_part.lower())).select(F.col("node_id").alias("item"))
    return retrieval_metrics(tests_in_order(relevant_tests(nodes, edges, seeds, ranking, co)), truth, k)


def evaluation(files: DataFrame, symbol: str, diff_text: str, commits: DataFrame | None = None, file_part: str = "test", name_part: str | None = None) -> dict:
    """Both tables as plain values."""
    graph = _built(files)
    rows = {r["setup"]: r.asDict() for r in ablation(files, symbol, diff_text, commits, full=graph).collect()}  # five rows
    tests = test_benchmark(graph, symbol, file_part, name_part or symbol.split("_")[0], commits).first()
    return {
        "evaluation_symbol": symbol,
        "table_3_ablation": {name: {k: v for k, v in rows[name].items() if k != "setup"} for name in SETUPS if name in rows},
        "table_4_test_impact": tests.asDict() if tests else {},
    }
