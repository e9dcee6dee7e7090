"""The whole analysis of a change: files, diff and history in; rankings, tests, errors and a report out."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .durable import written
from .operators import fusion, history, report
from .operators.linking import Graph, build_graph, graph_counts
from .operators.seeds import changed_lines, diff_table, numbered_lines, seed_nodes, seeds_or_first
from .operators.test_selection import relevant_tests
from .operators.traversal import ego_nodes, evidence_paths, impact_roles, induced_edges, node_status, predicted_errors, rank_impact, seed_pagerank
from .schema import DEFAULT_K
from .sources.files import DEFAULT_DIFF, commits_from_git, files_from_dict, files_from_dir, working_diff
from .sources.sinks import rows_of


@dataclass
class ImpactEngine:
    """A graph, written out once, that changes are asked about."""

    spark: SparkSession
    graph: Graph

    @classmethod
    def from_files(cls, files: DataFrame, multigraph: bool = True) -> ImpactEngine:
        built = build_graph(files, multigraph)
        return cls(files.sparkSession, Graph(written(built.nodes, "nodes"), written(built.edges, "edges")))

    @classmethod
    def from_source(cls, spark: SparkSession, source: str | dict[str, str], multigraph: bool = True) -> ImpactEngine:
        """A folder's path, or {path: content}."""
        files = files_from_dict(spark, source) if isinstance(source, dict) else files_from_dir(spark, source)
        return cls.from_files(files, multigraph)

    def seeds(self, diff_text: str) -> DataFrame:
        changes = changed_lines(numbered_lines(diff_table(self.spark, diff_text)))
        return written(seeds_or_first(self.graph.nodes, seed_nodes(self.graph.nodes, changes)), "seeds")

    def analyse(self, diff_text: str = DEFAULT_DIFF, k: int = DEFAULT_K, commits: DataFrame | None = None, repo: str = "", model: Callable | None = None) -> dict:
        """Everything about one change, as plain values."""
        nodes, edges = self.graph.nodes, self.graph.edges
        seeds = self.seeds(diff_text)
        ego = written(nodes.join(ego_nodes(edges, seeds, k).select("node_id"), "node_id", "left_semi"), "ego-nodes")
        ego_edges = written(induced_edges(edges, ego), "ego-edges")
        roles = written(impact_roles(ego, ego_edges, seeds), "roles")
        lines = numbered_lines(diff_table(self.spark, diff_text))
        ppr = seed_pagerank(nodes, edges, seeds)
        ranking = written(rank_impact(nodes, edges, seeds, k, ppr=ppr), "ranking")
        wide = ranking if k == 3 else written(rank_impact(nodes, edges, seeds, 3, ppr=ppr), "ranking-wide")
        seed_files = nodes.join(seeds, "node_id", "left_semi").select("file").distinct()
        co = history.co_changed_files(history.usable_commits(commits), seed_files) if commits is not None else None
        evolution = history.evolution_scores(history.usable_commits(commits), seed_files) if commits is not None else self.spark.createDataFrame([], "file string, evolution double")
        fused = fusion.fuse(nodes, seeds, wide, evolution, fusion.lexical_scores(nodes, diff_text))
        tests = rows_of(relevant_tests(nodes, edges, seeds, ranking, co))
        status = node_status(ego, roles, seeds)
        paths: dict[str, list] = {}
        for r in rows_of(evidence_paths(ego, ego_edges, seeds).orderBy("target", "path_no")):
            paths.setdefault(r["target"], []).append([{"node_id": n, **({"edge_type": s["edge_type"], "confidence": s["confidence"]} if s else {})} for n, s in zip(r["path"], [None, *r["steps"]], strict=True)])
        of = lambda flag: rows_of(ego.join(roles.filter(flag), "node_id", "left_semi").orderBy("node_seq").drop("node_seq"))
        errors = rows_of(predicted_errors(ego, ego_edges, seeds, lines).drop("seed", "node_id").orderBy("file", "line", "error_type"))
        summary = {
            "seeds": rows_of(nodes.join(seeds, "node_id", "left_semi").orderBy("node_seq").drop("node_seq")),
            "direct": of("is_direct"),
            "indirect": of("is_indirect"),
            "candidates": of("is_candidate"),
            "files": sorted(r["file"] for r in ego.filter("file != ''").select("file").distinct().collect()),
            "tests": tests,
            "errors": errors,
        }
        context = report.serialize_context(ego, ego_edges, seeds, diff_text, tests)
        counts = graph_counts(self.graph)
        return {
            "success": True,
            "repo": repo,
            "diff_text": diff_text,
            "k_hops": k,
            "nodes": rows_of(ego.join(status, "node_id").orderBy("node_seq").select(F.col("node_id").alias("id"), "name", "file", "line", "end_line", "category", "type", "status", "signature", "snippet", "docstring", "parent_scope")),
            "edges": rows_of(ego_edges.orderBy("edge_seq").select(F.col("src").alias("source"), F.col("dst").alias("target"), "edge_type", F.coalesce("confidence", F.lit(1.0)).alias("confidence"), F.coalesce("symbol", F.lit("")).alias("symbol"))),
            "seed_nodes": summary["seeds"],
            "affected_files": summary["files"],
            "direct_callers_count": len(summary["direct"]),
            "indirect_callers_count": len(summary["indirect"]),
            "total_nodes_in_repo": counts["nodes"],
            "total_edges_in_repo": counts["edges"],
            "ego_nodes_count": ego.count(),
            "ego_edges_count": ego_edges.count(),
            "evidence_paths": paths,
            "predicted_errors": errors,
            "ranked_impact_nodes": rows_of(ranking.orderBy("rank").withColumn("impact_score", F.round("impact_score", 4)).drop("node_seq")),
            "git_co_changes": rows_of(co.withColumns({c: F.round(c, 4) for c in ("jaccard_score", "confidence")})) if co is not None else [],
            "hybrid_rankings": rows_of(fused.orderBy("rank").withColumns({c: F.round(c, 4) for c in ("hybrid_score", "graph_score", "evolution_score", "semantic_score")})),
            "test_recommendations": [t | {"impact_score": round(t["impact_score"], 4)} for t in tests],
            "markdown_report": report.write_report(summary, model, context, diff_text),
        }


def analyse_repository(spark: SparkSession, path: str, diff_text: str | None = None, k: int = DEFAULT_K, with_history: bool = True, model: Callable | None = None) -> dict:
    """A checked-out folder; its own diff and history where they can be had."""
    engine = ImpactEngine.from_source(spark, path)
    commits = commits_from_git(spark, path) if with_history else None
    return engine.analyse(diff_text or working_diff(path) or DEFAULT_DIFF, k, commits, path, model)
