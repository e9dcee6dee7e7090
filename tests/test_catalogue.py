"""Every query of the catalogue against its DuckDB SQL on the smallest tables; imports without the training-data folders."""

import ast
import os
import pathlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from ripplemark.operators import traversal
from ripplemark.plans import bridge, catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ROOT = pathlib.Path(__file__).resolve().parent.parent


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and v != v:
        return None
    if isinstance(v, list | tuple | np.ndarray):
        return tuple(plain(x) for x in v)
    return str(v) if hasattr(v, "isoformat") else v


def rows(found, columns):
    at = [found[0].index(c) for c in columns]
    return sorted((tuple(plain(r[i]) for i in at) for r in found[1]), key=repr)


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query(spark, sf_dir, duck, name):
    df = catalogue.QUERIES[name](spark, sf_dir)
    got = (df.columns, [tuple(r) for r in df.collect()])
    if name not in catalogue.ORACLES:
        assert got[1]
        return
    cursor = duck.execute(catalogue.ORACLES[name])
    want = ([c[0] for c in cursor.description], cursor.fetchall())
    columns = sorted(got[0])
    assert sorted(want[0]) == columns
    assert rows(got, columns) == rows(want, columns)


def test_whole_ranking_takes_all_edges_and_settles(spark, sf_dir):
    arrows = traversal.impact_projection(bridge.graph(spark, sf_dir).edges, bridge.graph(spark, sf_dir).nodes.select("node_id", "node_seq")).toPandas()
    ids = sorted({r["node_id"] for r in bridge.graph(spark, sf_dir).nodes.select("node_id").collect()})
    at = {n: i for i, n in enumerate(ids)}
    src, dst, w = arrows["src"].map(at).to_numpy(), arrows["dst"].map(at).to_numpy(), arrows["weight"].to_numpy()
    out = np.bincount(src, w, len(ids))
    start = np.zeros(len(ids))
    seeds = [at[r["node_id"]] for r in bridge.part_seeds(spark, sf_dir).collect()]
    start[seeds] = 1 / len(seeds)
    p = start
    for _ in range(50):
        q = 0.15 * start + 0.85 * (np.bincount(dst, p[src] * w / out[src], len(ids)) + p[out == 0].sum() * start)
        done, p = np.abs(q - p).sum() < 1e-5, q
        if done:
            break
    top = p[start == 0].max()
    weight = {(a, b): x for a, b, x in zip(arrows["src"], arrows["dst"], arrows["weight"], strict=True)}
    got = catalogue._whole_ranking(spark, sf_dir)[3].select("node_id", "impact_score", "evidence_path").collect()
    for r in got:
        energy = np.prod([0.75 * weight[s["from"], s["to"]] for s in r["evidence_path"]])
        assert r["impact_score"] == pytest.approx(min(1, 0.65 * energy + 0.35 * p[at[r["node_id"]]] / top), abs=1e-6)
    kinds = {s["edge_type"] for r in got for s in r["evidence_path"]}
    assert {"E_invoke", "E_contain", "E_import", "E_invoke_candidate"} <= kinds


def test_whole_fusion_leaves_out_only_nodes_without_scores(spark, sf_dir, monkeypatch):
    real, given = catalogue.fusion.fuse, []
    monkeypatch.setattr(catalogue.fusion, "fuse", lambda *a, **b: given.append(a) or real(*a, **b))
    got = catalogue.QUERIES["hybrid_fusion_whole"](spark, sf_dir)
    n, s, ranking, evolution, _ = given[0]
    every = bridge.nodes(spark, sf_dir).withColumn("file", F.col("node_id"))
    assert n.count() < every.count()
    want = real(every, s, ranking, evolution, catalogue.fusion.lexical_scores(every, catalogue._DIFF))
    assert sorted(got.select("rank", "node_id", "severity").collect()) == sorted(want.select("rank", "node_id", "severity").collect())


def test_projection_of_sold_parts_needs_no_graph_on_disk(spark, sf_dir, monkeypatch):
    sold, own = bridge.edge_parts(spark, sf_dir)
    loop = spark.createDataFrame([(1, "a", "a", "k", "E_contain", 1.0), (2, "b", "b", "k", "E_invoke", 0.5)], sold.schema)
    for rows in (sold, loop):
        plain_, simple = traversal.impact_projection(rows), traversal.impact_projection(rows, simple=True)
        assert plain_.columns == simple.columns and sorted(map(tuple, plain_.collect())) == sorted(map(tuple, simple.collect()))
    both, whole = traversal.impact_projection(sold).unionByName(traversal.impact_projection(own)), traversal.impact_projection(sold.unionByName(own))
    assert both.exceptAll(whole).isEmpty() and whole.exceptAll(both).isEmpty()
    monkeypatch.setattr(bridge, "graph", lambda *a: pytest.fail("the graph was written"))
    assert catalogue.QUERIES["impact_projection"](spark, sf_dir).count() == 7


def test_library_stands_without_the_training_data_folders():
    for path in (ROOT / "ripplemark").rglob("*.py"):
        if "llm" in path.relative_to(ROOT).parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            if isinstance(node, ast.ImportFrom):
                assert "llm" not in (node.module or "").split(".") and "llm" not in [a.name for a in node.names], path
    assert os.path.exists(ROOT / "__spark_entry__.py")


def test_entry_points():
    import __spark_entry__ as e

    assert set(catalogue.QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
