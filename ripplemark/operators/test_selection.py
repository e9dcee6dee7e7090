"""Which tests a change concerns: direct, indirect, by history, or worth a look."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.code import is_test
from ..schema import CONTAIN, IMPORT, INVOKE

COLUMNS = ("test_file", "test_name", "test_node_id", "classification", "impact_score", "relationship_type", "evidence", "reason", "requires_execution")


def test_functions(nodes: DataFrame) -> DataFrame:
    return nodes.filter((F.col("type") == "def") & F.col("category").isin("function", "method") & is_test(F.col("file"), F.col("name")))


def direct_tests(nodes: DataFrame, edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(node_id, seed_name) of tests that call a seed, or hold a call site that does."""
    names = nodes.select(F.col("node_id").alias("dst"), F.col("name").alias("seed_name"))
    into = edges.filter(F.col("edge_type") == INVOKE).join(seeds.select(F.col("node_id").alias("dst")).distinct(), "dst", "left_semi").join(names, "dst").select("src", "seed_name")
    held = edges.filter(F.col("edge_type") == CONTAIN).select(F.col("src").alias("node_id"), F.col("dst").alias("src"))
    rows = into.join(held, "src").select("node_id", "seed_name").union(into.select(F.col("src").alias("node_id"), "seed_name"))
    return rows.join(test_functions(nodes).select("node_id"), "node_id", "left_semi").groupBy("node_id").agg(F.min("seed_name").alias("seed_name"))


def relevant_tests(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, ranking: DataFrame, co_changes: DataFrame | None = None) -> DataFrame:
    """One row a test, by its first class that applies; the highest scores first."""
    place = nodes.select("node_id", "node_seq", F.col("file").alias("test_file"), F.col("name").alias("test_name"))
    tests = test_functions(nodes).select("node_id")
    scores = ranking.select("node_id", "impact_score", "hop_distance", "primary_relationship", "name")
    direct = direct_tests(nodes, edges, seeds).join(scores.select("node_id", "impact_score"), "node_id", "left")
    direct = direct.select("node_id", F.lit(1).alias("k"), F.lit("directly_related").alias("classification"), F.greatest(F.lit(0.85), F.coalesce("impact_score", F.lit(0.95))).alias("impact_score"), F.lit(INVOKE).alias("relationship_type"), F.col("seed_name").alias("evidence"), F.concat(F.lit("The test calls the changed '"), "seed_name", F.lit("'.")).alias("reason"), F.lit(True).alias("requires_execution"))
    indirect = scores.join(tests, "node_id", "left_semi").filter("hop_distance <= 3 and impact_score >= 0.20")
    indirect = indirect.select("node_id", F.lit(2).alias("k"), F.lit("indirectly_related").alias("classification"), "impact_score", F.col("primary_relationship").alias("relationship_type"), F.col("name").alias("evidence"), F.concat(F.lit("The test reaches the change in "), F.col("hop_distance").cast("string"), F.lit(" steps.")).alias("reason"), F.lit(True).alias("requires_execution"))
    files = seeds.select("node_id").distinct().join(nodes, "node_id").select(F.col("file").alias("seed_file")).distinct()
    homes = nodes.filter("category = 'file'").groupBy("file").agg(F.min_by("node_id", "node_seq").alias("src"))
    where = nodes.select(F.col("node_id").alias("dst"), F.col("file").alias("seed_file"))
    imports = edges.filter(F.col("edge_type") == IMPORT).select("src", "dst").join(where, "dst").join(files, "seed_file", "left_semi").join(homes, "src").groupBy("file").agg(F.min("seed_file").alias("seed_file"))
    review = nodes.filter((F.col("type") == "def") & is_test(F.col("file"), F.col("name"))).join(imports, "file")
    review = review.select("node_id", F.lit(4).alias("k"), F.lit("candidate_review").alias("classification"), F.lit(0.45).alias("impact_score"), F.lit(IMPORT).alias("relationship_type"), F.col("seed_file").alias("evidence"), F.concat(F.lit("The test's file imports the changed '"), "seed_file", F.lit("'.")).alias("reason"), F.lit(False).alias("requires_execution"))
    rows = direct.unionByName(indirect).unionByName(review)
    lone = None
    if co_changes is not None:
        near = co_changes.filter(is_test(F.col("target_file")) & (F.col("jaccard_score") >= 0.10))
        first = Window.partitionBy("target_file").orderBy(F.desc("jaccard_score"), F.desc("confidence"), "source_file")
        near = near.withColumn("_r", F.row_number().over(first)).filter("_r = 1").select(F.col("target_file").alias("file"), "jaccard_score", "support")
        score = F.least(F.lit(0.80), F.col("jaccard_score") * 0.90)
        why = F.concat(F.lit("The test's file changed with the modified ones in "), F.col("support").cast("string"), F.lit(" commits."))
        shared = [F.lit("historically_associated").alias("classification"), score.alias("impact_score"), F.lit("git_co_change").alias("relationship_type"), F.col("file").alias("evidence"), why.alias("reason"), F.lit(True).alias("requires_execution")]
        defs = nodes.filter("type = 'def' and category in ('function', 'method')").select("node_id", "file")
        rows = rows.unionByName(near.join(defs, "file").select("node_id", F.lit(3).alias("k"), *shared))
        lone = near.join(defs.select("file").distinct(), "file", "left_anti").select(F.col("file").alias("test_file"), F.element_at(F.split("file", "/"), -1).alias("test_name"), F.concat(F.lit("file:"), "file").alias("test_node_id"), *shared)
    rows = rows.withColumn("_r", F.row_number().over(Window.partitionBy("node_id").orderBy("k"))).filter("_r = 1")
    out = rows.join(place, "node_id").withColumn("test_node_id", F.col("node_id")).select(*COLUMNS, "k", "node_seq")
    if lone is not None:
        out = out.unionByName(lone.select(*COLUMNS, F.lit(3).alias("k"), F.lit(1 << 62).alias("node_seq")))
    return out.orderBy(F.desc("impact_score"), "k", "node_seq", "test_node_id").select(*COLUMNS)
