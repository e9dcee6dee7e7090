"""Retrieval metrics of ranked lists against relevant items."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .traversal import ranked


def retrieval_metrics(ranking: DataFrame, truth: DataFrame, k: int = 10, by: list[str] | None = None) -> DataFrame:
    """tp, fp, fn, precision, recall, f1 (in %), mrr and ndcg (in %) of ranking (by..., item, rank) for truth (by..., item).

    Precision is over the listed items among the first k, reciprocal rank over the whole list.
    """
    by = by or []
    truth = truth.select(*by, "item").distinct()
    marked = ranking.join(truth.withColumn("_hit", F.lit(1)), [*by, "item"], "left").withColumn("_hit", F.coalesce("_hit", F.lit(0)))
    top = F.col("rank") <= k
    hit = F.col("_hit") == 1
    gain = F.when(top & hit, 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)
    got = marked.groupBy(*by).agg(F.count_if(top & hit).alias("tp"), F.count_if(top & ~hit).alias("fp"), F.min(F.when(hit, F.col("rank"))).alias("_first"), F.sum(gain).alias("_dcg"))
    size = truth.groupBy(*by).agg(F.count("*").alias("_n"))
    rows = size.join(got, by, "left") if by else size.crossJoin(got)
    rows = rows.na.fill(0, ["tp", "fp"]).na.fill(0.0, ["_dcg"]).withColumn("fn", F.col("_n") - F.col("tp"))
    p = F.when(F.col("tp") + F.col("fp") > 0, 100.0 * F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(0.0)
    r = F.when(F.col("_n") > 0, 100.0 * F.col("tp") / F.col("_n")).otherwise(0.0)
    rows = rows.withColumns({"_p": p, "_r": r})
    f1 = F.when(F.col("_p") + F.col("_r") > 0, 2 * F.col("_p") * F.col("_r") / (F.col("_p") + F.col("_r"))).otherwise(0.0)
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.lit(k), F.col("_n").cast("int")))), F.lit(0.0), lambda acc, i: acc + 1 / F.log2(i + 1))
    ndcg = F.when(F.col("_n") > 0, 100.0 * F.col("_dcg") / ideal).otherwise(0.0)
    mrr = F.coalesce(1 / F.col("_first"), F.lit(0.0))
    return rows.select(*by, "tp", "fp", "fn", F.round("_p", 2).alias("precision"), F.round("_r", 2).alias("recall"), F.round(f1, 2).alias("f1"), F.round(mrr, 4).alias("mrr"), F.round(ndcg, 2).alias("ndcg"))


def substring_ranking(lines: DataFrame, symbol: str) -> DataFrame:
    """(item, rank) of the lines (item, text, place) that contain symbol, in order: the plainest baseline."""
    found = lines.filter(F.col("text").contains(symbol)).select("item", "place", F.lit(0).alias("same"))
    return ranked(found, "same", "place").select("item", "rank")


def most_called(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node_id) of the definition with most call edges into it."""
    calls = edges.filter("edge_type = 'E_invoke'").groupBy(F.col("dst").alias("node_id")).agg(F.count("*").alias("n"))
    return calls.join(nodes.filter("type = 'def'").select("node_id", "node_seq"), "node_id").orderBy(F.desc("n"), "node_seq").limit(1).select("node_id")
