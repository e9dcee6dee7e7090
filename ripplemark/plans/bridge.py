"""The driver's tables as an impact graph.

Customers are files, orders are functions in them, an order's parts are call
sites, parts are the functions called (with their type as base class and brand
as interface), suppliers are what a call might also mean, and every hundredth
part overrides the one a hundred before it.  Commits are orders,
changed files are their parts.
"""

from __future__ import annotations

from functools import cached_property, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..durable import written
from ..schema import CANDIDATE, CONTAIN, IMPLEMENT, IMPORT, INHERIT, INVOKE, OVERRIDE


_SCHEMAS: dict[tuple[str, str], StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    path = f"{sf_dir}/{name}.parquet"
    key = (spark.sparkContext.applicationId, path)
    if key not in _SCHEMAS:  # asking for one is a job
        _SCHEMAS[key] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[key]).parquet(path)


def tag(kind: str, *columns: str):
    """kind:a:b from columns."""
    return F.concat_ws(":", F.lit(kind), *[F.col(c).cast("string") for c in columns])


def call_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(l_orderkey, l_partkey, confidence): an order's distinct parts, surer the smaller the greatest discount.

    Dealt by order, so that joins with orders need no second shuffle.
    """
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_discount").repartition("l_orderkey").groupBy("l_orderkey", "l_partkey").agg((1 - F.max("l_discount")).alias("confidence"))


def edge_parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The edges in two: those of sold parts, of which grouping leaves one for any two nodes, and those of the tables' own rows."""
    t = lambda name: table(spark, sf_dir, name)
    line = tag("line", "l_orderkey", "l_partkey")
    one = F.lit(1.0)

    def edge(src, dst, kind: str, confidence):
        return F.struct(src.alias("src"), dst.alias("dst"), F.lit(kind).alias("edge_type"), confidence.alias("confidence"))

    def made(df: DataFrame, src, dst, kind: str, confidence) -> DataFrame:
        return df.select(edge(src, dst, kind, confidence).alias("e")).select("e.*")

    sites = call_sites(spark, sf_dir)
    both = F.array(edge(line, tag("part", "l_partkey"), INVOKE, F.col("confidence")), edge(tag("order", "l_orderkey"), line, CONTAIN, one))
    sold = [
        sites.select(F.explode(both).alias("e")).select("e.*"),
        made(t("lineitem").select("l_orderkey", "l_partkey", "l_suppkey").distinct(), line, tag("supp", "l_suppkey"), CANDIDATE, F.lit(0.35)),
        made(sites.join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).select("o_custkey", "l_partkey").distinct(), tag("cust", "o_custkey"), tag("part", "l_partkey"), IMPORT, one),
    ]
    own = [
        made(t("orders"), tag("cust", "o_custkey"), tag("order", "o_orderkey"), CONTAIN, one),
        made(t("customer"), tag("nation", "c_nationkey"), tag("cust", "c_custkey"), CONTAIN, one),
        made(t("supplier"), tag("nation", "s_nationkey"), tag("supp", "s_suppkey"), CONTAIN, one),
        made(t("nation"), tag("region", "n_regionkey"), tag("nation", "n_nationkey"), CONTAIN, one),
        made(t("part"), tag("part", "p_partkey"), tag("type", "p_type"), INHERIT, one),
        made(t("part"), tag("part", "p_partkey"), tag("brand", "p_brand"), IMPLEMENT, one),
        made(t("part").filter("p_partkey > 100 and p_partkey % 100 = 3").withColumn("base", F.col("p_partkey") - 100), tag("part", "p_partkey"), tag("part", "base"), OVERRIDE, one),
    ]
    named = lambda rows: rows.select(F.xxhash64("src", "dst", "edge_type").alias("edge_seq"), "src", "dst", F.concat_ws(":", "edge_type", "dst").alias("key"), "edge_type", "confidence")
    return named(reduce(DataFrame.unionByName, sold)), named(reduce(DataFrame.unionByName, own))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(edge_seq, src, dst, key, edge_type, confidence); the sequence is a hash of the ends."""
    sold, own = edge_parts(spark, sf_dir)
    return sold.unionByName(own)


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the graph; the sequence is a hash of the id."""
    t = lambda name: table(spark, sf_dir, name)

    def made(df: DataFrame, node_id, file, name, kind: str, category: str, snippet=None) -> DataFrame:
        return df.select(node_id.alias("node_id"), file.alias("file"), name.cast("string").alias("name"), F.lit(kind).alias("type"), F.lit(category).alias("category"), (snippet if snippet is not None else F.lit("")).alias("snippet"))

    sites = call_sites(spark, sf_dir).join(t("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    parts = [
        made(t("region"), tag("region", "r_regionkey"), F.lit("region"), F.col("r_name"), "def", "file"),
        made(t("nation"), tag("nation", "n_nationkey"), F.lit("nation"), F.col("n_name"), "def", "file"),
        made(t("customer"), tag("cust", "c_custkey"), tag("cust", "c_custkey"), F.col("c_name"), "def", "file"),
        made(t("supplier"), tag("supp", "s_suppkey"), F.lit("supplier"), F.col("s_name"), "def", "function"),
        made(t("orders"), tag("order", "o_orderkey"), tag("cust", "o_custkey"), tag("order", "o_orderkey"), "def", "function", F.col("o_orderpriority")),
        made(sites, tag("line", "l_orderkey", "l_partkey"), tag("cust", "o_custkey"), tag("part", "l_partkey"), "ref", "call"),
        made(t("part"), tag("part", "p_partkey"), F.col("p_brand"), F.col("p_name"), "def", "function", F.col("p_type")),
        made(t("part").select("p_type").distinct(), tag("type", "p_type"), F.lit("types"), F.col("p_type"), "def", "class"),
        made(t("part").select("p_brand").distinct(), tag("brand", "p_brand"), F.lit("brands"), F.col("p_brand"), "def", "interface"),
    ]
    rows = parts[0]
    for other in parts[1:]:
        rows = rows.unionByName(other)
    return rows.select(F.xxhash64("node_id").alias("node_seq"), "*", F.lit(1).alias("line"), F.lit(1).alias("end_line"), F.lit("").alias("docstring"), F.lit("").alias("signature"))


class TableGraph:
    """The graph as written tables, each made when first asked for: loops read them many times."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    @cached_property
    def nodes(self) -> DataFrame:
        return written(nodes(self.spark, self.sf_dir), "bridge-nodes")

    @cached_property
    def edges(self) -> DataFrame:
        return written(edges(self.spark, self.sf_dir), "bridge-edges")


_GRAPHS: dict[tuple[str, str], TableGraph] = {}


def graph(spark: SparkSession, sf_dir: str) -> TableGraph:
    """One graph a session and folder."""
    return _GRAPHS.setdefault((spark.sparkContext.applicationId, sf_dir), TableGraph(spark, sf_dir))


def part_seeds(spark: SparkSession, sf_dir: str, upto: int = 3) -> DataFrame:
    return table(spark, sf_dir, "part").filter(F.col("p_partkey") <= upto).select(tag("part", "p_partkey").alias("node_id"))


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(hash, file): an order's distinct parts."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("hash"), tag("part", "l_partkey").alias("file")).distinct()
