"""Unified diffs to changed lines, and changed lines to seed nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def numbered_lines(diffs: DataFrame) -> DataFrame:
    """diffs (diff_id, text) to (diff_id, n, line)."""
    return diffs.select("diff_id", F.posexplode(F.split("text", "\r\n|\r|\n")).alias("n", "line"))


def changed_lines(lines: DataFrame) -> DataFrame:
    """(diff_id, file, line) that a diff adds, from (diff_id, n, line).

    A file is named by a line ``+++ b/``; a hunk's header sets the new line
    number; added and context lines advance it.  Other lines change nothing.
    """
    text = F.col("line")
    header = F.regexp_extract(text, r"^@@ -\d+(?:,\d+)? \+(\d+)(?:,\d+)? @@", 1)
    name = F.when(text.startswith("+++ b/"), F.trim(F.substring(text, 7, 1 << 20)))
    start = F.when(header != "", F.try_to_number(header, F.lit("999999999999")).cast("long"))
    passed = text.startswith("+++ ") | text.startswith("--- ")
    adds = text.startswith("+") & ~passed
    moves = adds | (text.startswith(" ") & ~passed)
    upto = Window.partitionBy("diff_id").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = lines.withColumns({"_name": name, "_start": start, "_moves": (moves & start.isNull()).cast("int"), "_adds": adds & start.isNull()})
    rows = rows.withColumns({"file": F.last("_name", ignorenulls=True).over(upto), "_hunk": F.count("_start").over(upto), "_from": F.last("_start", ignorenulls=True).over(upto)})
    inside = Window.partitionBy("diff_id", "_hunk").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("at", F.col("_from") + F.coalesce(F.sum("_moves").over(inside), F.lit(0)))
    rows = rows.filter("_adds and file is not null and at > 0")
    return rows.select("diff_id", "file", F.col("at").cast("int").alias("line")).distinct()


def diff_table(spark: SparkSession, text: str) -> DataFrame:
    return spark.createDataFrame([("diff", text)], "diff_id string, text string")


def matched_files(paths: DataFrame, changes: DataFrame) -> DataFrame:
    """(path, file): a graph path and a diff path of which one ends with the other.

    Of either side, the endings that are as long as some path of the other side
    are matched as keys, so this is two equi-joins.
    """
    own = paths.select(F.col("file").alias("path")).filter("path != ''").distinct()
    named = changes.select("file").filter("file != ''").distinct()

    def endings(of: DataFrame, column: str, other: DataFrame, name: str, key: str) -> DataFrame:
        sizes = F.broadcast(other.agg(F.collect_set(F.length(name)).alias("sizes")))  # one row, of as many numbers as paths have lengths
        fits = F.filter("sizes", lambda n: n <= F.length(column))
        return of.crossJoin(sizes).select(column, F.explode(F.transform(fits, lambda n: F.right(F.col(column), n))).alias(key))

    longer = endings(own, "path", named, "file", "file").join(named, "file")
    shorter = endings(named, "file", own, "path", "path").join(own, "path")
    return longer.select("path", "file").union(shorter.select("path", "file")).distinct()


def seed_nodes(nodes: DataFrame, changes: DataFrame, tolerance: int = 2, spans: bool = True) -> DataFrame:
    """(node_id) whose lines a change touches, or nearly; where a file's change touches none, its file, functions and classes.

    With spans=False only a node's first line counts.
    """
    pairs = matched_files(nodes, changes)
    touched = changes.join(pairs, "file").select(F.col("path").alias("file"), F.col("line").alias("at"), F.col("file").alias("diff_file"))
    end = F.col("end_line") if spans else F.col("line")
    near = (F.abs(F.col("line") - F.col("at")) <= tolerance) | (F.abs(end - F.col("at")) <= tolerance) | ((F.col("line") <= F.col("at")) & (F.col("at") <= end))
    hits = nodes.join(touched, "file").filter(near).select("node_id", "file", "diff_file").distinct()
    missed = touched.select("file", "diff_file").distinct().join(hits.select("file", "diff_file").distinct(), ["file", "diff_file"], "left_anti").select("file").distinct()
    rest = nodes.filter(F.col("category").isin("file", "function", "class")).join(missed, "file", "left_semi").select("node_id")
    return hits.select("node_id").union(rest).distinct()


def seeds_or_first(nodes: DataFrame, seeds: DataFrame) -> DataFrame:
    """seeds; without any, the graph's first function, method or class."""
    if not seeds.isEmpty():
        return seeds
    return nodes.filter(F.col("category").isin("function", "method", "class")).orderBy("node_seq").limit(1).select("node_id")
