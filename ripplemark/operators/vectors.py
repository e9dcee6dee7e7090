"""Nearest vectors by cosine: a set of queries against all rows, in blocks."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Queries in a block, and blocks that share a task.
BLOCK, BLOCKS = 1024, 32


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), float).reshape(-1, width)


def nearest_by_cosine(vectors: DataFrame, queries: DataFrame, k: int, digits: int = 4) -> DataFrame:
    """(query_id, vec_id, score) of each query's k nearest of vectors (id, e), by score rounded, then the smaller id.

    All vectors have one width and none is null.  Queries are packed in blocks;
    the vectors are dealt to tasks once for each BLOCKS blocks, and a task meets
    them batch by batch, so nothing but the blocks is held.
    """
    n = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    count, width = queries.agg(F.count("*"), F.max(F.size("e"))).first()
    if not count:
        return queries.sparkSession.createDataFrame([], "query_id long, vec_id long, score double")
    blocks = math.ceil(count / BLOCK)
    groups = math.ceil(blocks / BLOCKS)
    slack = 2 * 10.0**-digits
    ahead = queries.withColumn("group", F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int")).withColumn("split", F.explode(F.sequence(F.lit(0), F.lit(max(1, n // groups) - 1))))
    after = vectors.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).withColumn("split", F.pmod(F.xxhash64("id"), F.lit(max(1, n // groups))).cast("int"))
    both = ahead.select("group", "split", F.lit(0).alias("kind"), "id", "e").unionByName(after.select("group", "split", F.lit(1).alias("kind"), "id", "e"))

    def walk(batches):
        now, ids, parts, asked = None, [], [], None
        for batch in batches:
            group, split, kind = (batch.column(i).to_numpy() for i in range(3))
            cuts = np.flatnonzero((np.diff(group) != 0) | (np.diff(split) != 0) | (np.diff(kind) != 0)) + 1
            for low, high in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
                if low == high:
                    continue
                x, own = _matrix(batch.column(4).slice(low, high - low), width), batch.column(3).slice(low, high - low).to_numpy()
                x = x / np.sqrt(np.square(x).sum(axis=1))[:, None]
                if kind[low] == 0:
                    if now != (group[low], split[low]):
                        now, ids, parts = (group[low], split[low]), [], []
                    ids.append(own)
                    parts.append(x)
                    asked = None
                    continue
                if now != (group[low], split[low]):
                    continue  # no query in this task
                asked = asked or (np.concatenate(ids), np.concatenate(parts))
                for at in range(0, len(asked[0]), BLOCK):
                    names, q = asked[0][at : at + BLOCK], asked[1][at : at + BLOCK]
                    score = q @ x.T
                    score[names[:, None] == own[None, :]] = -np.inf
                    least = np.partition(score, -k, axis=1)[:, -k] if score.shape[1] > k else np.full(len(names), -np.inf)
                    r, c = np.nonzero((score >= least[:, None] - slack) & (score > -np.inf))
                    yield pa.RecordBatch.from_arrays([pa.array(names[r]), pa.array(own[c]), pa.array(score[r, c])], names=["query_id", "vec_id", "score"])

    found = both.repartition(n, "group", "split").sortWithinPartitions("group", "split", "kind", "id").mapInArrow(walk, "query_id long, vec_id long, score double")
    found = found.withColumn("score", F.round("score", digits) + 0.0)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= k).drop("r")
