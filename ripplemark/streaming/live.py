"""Streams beside the batch operators: event windows, co-change by session, a watched source tree."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.parsing import parse_files


def event_windows(events: DataFrame, width: str = "1 day", late: str | None = None) -> DataFrame:
    """(window_start, event_type, events, total): tumbling windows; late is how long a stream waits for stragglers."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if late else events
    out = rows.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("events"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("window_start"), "event_type", "events", "total")


def sessions(events: DataFrame, gap: str = "1 hour", late: str | None = None) -> DataFrame:
    """(user_id, session_start, session_end, events): runs of a user's events with no longer pause than gap."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if late else events
    out = rows.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("events"))
    return out.select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "events")


def into_pair_counts(table: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch over commits (hash, file): adds a batch's pair counts to a table, once for each batch id."""
    from ..operators.history import pair_counts, usable_commits

    def add(batch: DataFrame, number: int) -> None:
        pair_counts(usable_commits(batch)).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{table}/batch_id={number}")

    return add


def summed_pairs(spark: SparkSession, table: str) -> DataFrame:
    return spark.read.parquet(table).groupBy("f1", "f2").agg(F.sum("together").alias("together"))


def watched_files(spark: SparkSession, root: str) -> DataFrame:
    """A stream of (path, content, seen) of text files below root, one row for each new or rewritten file."""
    lines = spark.readStream.format("text").option("wholetext", "true").option("recursiveFileLookup", "true").load(root)
    return lines.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"), F.col("_metadata.file_modification_time").alias("seen"))


def changed_files(files: DataFrame) -> DataFrame:
    """(path, content, version) of those whose content differs from what was last seen under the path; a stream."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, version = state.get if state.exists else ("", 0)
        out = []
        for frame in frames:
            for content in frame.sort_values("seen")["content"]:
                mark = hashlib.sha256((content or "").encode()).hexdigest()
                if mark != last:
                    last, version = mark, version + 1
                    out.append((key[0], content, version))
        state.update((last, version))
        yield pd.DataFrame(out, columns=["path", "content", "version"])

    return files.groupBy("path").applyInPandasWithState(step, "path string, content string, version int", "mark string, version int", "append", GroupStateTimeout.NoTimeout)


def parsed_stream(changed: DataFrame) -> DataFrame:
    """Items of each changed file."""
    return parse_files(changed.withColumn("seq", F.lit(0)))
