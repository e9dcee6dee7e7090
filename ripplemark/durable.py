"""Written intermediates: what a loop needs again is a table in the shared folder, not a cached block."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[int, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; in local mode, where that is unset, a folder of our own."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return _OWN.setdefault(id(spark.sparkContext), "file://" + tempfile.mkdtemp(prefix="ripplemark-"))


def _forget(jvm, conf, path: str) -> None:
    try:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)
    except Exception:  # the JVM is gone
        pass


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table that survives lost executors; plans that read it start there."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/ripplemark/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_forget, spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), path)
    return spark.read.schema(df.schema).parquet(path)
