"""Source trees, diffs and in-memory inputs as DataFrames."""

from __future__ import annotations

import subprocess

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader

from ..operators.traversal import ranked
from ..schema import COMMITS, EXTENSIONS, FILES, SKIPPED_DIRS

#: Fixed value: the diff that is analysed where none is given.
DEFAULT_DIFF = """--- a/auth/service.py
+++ b/auth/service.py
@@ -3,2 +3,2 @@
-def validate_token(token: str) -> bool:
+def validate_token(token: str, require_admin: bool = False, tenant_id: str = "default") -> bool:
     claims = decode_token(token)
"""


def files_from_dict(spark: SparkSession, contents: dict[str, str]) -> DataFrame:
    return spark.createDataFrame([(i, p, c) for i, (p, c) in enumerate(contents.items())], FILES)


def _decoded(content):
    """Bytes as UTF-8 text; where they are not valid, without what is not (nor any replacement character)."""
    text = F.coalesce(content.cast("string"), F.lit(""))
    return F.when(F.is_valid_utf8(text), text).otherwise(F.regexp_replace(F.make_valid_utf8(text), "\ufffd", ""))


def files_from_dir(spark: SparkSession, root: str, extensions: list[str] | None = None, skipped: tuple[str, ...] = SKIPPED_DIRS) -> DataFrame:
    """(seq, path, content) of the source files below root, read by the executors.

    Names that begin with a dot and skipped folders are left out, on every part
    of the absolute path.
    """
    wanted = extensions or sorted(EXTENSIONS)
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{{{','.join(wanted)}}}").load(root)
    full = F.url_decode(F.regexp_replace("path", r"^[a-z]+:(//[^/]*)?", ""))
    base = root.split("://", 1)[-1].rstrip("/")
    rows = raw.select(full.alias("full"), "content").withColumn("path", F.substring("full", len(base) + 2, 1 << 20))
    parts = F.split("full", "/")
    hidden = F.exists(parts, lambda p: (p.startswith(".") & ~p.isin(".", "..")) | p.isin(*skipped))
    rows = rows.filter(~hidden).select("path", _decoded(F.col("content")).alias("content"))
    # paths alone are sorted and numbered; contents join their number
    places = ranked(rows.select(F.col("path").alias("p"), F.lit(0).alias("same")), "same", "p")
    return rows.join(places, F.col("path") == F.col("p")).select((F.col("rank") - 1).alias("seq"), "path", "content")


def commits_from_list(spark: SparkSession, commits: list[tuple[str, list[str]]], exclude: set[str] = frozenset()) -> DataFrame:
    """(ord, hash, file) of commits given as (hash, files)."""
    rows = [(i, h, f.replace("\\", "/").strip()) for i, (h, files) in enumerate(commits) if h not in exclude for f in files]
    return spark.createDataFrame(rows, COMMITS)


def _git(root: str, *args: str, timeout: int = 15) -> str | None:
    try:
        done = subprocess.run(["git", *args], cwd=root, capture_output=True, text=True, timeout=timeout)
    except (OSError, subprocess.SubprocessError):
        return None
    return done.stdout if done.returncode == 0 else None


def working_diff(root: str, revision: str = "HEAD") -> str:
    """What changed since revision; without any change, the last commit's diff; empty without git."""
    found = _git(root, "diff", revision)
    if found and found.strip():
        return found
    return _git(root, "diff", f"{revision}~1", revision) or ""


def git_log(root: str, most: int = 500, before_date: str | None = None, before_commit: str | None = None) -> tuple[str, set[str]]:
    """(log text, commits to leave out): headers and file names, newest first."""
    args = ["log", f"-n{most}", "--name-only", "--format=format:COMMIT_HASH:%H", *([f"--before={before_date}"] if before_date else [])]
    if before_commit:
        found = _git(root, *args, f"{before_commit}~1")
        if found is not None:
            return found, set()
        return _git(root, *args) or "", {before_commit}
    return _git(root, *args) or "", set()


def commits_from_log(spark: SparkSession, text: str, exclude: set[str] = frozenset()) -> DataFrame:
    """(ord, hash, file) of a log's text: each name belongs to the header before it."""
    lines = spark.createDataFrame([(text,)], "t string").select(F.posexplode(F.split("t", "\r\n|\r|\n")).alias("n", "line")).withColumn("line", F.trim("line"))
    header = F.when(F.col("line").startswith("COMMIT_HASH:"), F.trim(F.substring("line", 13, 200)))
    upto = Window.orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # a log of at most `most` commits
    rows = lines.withColumn("_h", header).withColumns({"hash": F.last("_h", ignorenulls=True).over(upto), "ord": (F.count("_h").over(upto) - 1).cast("int")})
    rows = rows.filter("_h is null and line != '' and hash is not null")
    if exclude:
        rows = rows.filter(~F.col("hash").isin(*exclude))
    return rows.select("ord", "hash", F.regexp_replace("line", r"\\", "/").alias("file"))


def log_rows(text: str):
    """(ord, hash, file) of a log's text, line by line."""
    at, name = -1, None
    for line in text.splitlines():
        line = line.strip()
        if line.startswith("COMMIT_HASH:"):
            at, name = at + 1, line[12:].strip()
        elif line and name is not None:
            yield at, name, line.replace("\\", "/")


class GitLogReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options

    def read(self, partition):
        ask = self.options.get
        text, more = git_log(ask("path"), int(ask("most", "500")), ask("beforedate") or None, ask("beforecommit") or None)
        return ((at, name, file) for at, name, file in log_rows(text) if name not in more)


class GitLogSource(DataSource):
    """spark.read.format("ripplemark_git"): the history of the folder ``path``, which the reading task must see.

    Options: most (commits), beforeDate, beforeCommit.
    """

    @classmethod
    def name(cls):
        return "ripplemark_git"

    def schema(self):
        return COMMITS

    def reader(self, schema):
        return GitLogReader({k.lower(): v for k, v in self.options.items()})


def commits_from_git(spark: SparkSession, root: str, most: int = 500, before_date: str | None = None, before_commit: str | None = None, exclude: set[str] = frozenset()) -> DataFrame:
    """(ord, hash, file) of a folder's history."""
    spark.dataSource.register(GitLogSource)
    rows = spark.read.format("ripplemark_git").options(path=root, most=str(most), beforeDate=before_date or "", beforeCommit=before_commit or "").load()
    return rows.filter(~F.col("hash").isin(*exclude)) if exclude else rows
