"""A hosted repository through its web interface, as a data source with a partition per slice of paths.

``transport`` is a callable (url, headers) -> parsed JSON or text; the default
one uses urllib.  Tests give their own, so nothing here needs a network.
"""

from __future__ import annotations

import base64
import json
import os
import re
import urllib.request
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..schema import EXTENSIONS, FILES

Transport = Callable[[str, dict[str, str]], object]
API = "https://api.github.com"
MOST_FILES = 100


def urllib_transport(url: str, headers: dict[str, str]) -> object:
    with urllib.request.urlopen(urllib.request.Request(url, headers=headers), timeout=15) as answer:
        body = answer.read().decode("utf-8", "ignore")
    return json.loads(body) if "json" in answer.headers.get("Content-Type", "") else body


class HostedRepository:
    """slug: owner/name."""

    def __init__(self, slug: str, token: str | None = None, transport: Transport = urllib_transport):
        if not re.fullmatch(r"[\w.-]+/[\w.-]+", slug or ""):
            raise ValueError(f"not an owner/name: {slug!r}")
        self.slug, self.token, self.transport = slug, token or os.environ.get("GITHUB_TOKEN"), transport

    def headers(self, accept: str = "application/vnd.github+json") -> dict[str, str]:
        return {"Accept": accept, "User-Agent": "ripplemark"} | ({"Authorization": f"Bearer {self.token}"} if self.token else {})

    def get(self, path: str, accept: str = "application/vnd.github+json") -> object:
        return self.transport(f"{API}/repos/{self.slug}{path}", self.headers(accept))

    def default_branch(self) -> str:
        try:
            return self.get("")["default_branch"]
        except Exception:
            return "main"

    def paths(self, branch: str | None = None, most: int = MOST_FILES) -> list[str]:
        """Source files of the tree, at most `most` of them."""
        tree = self.get(f"/git/trees/{branch or self.default_branch()}?recursive=1")
        wanted = [e["path"] for e in tree.get("tree", []) if e.get("type") == "blob" and os.path.splitext(e["path"].lower())[1] in EXTENSIONS]
        return wanted[:most]

    def content(self, path: str, branch: str | None = None) -> str | None:
        try:
            found = self.get(f"/contents/{path}" + (f"?ref={branch}" if branch else ""))
            return base64.b64decode(found["content"]).decode("utf-8", "ignore") if isinstance(found, dict) else str(found)
        except Exception:
            return None

    def load_files(self, spark: SparkSession, branch: str | None = None, most: int = MOST_FILES, slices: int = 16) -> DataFrame:
        """(seq, path, content); files are fetched by tasks, a slice of paths each."""
        listed = self.paths(branch, most)
        if not listed:
            return spark.createDataFrame([], FILES)
        numbered = list(enumerate(listed))
        n = min(slices, len(numbered))
        spark.dataSource.register(tree_source(self, branch, [numbered[k::n] for k in range(n)]))
        return spark.read.format(TREE_SOURCE).load()

    def diff(self, pull: int | None = None, commit: str | None = None) -> str:
        """The diff of a pull request, else of a commit, else of the latest commit; empty if none can be had."""
        accept = "application/vnd.github.diff"
        try:
            if pull:
                return str(self.get(f"/pulls/{pull}", accept))
            if not commit:
                commit = self.get("/commits?per_page=1")[0]["sha"]
            return str(self.get(f"/commits/{commit}", accept))
        except Exception:
            return ""


TREE_SOURCE = "ripplemark_tree"


def tree_source(repository: HostedRepository, branch: str | None, slices: list[list[tuple[int, str]]]) -> type[DataSource]:
    """A data source of the files of some paths of a repository, with a partition a slice; those that can't be had are left out."""

    class TreeReader(DataSourceReader):
        def partitions(self):
            return [InputPartition(part) for part in slices]

        def read(self, partition):
            for seq, path in partition.value:
                content = repository.content(path, branch)
                if content is not None:
                    yield seq, path, content

    class TreeSource(DataSource):
        @classmethod
        def name(cls):
            return TREE_SOURCE

        def schema(self):
            return FILES

        def reader(self, schema):
            return TreeReader()

    return TreeSource
