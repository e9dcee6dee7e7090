"""GET /api/health and POST /api/analyze over one session, with results kept by the whole request."""

from __future__ import annotations

import hashlib
import json
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql import SparkSession

from .engine import ImpactEngine, analyse_repository
from .schema import DEFAULT_K
from .sources.sinks import to_json

MOST_KEPT = 32


class Analyses:
    """Answers requests; the same request is computed once."""

    def __init__(self, spark: SparkSession):
        self.spark, self.kept = spark, {}

    def __call__(self, request: dict) -> dict:
        key = hashlib.sha256(json.dumps(request, sort_keys=True).encode()).hexdigest()
        if key not in self.kept:
            while len(self.kept) >= MOST_KEPT:
                self.kept.pop(next(iter(self.kept)))
            self.kept[key] = self.analyse(request)
        return self.kept[key]

    def analyse(self, request: dict) -> dict:
        k, diff = int(request.get("k") or DEFAULT_K), request.get("diff_text")
        if request.get("files"):
            return ImpactEngine.from_source(self.spark, request["files"]).analyse(diff or "", k)
        if request.get("github_url"):
            from .sources.hosted import HostedRepository

            repo = HostedRepository("/".join(request["github_url"].rstrip("/").removesuffix(".git").split("/")[-2:]))
            return ImpactEngine.from_files(repo.load_files(self.spark)).analyse(diff or repo.diff(request.get("pr_number"), request.get("commit_sha")), k, repo=repo.slug)
        if request.get("repo_path"):
            return analyse_repository(self.spark, request["repo_path"], diff, k)
        raise ValueError("repo_path, github_url or files is needed")


def handler(answer) -> type[BaseHTTPRequestHandler]:
    class Handler(BaseHTTPRequestHandler):
        def reply(self, status: int, payload: dict) -> None:
            body = to_json(payload).encode()
            self.send_response(status)
            for name, value in (("Content-Type", "application/json"), ("Content-Length", str(len(body))), ("Access-Control-Allow-Origin", "*"), ("Access-Control-Allow-Methods", "GET, POST, OPTIONS"), ("Access-Control-Allow-Headers", "Content-Type")):
                self.send_header(name, value)
            self.end_headers()
            self.wfile.write(body)

        def do_OPTIONS(self):
            self.reply(200, {})

        def do_GET(self):
            self.reply(200, {"status": "ok"}) if self.path == "/api/health" else self.reply(404, {"error": "not found"})

        def do_POST(self):
            if self.path != "/api/analyze":
                return self.reply(404, {"error": "not found"})
            try:
                request = json.loads(self.rfile.read(int(self.headers.get("Content-Length") or 0)) or "{}")
                if not isinstance(request, dict):
                    raise ValueError("an object is needed")
            except ValueError as error:
                return self.reply(400, {"error": str(error)})
            try:
                self.reply(200, answer(request))
            except ValueError as error:
                self.reply(400, {"error": str(error)})
            except Exception as error:
                self.reply(500, {"success": False, "error": str(error)})

        def log_message(self, *args):
            pass

    return Handler


def serve(spark: SparkSession, port: int) -> None:
    ThreadingHTTPServer(("127.0.0.1", port), handler(Analyses(spark))).serve_forever()
