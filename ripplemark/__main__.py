"""python -m ripplemark: analyse a change, or answer requests.

--repo PATH | --hosted OWNER/NAME [--pull N | --commit SHA]; --diff FILE or
text; -k HOPS; --output FILE (Markdown), --json (stdout), --serve PORT.
--evaluate SYMBOL: how well call sites and tests of SYMBOL are found, as JSON.
"""

from __future__ import annotations

import argparse
import os
import sys

from .engine import ImpactEngine, analyse_repository
from .schema import DEFAULT_K
from .sources.sinks import to_json, write_text


def session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("ripplemark").getOrCreate()


def run(args: argparse.Namespace) -> dict:
    diff = args.diff
    if diff and os.path.isfile(diff):
        with open(diff, encoding="utf-8") as f:
            diff = f.read()
    spark = session()
    if args.hosted:
        from .sources.hosted import HostedRepository

        repo = HostedRepository(args.hosted)
        engine = ImpactEngine.from_files(repo.load_files(spark))
        return engine.analyse(diff or repo.diff(args.pull, args.commit), args.k, repo=args.hosted)
    return analyse_repository(spark, args.repo, diff, args.k)


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="ripplemark", description=__doc__)
    parser.add_argument("--repo", default=".")
    parser.add_argument("--hosted")
    parser.add_argument("--pull", type=int)
    parser.add_argument("--commit")
    parser.add_argument("--diff")
    parser.add_argument("-k", type=int, default=DEFAULT_K)
    parser.add_argument("--output")
    parser.add_argument("--json", action="store_true")
    parser.add_argument("--serve", type=int)
    parser.add_argument("--evaluate", metavar="SYMBOL")
    args = parser.parse_args(argv)
    if args.serve:
        from .server import serve

        serve(session(), args.serve)
        return 0
    if args.evaluate:
        from .operators.evaluation import evaluation
        from .sources.files import DEFAULT_DIFF, commits_from_git, files_from_dir

        spark = session()
        text = to_json(evaluation(files_from_dir(spark, args.repo), args.evaluate, args.diff or DEFAULT_DIFF, commits_from_git(spark, args.repo)))
        if args.output:
            write_text(text, args.output)
        print(text)
        return 0
    found = run(args)
    if args.output:
        write_text(found["markdown_report"], args.output)
    print(to_json(found) if args.json else found["markdown_report"])
    return 0


if __name__ == "__main__":
    sys.exit(main())
