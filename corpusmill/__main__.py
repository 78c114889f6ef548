"""Command line: ``python -m corpusmill run`` and ``validate-config``; for spark-submit as well."""

from __future__ import annotations

import argparse
import json
import sys

from corpusmill.config import FORMATS, GRANULARITIES, Config, default_end


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="corpusmill")
    sub = top.add_subparsers(dest="command", required=True)
    run = sub.add_parser("run", help="build a corpus from a table of repositories and their trees")
    run.add_argument("--config", help="JSON settings; other settings are ignored then")
    run.add_argument("--repos", required=True, help="Parquet of repositories")
    run.add_argument("--tree", required=True, help="folder owner/name/... of source trees")
    run.add_argument("--metrics", help="Parquet for the engineered filter")
    run.add_argument("--scorer", help="saved Spark ML pipeline")
    for name in ("language", "start-date", "end-date", "output-dir"):
        run.add_argument(f"--{name}")
    for name in ("min-stars", "min-contributors", "max-repos", "max-functions", "max-classes"):
        run.add_argument(f"--{name}", type=int)
    run.add_argument("--granularity", choices=[*GRANULARITIES, "both"])
    run.add_argument("--export-format", choices=FORMATS)
    run.add_argument("--dedup-threshold", type=float)
    for name in ("engineered-only", "deduplicate", "annotate-llm-score", "export-ast", "wait-for-rate-limit"):
        run.add_argument(f"--{name}", action=argparse.BooleanOptionalAction, default=None)
    sub.add_parser("validate-config", help="check JSON settings").add_argument("file")
    return top


def settings(args: argparse.Namespace) -> Config:
    if args.config:
        return Config.read(args.config).with_environment()
    given = {k: v for k, v in vars(args).items() if v is not None and k not in ("command", "config", "repos", "tree", "metrics", "scorer")}
    if "granularity" in given:
        given["granularity"] = list(GRANULARITIES) if given["granularity"] == "both" else [given["granularity"]]
    given.setdefault("end_date", default_end())
    return Config.parse(given).with_environment()


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        config = Config.read(args.file) if args.command == "validate-config" else settings(args)
    except (ValueError, OSError) as e:
        print(f"Error: invalid config: {e}", file=sys.stderr)
        return 1
    if args.command == "validate-config":
        print("Config is valid.")
        return 0
    from pyspark.ml import PipelineModel
    from pyspark.sql import SparkSession

    from corpusmill.plans import build
    from corpusmill.sources.files import read_tree

    spark = SparkSession.builder.appName("corpusmill").getOrCreate()
    try:
        summary = build.run(spark.read.parquet(args.repos), read_tree(spark, args.tree), config, spark.read.parquet(args.metrics) if args.metrics else None, PipelineModel.load(args.scorer) if args.scorer else None, lambda m: print(f"  {m}"))
    except Exception as e:  # the last stop of a command line
        print(f"Pipeline failed: {e}", file=sys.stderr)
        return 1
    print(json.dumps({k: v for k, v in summary.items() if k not in ("repo_stats",)}, indent=2, default=str))
    return 0


if __name__ == "__main__":
    sys.exit(main())
