"""Command line: ``python -m probatio.cli verify PATH``, ``batch DIR``, ``init-config``, ``health``, ``info``."""

from __future__ import annotations

import argparse
import json
import sys
from dataclasses import asdict

from probatio.config import TEMPLATES, Settings, load


def _spark():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("probatio").getOrCreate()


def _settings(args) -> Settings:
    base = load(args.config) if args.config else TEMPLATES[args.template]
    changes = {k: v for k, v in (("agents", tuple(args.agents.split(",")) if args.agents else None), ("min_score", args.threshold)) if v is not None}
    return Settings(**{**asdict(base), **changes})


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="probatio")
    sub = parser.add_subparsers(dest="command", required=True)
    for name in ("verify", "batch"):
        one = sub.add_parser(name)
        one.add_argument("path")
        one.add_argument("--config")
        one.add_argument("--template", choices=sorted(TEMPLATES), default="default")
        one.add_argument("--agents")
        one.add_argument("--threshold", type=float)
        one.add_argument("--format", choices=("text", "json", "yaml"), default="text")
        one.add_argument("--pattern", default="*.py")
        one.add_argument("--output")
    new = sub.add_parser("init-config")
    new.add_argument("--template", choices=sorted(TEMPLATES), default="default")
    sub.add_parser("health")
    sub.add_parser("info")
    args = parser.parse_args(argv)
    if args.command == "init-config":
        print(json.dumps(asdict(TEMPLATES[args.template]), indent=2))
        return 0
    if args.command == "info":
        from probatio.operators import rules

        print(f"{len(rules.LINE_RULES)} line rules, {len(rules.SECRET_RULES)} secret rules, {len(rules.ENTROPY_RULES)} entropy rules; templates: {', '.join(TEMPLATES)}")
        return 0

    from probatio.operators.corpus import batch_summary
    from probatio.plans.verify import verify
    from probatio.sources import corpus, sinks

    spark = _spark()
    if args.command == "health":
        row = verify(corpus.rows(spark, [("health", "x = 1\n", None)])).first()
        print(f"{row['verdict']} {row['score']}")
        return 0 if row["verdict"] == "PASS" else 1
    settings = _settings(args)
    samples = corpus.one_file(spark, args.path) if args.command == "verify" else corpus.directory(spark, args.path, args.pattern)
    reports = verify(samples, settings)
    texts = {"text": sinks.report_text, "json": sinks.report_json, "yaml": sinks.report_yaml}[args.format](reports)
    if args.output:
        sinks.write_texts(texts, args.output)
    if args.command == "verify":
        row = reports.select("score").first()
        if not args.output:
            print(texts.first()["report"])
        return 0 if row["score"] >= settings.min_score else 1
    summary = batch_summary(reports, settings.min_score).first().asDict()
    print(json.dumps(summary, default=str))
    if not summary["total"]:
        print("no files match", file=sys.stderr)
        return 2
    return 1 if summary["failed"] else 0


if __name__ == "__main__":
    sys.exit(main())
