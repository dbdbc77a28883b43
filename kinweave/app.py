"""Command line: reproduce, smoke, analyze, audit-review-feedback."""

from __future__ import annotations

import argparse
import dataclasses
import json
import os

from pyspark.sql import SparkSession

from kinweave.plans.analysis import analyze
from kinweave.plans.audit import audit_feedback
from kinweave.plans.benchmark import reproduce
from kinweave.sources.config import load_settings
from kinweave.sources.files import read_csv
from kinweave.sources.schemas import FEEDBACK, GUARDRAIL, OBSERVATIONS


def arguments() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="kinweave")
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("reproduce", "smoke"):
        command = commands.add_parser(name)
        command.add_argument("--config")
        command.add_argument("--output-root", default=".")
    command = commands.add_parser("analyze")
    command.add_argument("--input", required=True)
    command.add_argument("--config")
    command.add_argument("--output-root", required=True)
    command.add_argument("--snapshot-date")
    command.add_argument("--identifier-salt-env", default="KINWEAVE_IDENTIFIER_SALT")
    command = commands.add_parser("audit-review-feedback")
    command.add_argument("--guardrail", required=True)
    command.add_argument("--feedback", required=True)
    command.add_argument("--output-root", required=True)
    return parser


def session() -> SparkSession:
    return SparkSession.builder.appName("kinweave").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def main(argv: list[str] | None = None) -> dict:
    args = arguments().parse_args(argv)
    salt = os.environ.get(args.identifier_salt_env) if args.command == "analyze" else None
    if args.command == "analyze" and not salt:
        raise SystemExit(f"Set {args.identifier_salt_env} to a secret value of at least 16 characters")
    spark = session()
    if args.command == "analyze":
        told = analyze(read_csv(spark, args.input, OBSERVATIONS), args.output_root, identifier_salt=salt, settings=load_settings(args.config), snapshot_date=args.snapshot_date)
    elif args.command == "audit-review-feedback":
        told = audit_feedback(read_csv(spark, args.guardrail, GUARDRAIL), read_csv(spark, args.feedback, FEEDBACK), args.output_root)
    else:
        settings = load_settings(args.config)
        if args.command == "smoke":
            settings = dataclasses.replace(settings, buildings=30, stability_seeds=())
        told = reproduce(spark, args.output_root, settings)
    print(json.dumps(told, indent=2, sort_keys=True))
    return told


if __name__ == "__main__":
    main()
