"""Command line: run, rules, verify."""

from __future__ import annotations

import argparse
import sys
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .plans import pipeline, sigma
from .plans.analyzers import Params
from .sinks import manifest, report
from .sources import readers


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="quarrylens")
    sub = parser.add_subparsers(dest="command", required=True)
    for name in ("run", "rules"):
        p = sub.add_parser(name)
        p.add_argument("source")
        p.add_argument("out")
        p.add_argument("--rules", help="a folder of Sigma rules instead of the bundled ones")
        p.add_argument("--host", default="")
        p.add_argument("--since", help="leave out earlier events, e.g. 2024-01-31T00:00:00")
        p.add_argument("--driver-list", help="SHA-1 hashes of known vulnerable drivers")
        p.add_argument("--aliases", action="store_true", help="let rules for process creation match Security 4688")
        p.add_argument("--case-id", default="")
        p.add_argument("--zip", help="pack the outputs into this file")
    p = sub.add_parser("verify")
    p.add_argument("folder")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("quarrylens").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if args.command == "verify":
        bad = manifest.verify(spark, f"{args.folder}/manifest.json", args.folder).filter("status <> 'ok'").collect()
        for r in bad:
            print(f"{r.path}: {r.status}")
        return 1 if bad else 0
    params = Params(as_of=datetime.now(UTC).replace(tzinfo=None), host=args.host)
    if args.driver_list:  # a list that a person keeps, instead of the bundled one
        params.driver_hashes = tuple(r[0] for r in readers.driver_hashes(spark, args.driver_list).collect())
    tables = readers.read_all(spark, args.source) if args.command == "run" else {"event": readers.read_event_json(spark, args.source)}
    if args.since:
        tables["event"] = readers.since(tables["event"], F.lit(args.since).cast("timestamp"))
    loaded, rejected = sigma.read_rules(args.rules)
    rules = pipeline.Analyzer("sigma", sigma.analyzer(loaded, args.aliases))
    analyzers = pipeline.ANALYZERS if args.command == "run" else ()
    result = pipeline.run(spark, tables, params, analyzers, (rules,))
    records = tables if args.command == "run" else None
    manifest.write_directory(result.findings, result.observations, args.out, records, host=args.host, case_id=args.case_id, errors="; ".join(result.errors), rules=str(len(loaded)), rules_rejected="; ".join(rejected))
    report.write_report(str(Path(args.out) / "report.html"), result.findings, result.observations, tables)
    if args.zip:
        manifest.write_zip(args.out, args.zip)
    for line in rejected:
        print(f"rule rejected: {line}", file=sys.stderr)
    for line in result.errors:  # the outputs lack what these analyzers would have found
        print(f"analyzer failed: {line}", file=sys.stderr)
    return 2 if result.errors else 0


if __name__ == "__main__":
    sys.exit(main())
