"""Commands: generate (drop the demonstration day), ingest, report, truth."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession


def main() -> None:
    parser = argparse.ArgumentParser(prog="plantlens", description=__doc__)
    sub = parser.add_subparsers(dest="command", required=True)
    for name, options in {"generate": ["--drop"], "ingest": ["--drop", "--ledger", "--checkpoint"], "report": ["--ledger", "--out"], "truth": []}.items():
        own = sub.add_parser(name)
        for o in options:
            own.add_argument(o, required=True)
    args = parser.parse_args()
    spark = SparkSession.builder.appName("plantlens").getOrCreate()
    if args.command == "generate":
        from plantlens.sources.generator import demonstration_day, drop_files

        drop_files(demonstration_day(spark), args.drop)
    elif args.command == "ingest":
        from plantlens.streaming.stream import ingest_all

        print(json.dumps(ingest_all(spark, args.drop, args.ledger, args.checkpoint), sort_keys=True))
    elif args.command == "report":
        from plantlens.plans.report import build_report, publish
        from plantlens.sources.schedule import machines_df
        from plantlens.streaming.ledger import Ledger

        publish(build_report(Ledger(spark, args.ledger).read(), machines_df(spark)), args.out)
    else:
        from plantlens.sources import truth

        for rows in (truth.expected(spark), truth.expected_downtime(spark), truth.expected_alarms(spark), truth.expected_messages(spark)):
            rows.show(100, truncate=False)
    spark.stop()


if __name__ == "__main__":
    main()
