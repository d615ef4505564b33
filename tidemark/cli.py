"""Command line: build, audit, mde, run, report."""

from __future__ import annotations

import argparse
import json
import sys

from .plans.config import load_task


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tidemark", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    for name, wants in {
        "build": ["raw", "out"],
        "audit": ["panels", "out"],
        "mde": ["task", "window", "out"],
        "run": ["task", "window", "panels", "store"],
        "report": ["task", "run-id", "panels", "store", "out"],
        "probe": [],
    }.items():
        c = sub.add_parser(name)
        for w in wants:
            c.add_argument(f"--{w}", required=w != "run-id" and (w != "out" or name == "build"))
        if name == "report":
            c.add_argument("--window", default="main")
        if name == "run":
            c.add_argument("--raw", help="folder with the daily candles that returns come from")
            c.add_argument("--index", help="table of volatility indices: unique_id, ds, x")
            c.add_argument("--models", nargs="*")
            c.add_argument("--dry-run", action="store_true")
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    if args.command == "probe":
        print("no endpoints are configured")
        return 0
    if args.command == "mde":
        from .plans.commands import effects

        print(json.dumps(effects(load_task(args.task), args.window, args.out)))
        return 0
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from .plans import commands
    from .sources.store import ForecastStore

    spark = SparkSession.builder.getOrCreate()
    if args.command == "build":
        commands.build(spark, args.raw, args.out)
        return 0
    if args.command == "audit":
        series, rv = spark.read.parquet(f"{args.panels}/series"), spark.read.parquet(f"{args.panels}/rv")
        return int(any(not a["passed"] for a in commands.audits(series, rv, args.out)))
    task = load_task(args.task)
    rv = task.task == "rv"
    rows = spark.read.parquet(f"{args.panels}/{'rv' if rv else 'series'}")
    rows = rows.select("unique_id", "ds", F.col("rv" if rv else "y").alias("y"))
    if args.command == "run":
        returns = commands.daily_returns(spark, args.raw) if args.raw else None
        index = spark.read.parquet(args.index) if args.index else None
        print(json.dumps(commands.run(spark, task, args.window, rows, args.store, args.models, returns, index, args.dry_run)))
        return 0
    run_id = commands.resolve_run(args.store, task.task, args.window, args.run_id)
    facts = ForecastStore(spark, args.store).read().where(F.col("run_id") == run_id)
    commands.report(facts, rows, task, args.out, commands.expected_rows(args.store, run_id))
    return 0


if __name__ == "__main__":
    sys.exit(main())
