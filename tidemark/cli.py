"""Command line: ``python -m tidemark.cli COMMAND``.

A data set is a folder of the test tables (``--data``), seen through the lens, or a store (``--store``) that ``load`` fills
from tab-separated position tables and ``load-filings`` from whole filings (JSON lines of accession, cik, form, filed_date, facts, html).
``runs`` lists a store's loads; ``raw``, ``concepts``, ``schedule`` and ``universe`` look at sources before any load.  Exit codes: 1 nothing found, 2 wrong use.
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans import views
from tidemark.plans.store import Frames, as_filed, lens_frames, load, open_store, read_universe, run_log
from tidemark.sinks import export, server
from tidemark.sources import facts, filings, schedules, tables, universe

REPORT = ("overview", "bdcs", "nonaccrual_trend", "markdowns", "deteriorating", "disagreements")


def stats(f: Frames, args: argparse.Namespace) -> int:
    print(json.dumps(export.records(views.dataset_stats(f, args.period))[0], indent=1))
    return 0


def report(f: Frames, args: argparse.Namespace) -> int:
    if args.view not in REPORT:
        print(f"no report {args.view!r}; there are {', '.join(REPORT)}", file=sys.stderr)
        return 2
    rows = export.records(views.build(f, args.view, args.period).limit(args.limit))
    for row in rows:
        print(json.dumps(row))
    return 0 if rows else 1


def inspect(f: Frames, args: argparse.Namespace) -> int:
    rows = export.records(views.bdc_positions(f, args.period, args.ticker).limit(args.limit))
    for row in rows:
        print(json.dumps(row))
    return 0 if rows else 1


def export_json(f: Frames, args: argparse.Namespace) -> int:
    print(len(export.export_all(f, args.out, args.period)), "files")
    return 0


def bundle(f: Frames, args: argparse.Namespace) -> int:
    print(export.write_html(f, args.out, args.period), "bytes")
    return 0


def excel(f: Frames, args: argparse.Namespace) -> int:
    print(json.dumps(export.export_workbook(f, args.out, args.period, args.include_unpriced)))
    return 0


def serve(f: Frames, args: argparse.Namespace) -> int:
    server.serve(f, args.host, args.port)
    return 0


def shown(rows: DataFrame, limit: int, to=None) -> int:
    """The first rows as JSON lines; 1 where there is none."""
    found = rows.limit(limit).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("line")).collect()
    for row in found:
        print(row.line, file=to or sys.stdout)
    return 0 if found else 1


def read_rates(spark: SparkSession, path: str | None) -> DataFrame:
    schema = "rate_date date, currency string, rate double"
    return spark.read.schema(schema).csv(path, header=True) if path else spark.createDataFrame([], schema)


def read_filings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("accession string, cik long, form string, filed_date date, facts string, html string").json(path)


def load_tables(spark: SparkSession, args: argparse.Namespace) -> int:
    """Positions of all tables at a path into the store; ``--new`` starts it."""
    rows = as_filed(tables.landing_positions(spark, args.landing), read_universe(spark, args.universe))
    found = load(spark, args.store, rows, read_rates(spark, args.rates), new=args.new, source="bulk", scope=args.landing)
    print(json.dumps(export.records(views.dataset_stats(found))[0], indent=1))
    return 0


def load_filings(spark: SparkSession, args: argparse.Namespace) -> int:
    """Positions of whole filings into the store; filings that can't be read are listed on standard error."""
    rows, errors = filings.harvest(read_filings(spark, args.filings), read_universe(spark, args.universe))
    found = load(spark, args.store, rows, read_rates(spark, args.rates), new=args.new, source="filings", scope=args.filings)
    print(json.dumps(export.records(views.dataset_stats(found))[0], indent=1))
    shown(errors, 1000, sys.stderr)
    return 0


def runs(spark: SparkSession, args: argparse.Namespace) -> int:
    return shown(run_log(spark, args.store).orderBy("snapshot"), args.limit)


def raw(spark: SparkSession, args: argparse.Namespace) -> int:
    """A filer's newest filings as filed, by loan key, ahead of merging: which rows a loan's total is made of."""
    own = read_universe(spark, args.universe).where(F.col("ticker") == args.ticker.upper())
    newest = facts.newest_filings(read_filings(spark, args.filings).join(own.select("cik"), "cik", "left_semi"), args.since, args.filings_limit)
    rows, _ = filings.harvest(newest, own)
    return shown(views.raw_groups(rows, args.issuer, args.period), args.limit)


def concepts(spark: SparkSession, args: argparse.Namespace) -> int:
    return shown(facts.concept_census(filings.read_filings(read_filings(spark, args.filings)).facts, args.limit), args.limit)


def schedule(spark: SparkSession, args: argparse.Namespace) -> int:
    return shown(schedules.schedule_coverage(filings.read_filings(read_filings(spark, args.filings)).printed).orderBy("accession"), args.limit)


def check_universe(spark: SparkSession, args: argparse.Namespace) -> int:
    """The universe and its watch-list against CSV files of the official list (cik) and of tickers (ticker, cik, name)."""
    official = spark.read.schema("cik long").csv(args.official, header=True)
    listed = spark.read.schema("ticker string, cik long, name string").csv(args.tickers, header=True)
    return shown(universe.universe_check(universe.read_entries(spark, args.universe), official, listed).orderBy("list", "ticker", "outcome"), args.limit)


def quarters(spark: SparkSession, args: argparse.Namespace) -> int:
    for row in tables.quarters_between(spark, args.start, args.end).collect():
        print(row.quarter)
    return 0


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tidemark")
    where = top.add_mutually_exclusive_group(required=True)
    where.add_argument("--data")
    where.add_argument("--store")
    top.add_argument("--period")
    commands = top.add_subparsers(dest="command", required=True)
    for name, what, run in (("load", "landing", load_tables), ("load-filings", "filings", load_filings)):
        c = commands.add_parser(name)
        c.add_argument(what)
        c.add_argument("universe")
        c.add_argument("--rates")
        c.add_argument("--new", action="store_true")
        c.set_defaults(setup=run)
    c = commands.add_parser("raw")
    for what in ("filings", "universe", "ticker"):
        c.add_argument(what)
    c.add_argument("--issuer")
    c.add_argument("--since", default="0001-01-01")
    c.add_argument("--filings-limit", type=int, default=1)
    c.set_defaults(setup=raw)
    for name, whats, run in (("runs", (), runs), ("concepts", ("filings",), concepts), ("schedule", ("filings",), schedule), ("universe", ("universe", "official", "tickers"), check_universe)):
        c = commands.add_parser(name)
        for what in whats:
            c.add_argument(what)
        c.set_defaults(setup=run)
    for name in ("raw", "runs", "concepts", "schedule", "universe"):
        commands.choices[name].add_argument("--limit", type=int, default=100)
    c = commands.add_parser("quarters")
    c.add_argument("start")
    c.add_argument("end")
    c.set_defaults(setup=quarters)
    commands.add_parser("stats").set_defaults(run=stats)
    c = commands.add_parser("report")
    c.add_argument("view")
    c.add_argument("--limit", type=int, default=20)
    c.set_defaults(run=report)
    c = commands.add_parser("inspect")
    c.add_argument("ticker")
    c.add_argument("--limit", type=int, default=20)
    c.set_defaults(run=inspect)
    for name, run in (("export", export_json), ("bundle", bundle), ("excel", excel)):
        c = commands.add_parser(name)
        c.add_argument("out")
        c.set_defaults(run=run)
        if name == "excel":
            c.add_argument("--include-unpriced", action="store_true")
    c = commands.add_parser("serve")
    c.add_argument("--host", default="127.0.0.1")
    c.add_argument("--port", type=int, default=8000)
    c.set_defaults(run=serve)
    return top


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("tidemark").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if hasattr(args, "setup"):
        if args.command in ("load", "load-filings", "runs") and not args.store:
            print(f"{args.command} needs --store", file=sys.stderr)
            return 2
        return args.setup(spark, args)
    return args.run(lens_frames(spark, args.data) if args.data else open_store(spark, args.store), args)


if __name__ == "__main__":
    sys.exit(main())
