"""Command line: ``python -m namelens.cli ingest|screen|lists|serve|version``."""

from __future__ import annotations

import argparse
import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from namelens import __version__
from namelens.operators.screening import prepare_watchlist, screen
from namelens.schema import DEFAULT_LISTS, DEFAULT_THRESHOLD
from namelens.sources.loaders import load_watchlist, read_csv, read_names, read_people
from namelens.sources.store import WatchlistStore


def ingest(spark: SparkSession, store: str, source: str, data: str, list_type: str = "EU") -> int:
    """Imports a file into the store; the number of rows read."""
    readers = {
        "ofac": lambda: read_csv(spark, data),
        "eu": lambda: load_watchlist(spark, data, "json", "EU"),
        "jsonl": lambda: load_watchlist(spark, data, "jsonl", list_type),
        "json": lambda: read_people(spark, data),
    }
    if source not in readers:
        raise ValueError(f"unknown source: {source}")
    return WatchlistStore(spark, store).replace(readers[source]())


def screened(spark: SparkSession, store: str, names: DataFrame, threshold: float, lists: Sequence[str]) -> DataFrame:
    """Matches of names against the stored lists; a threshold out of range finds nothing."""
    return screen(names, prepare_watchlist(WatchlistStore(spark, store).load(lists)), threshold, strict=False)


def lines(rows, single: bool, threshold: float, asked: int) -> list[str]:
    """The text answer."""
    if single:
        return [f"[{r.score:.2f}] {r.name} ({r.match_type}) — {r.list}" for r in rows] + ["", f"{len(rows)} matches found (threshold: {threshold:.2f})"]
    return [f"[{r.score:.2f}] {r.input_name} matched {r.name} ({r.match_type})" for r in rows] + ["", f"{len(rows)} total matches from {asked} names"]


def main(argv: Sequence[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="namelens")
    commands = parser.add_subparsers(dest="command", required=True)
    one = commands.add_parser("ingest")
    one.add_argument("--source", required=True, choices=["ofac", "eu", "jsonl", "json"])
    one.add_argument("--data", required=True)
    one.add_argument("--list-type", default="EU")
    two = commands.add_parser("screen")
    two.add_argument("--name")
    two.add_argument("--file")
    two.add_argument("-t", "--threshold", type=float, default=DEFAULT_THRESHOLD)
    two.add_argument("--list", action="append")
    two.add_argument("--output")
    three = commands.add_parser("lists")
    four = commands.add_parser("serve")
    four.add_argument("--port", type=int, default=8080)
    for p in (one, two, three, four):
        p.add_argument("--store", default="watchlist")
    commands.add_parser("version")
    args = parser.parse_args(argv)
    if args.command == "version":
        print(f"namelens {__version__}")
        return 0
    spark = SparkSession.builder.appName("namelens").getOrCreate()
    if args.command == "ingest":
        print(f"imported {ingest(spark, args.store, args.source, args.data, args.list_type)} rows")
    elif args.command == "lists":
        for r in WatchlistStore(spark, args.store).counts(DEFAULT_LISTS).collect():
            print(r["list"], r["count"])
    elif args.command == "serve":
        from namelens.server import serve

        serve(spark, args.store, args.port)
    else:
        if not args.file and args.name is None:
            parser.error("--name or --file is needed")
        names = read_names(spark, args.file) if args.file else spark.createDataFrame([(0, args.name)], "input_id long, name string")
        found = screened(spark, args.store, names, args.threshold, args.list or DEFAULT_LISTS).orderBy("input_id", "rank")
        if args.output:
            rows = [json.loads(x) for x in found.toJSON().collect()]
            with open(args.output, "w", encoding="utf-8") as f:
                json.dump(rows or None, f, indent=2, ensure_ascii=False)
        else:
            print("\n".join(lines(found.collect(), not args.file, args.threshold, names.count() if args.file else 1)))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
