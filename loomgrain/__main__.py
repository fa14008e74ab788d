"""The command line: ``python -m loomgrain COMMAND``. Each command is one operator over tables or archives, and writes Parquet, JSON lines or CSV."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgrain.operators import audit, contract, declared, extract, links, readings, rows, written
from loomgrain.sources import archives, files


def _pages(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """page_id, url and html of a Parquet table, or of archives, whose pages are numbered by their addresses' hashes."""
    if args.archives:
        found = archives.read(spark, args.input).where("html is not null")
        return found.select(F.xxhash64("file", "at", "nth").alias("page_id"), "url", "html")
    return spark.read.parquet(args.input)


def _keyed(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    pages = _pages(spark, args)
    return pages if "extractor" in pages.columns else pages.withColumn("extractor", F.lit(args.extractor))


def _learn(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    return written.to_json(*contract.learn(rows.induced(_keyed(spark, args)).persist()))


def _run(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    listing, columns, _, _ = written.from_json(files.read_contracts(spark, args.contracts))
    return contract.checks(contract.replay(_keyed(spark, args), listing).persist(), listing, columns)


def _heal(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    _, columns, _, _ = written.from_json(files.read_contracts(spark, args.contracts))
    return contract.heal(columns, rows.induced(_keyed(spark, args)).persist())


COMMANDS: dict[str, tuple[str, Callable[[SparkSession, argparse.Namespace], DataFrame]]] = {
    "records": ("what pages declare", lambda s, a: extract.record_fields(extract.extract(_pages(s, a)))),
    "answers": ("the fixed questions' answers", lambda s, a: extract.summary_long(extract.extract(_pages(s, a)))),
    "conflicts": ("where pages contradict themselves", lambda s, a: extract.conflicts(extract.extract(_pages(s, a)))),
    "links": ("links by their relations", lambda s, a: links.links(declared.parse(_pages(s, a), ()))),
    "audit": ("what search features miss", lambda s, a: audit.missing(extract.extract(_pages(s, a)))),
    "markdown": ("pages as Markdown", lambda s, a: readings.as_markdown(_pages(s, a))),
    "rows": ("rows that the markup repeats", lambda s, a: rows.rows_long(rows.induced(_keyed(s, a)))),
    "learn": ("contracts as JSON", _learn),
    "run": ("checks of contracts", _run),
    "heal": ("where a contract's columns went", _heal),
}


def parser() -> argparse.ArgumentParser:
    found = argparse.ArgumentParser(prog="loomgrain", description=__doc__)
    commands = found.add_subparsers(dest="command", required=True)
    for name, (told, _) in COMMANDS.items():
        own = commands.add_parser(name, help=told)
        own.add_argument("input", help="a Parquet table with page_id, url and html, or archives")
        own.add_argument("output", help="a folder that isn't there yet")
        own.add_argument("--archives", action="store_true", help="the input is WARC archives")
        own.add_argument("--format", choices=("parquet", "jsonl", "csv"), default="parquet")
        own.add_argument("--extractor", default="site", help="the contract's name where the table has no column extractor")
        if name in ("run", "heal"):
            own.add_argument("--contracts", required=True, help="JSON lines that learn wrote")
    return found


def main(arguments: list[str] | None = None) -> int:
    args = parser().parse_args(arguments)
    spark = SparkSession.builder.appName(f"loomgrain {args.command}").getOrCreate()
    df = COMMANDS[args.command][1](spark, args)
    if args.format == "csv":
        files.write_csv(df, args.output)
    elif args.format == "jsonl":
        files.append_jsonl(df, args.output)
    else:
        df.write.parquet(args.output)
    return 0


if __name__ == "__main__":
    sys.exit(main())
