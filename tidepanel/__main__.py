"""python -m tidepanel list | run QUERY --tables DIR [--out DIR]: the query registry on the command line."""

from __future__ import annotations

import argparse


def main(args: list[str] | None = None) -> None:
    from tidepanel.plans.registry import QUERIES

    parser = argparse.ArgumentParser(prog="tidepanel")
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("list")
    run = commands.add_parser("run")
    run.add_argument("query", choices=sorted(QUERIES))
    run.add_argument("--tables", required=True)
    run.add_argument("--out")
    given = parser.parse_args(args)
    if given.command == "list":
        print("\n".join(sorted(QUERIES)))
        return
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName(f"tidepanel {given.query}").getOrCreate()
    found = QUERIES[given.query](spark, given.tables)
    if given.out:
        found.write.mode("overwrite").parquet(given.out)
    else:
        found.show(20, truncate=False)


if __name__ == "__main__":
    main()
