"""Run one query: python -m textloom NAME FOLDER [--out PATH] [--rows N]; --list names all."""

from __future__ import annotations

import argparse


def main(argv: list[str] | None = None) -> None:
    from textloom.plans.catalog import QUERIES

    parser = argparse.ArgumentParser(prog="textloom", description=__doc__)
    parser.add_argument("name", nargs="?", help="query, or a prefix that only one has")
    parser.add_argument("folder", nargs="?", help="folder of Parquet tables")
    parser.add_argument("--out", help="write Parquet there instead of printing")
    parser.add_argument("--rows", type=int, default=20)
    parser.add_argument("--list", action="store_true")
    a = parser.parse_args(argv)
    if a.list or not a.name or not a.folder:
        print("\n".join(sorted(QUERIES)))
        return
    from pyspark.sql import SparkSession

    from textloom.functions.text import match_prefix

    name = match_prefix(a.name, list(QUERIES))
    if name is None:
        parser.error(f"no query, or several: {a.name}")
    df = QUERIES[name](SparkSession.builder.appName("textloom").getOrCreate(), a.folder)
    if a.out:
        df.write.parquet(a.out)
    else:
        df.show(a.rows, truncate=False)


if __name__ == "__main__":
    main()
