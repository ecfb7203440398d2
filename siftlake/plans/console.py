"""Command line: load a gazetteer file, and search it. ``python -m siftlake.plans.console --help``."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from siftlake.functions.filters import bytes_of_bits
from siftlake.functions.hashing import item_bits
from siftlake.operators.chunks import fetch, search
from siftlake.sources import geonames as G


def options() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("folder", help="where the tables are")
    parser.add_argument("--load", metavar="TSV", help="read records from this file first")
    parser.add_argument("--limit", type=int, help="records to load at most")
    parser.add_argument("--find", nargs="*", default=[], metavar="ITEM", help="items that all must be in a record's filter")
    return parser


def target_of(items: list[str]) -> bytes:
    """One filter of all items, which finds records that have every one."""
    return bytes_of_bits({b for bits in item_bits(items, G.SHAPE) for b in bits}, G.SHAPE)


def main(arguments: list[str] | None = None, spark: SparkSession | None = None):
    args = options().parse_args(arguments)
    spark = spark or SparkSession.builder.getOrCreate()
    base, index = f"{args.folder}/geonames", f"{args.folder}/geonames_idx"
    table = G.load(spark, args.load, base, index, args.limit) if args.load else spark.read.parquet(base)
    if not args.find:
        return table
    hits = search(spark.read.parquet(index), ["geonameid"], target_of(args.find))
    found = fetch(table, hits, ["geonameid"])
    found.select("geonameid", "name", "country_code", "feature_code").show(50, False)
    return found


if __name__ == "__main__":
    main()
