"""spark-submit entry: the feature matrix of a raw CSV, with its rulers."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from tidewatch.plans.matrix import build_and_save
from tidewatch.sources.transactions import load_dataset


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("csv")
    p.add_argument("out")
    p.add_argument("--limit", type=int, default=None)
    p.add_argument("--max-edges", type=int, default=None, help="strong components and component sizes from so many of the largest edges; default: all")
    p.add_argument("--no-graph", action="store_true")
    a = p.parse_args(args)
    spark = SparkSession.builder.appName("build_features").getOrCreate()
    build_and_save(load_dataset(spark, a.csv, f"{a.out}/prepared"), a.out, not a.no_graph, a.limit, a.max_edges)


if __name__ == "__main__":
    main()
