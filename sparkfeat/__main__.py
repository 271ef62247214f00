"""Score the clients of a folder with the eight input tables.

    spark-submit --conf spark.checkpoint.dir=SHARED_FOLDER -m sparkfeat INPUT OUTPUT
"""

from __future__ import annotations

import argparse
from dataclasses import replace

from pyspark.sql import SparkSession

from sparkfeat.operators.model import importances, top_k
from sparkfeat.plans import scoring


def arguments(argv=None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="sparkfeat", description=__doc__.splitlines()[0])
    parser.add_argument("input", help="folder with the eight CSV tables")
    parser.add_argument("output", help="folder for train_features, scores and importances")
    parser.add_argument("--variant", choices=sorted(scoring.VARIANTS), default="plain")
    parser.add_argument("--trees", type=int, help="largest number of trees")
    parser.add_argument("--drop-list", help="text file with one unwanted column per line")
    parser.add_argument("--max-levels", type=int, help="most levels of a category that become columns")
    parser.add_argument(
        "--sparse-levels", action="store_true", help="columns with more levels become sparse vectors"
    )
    parser.add_argument("--client-buckets", type=int, help="store histories in buckets of clients")
    parser.add_argument(
        "--tune", nargs="?", const="weights", choices=["weights", "random"],
        help="also report class weight 12, or points drawn at random, by cross-validation",
    )
    return parser.parse_args(argv)


def main(argv=None) -> None:
    args = arguments(argv)
    spark = SparkSession.builder.appName("sparkfeat").getOrCreate()
    options = scoring.VARIANTS[args.variant]
    if args.trees:
        options = replace(options, trees=args.trees)
    if args.max_levels:
        options = replace(options, max_levels=args.max_levels)
    if args.sparse_levels:
        options = replace(options, sparse_levels=True)
    if args.client_buckets:
        options = replace(options, client_buckets=args.client_buckets)
    if args.drop_list:
        names = [r.value for r in spark.read.text(args.drop_list).collect()]
        options = replace(options, unwanted=names)
    result = scoring.score_clients(spark, args.input, args.output, options, tune=args.tune)
    top_k(importances(spark, result.model), "importance", "feature").show(20, truncate=False)
    if result.report is not None:
        result.report.show(truncate=False)


if __name__ == "__main__":
    main()
