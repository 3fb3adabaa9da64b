"""Command line, also for ``spark-submit``.

    python -m cohortlens dataset --events archive/ --output dataset.parquet
    python -m cohortlens profile --input dataset.parquet --output tables/
    python -m cohortlens train --input dataset.parquet --output runs/first
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from cohortlens.config import TrainConfig
from cohortlens.plans.archive import combined_dataset
from cohortlens.plans.profile_run import run_profile
from cohortlens.plans.training_run import run_training
from cohortlens.sources import canonical_events, read_events, write_dataset


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="cohortlens", description="Event cohorts to success scores.")
    commands = parser.add_subparsers(dest="command", required=True)
    dataset = commands.add_parser("dataset", help="build the wide dataset from an event archive")
    dataset.add_argument("--events", required=True, help="folder of event_date=YYYY-MM-DD folders")
    dataset.add_argument("--events-format", choices=("json", "parquet"), default="json")
    dataset.add_argument("--output", "-o", required=True)
    dataset.add_argument("--format", choices=("parquet", "csv"), default="parquet")
    profile = commands.add_parser("profile", help="write the exploration tables of a dataset")
    profile.add_argument("--input", "-i", required=True, help="CSV or Parquet, file or folder")
    profile.add_argument("--output", "-o", required=True)
    profile.add_argument("--format", choices=("auto", "parquet", "csv"), default="auto", help="of the input")
    train = commands.add_parser("train", help="train, compare and save classifiers")
    train.add_argument("--input", "-i", required=True, help="CSV or Parquet, file or folder")
    train.add_argument("--output", "-o", help="folder for model and reports, default a fresh one beside the input")
    train.add_argument("--format", choices=("auto", "parquet", "csv"), default="auto", help="of the input")
    train.add_argument("--trees", type=int, default=TrainConfig.trees, help="trees per ensemble")
    return parser.parse_args(argv)


def main(argv: list[str] | None = None) -> None:
    args = arguments(argv)
    spark = (
        SparkSession.builder.appName("cohortlens").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    if args.command == "dataset":
        events = canonical_events(read_events(spark, args.events, fmt=args.events_format))
        write_dataset(combined_dataset(events), args.output, args.format)
    elif args.command == "profile":
        print("\n".join(run_profile(spark, args.input, args.output, fmt=args.format)))
    else:
        run = run_training(spark, args.input, args.output, TrainConfig(trees=args.trees), args.format)
        run.trained.results.show(truncate=False)
        run.summary.show(truncate=False)


if __name__ == "__main__":
    main()
