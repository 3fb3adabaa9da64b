"""The exploration of a wide dataset as a set of small tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cohortlens.functions import activity_level
from cohortlens.operators import profile as P
from cohortlens.plans.training_run import load_dataset, output_folder
from cohortlens.sources.dataset import profile_schema, write_dataset
from cohortlens.storage import stage


def profile_tables(dataset: DataFrame) -> dict[str, DataFrame]:
    """All exploration tables of a staged dataset, still to be computed.

    Success is broken down by language if any is known, else by activity level.
    """
    numbers = P.numeric_columns(dataset, ("repo_id", "creator_id"))
    tables = {
        "schema": profile_schema(dataset),
        "summary": P.describe_numeric(dataset, numbers),
        "classes": P.value_counts(dataset, P.TARGET),
        "class_ratio": P.class_ratio(dataset),
        "coverage": P.coverage(dataset),
        "histograms": P.histogram(dataset, P.HISTOGRAM_COLUMNS, 50, 0.1),
        "boxes": P.box_stats(dataset),
        "weekly_trend": P.weekly_trend(dataset),
        "correlations": P.corr_with(dataset, P.numeric_columns(dataset, P.CORRELATION_EXCLUDES)),
        "correlation_matrix": P.corr_matrix(dataset),
        "missing": P.missing_report(dataset),
    }
    if P.has_any(dataset, "primary_language"):
        top = P.semi_join_top_k(dataset, "primary_language", 10)
        tables["languages"] = P.top_k(dataset, "primary_language", 15)
        tables["success_by_language"] = P.rate_by(top, "primary_language")
    else:
        levels = dataset.withColumn("activity_level", activity_level(F.col("total_events_30d")))
        tables["success_by_activity"] = P.rate_by(levels, "activity_level")
    return tables


def run_profile(spark: SparkSession, input_path: str, output: str, fmt: str = "auto") -> list[str]:
    """Write the exploration tables of a dataset file below ``output``, which must not touch the input."""
    output = output_folder(input_path, output, ("",))
    tables = profile_tables(stage(load_dataset(spark, input_path, fmt), "input"))
    for name, table in tables.items():
        write_dataset(table, f"{output.rstrip('/')}/{name}")
    return sorted(tables)
