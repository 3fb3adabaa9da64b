"""Scoring dataset rows as they arrive: the saved model on a stream of files."""

from __future__ import annotations

from pyspark.sql import SparkSession, types as T
from pyspark.sql.streaming import StreamingQuery

from cohortlens.operators.models import SuccessModel
from cohortlens.sources.dataset import DATASET_SCHEMA


def score_stream(
    spark: SparkSession,
    source: str,
    sink: str,
    checkpoint: str,
    fitted: SuccessModel,
    threshold: float = 0.5,
    schema: T.StructType = DATASET_SCHEMA,
    max_files: int = 1_000,
) -> StreamingQuery:
    """Score the new Parquet files of ``source`` into ``sink``, each row once.

    Scoring keeps no state; the run handles all files present and then stops.
    """
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(source)
    return (
        fitted.score(rows, threshold)
        .writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(sink)
    )
