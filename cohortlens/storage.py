"""Staging of intermediate tables in the shared checkpoint folder.

A staged table is computed once, survives the loss of executors, has a cut
lineage and - being Parquet - keeps column pruning and true size statistics.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """Shared scratch folder: the session's ``spark.checkpoint.dir``.

    Only a local session without the setting gets a temporary folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if re.match(r"local(\[|$)", spark.sparkContext.master) is None:
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="cohortlens-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


# rows that one task sorts or combines, in all some hundred MB
TASK_ROWS = 250_000


def dealt_tasks(spark: SparkSession, rows: int) -> int:
    """Tasks of about ``TASK_ROWS`` of ``rows`` rows; 0 for few rows, which are left to Spark."""
    tasks = -(-rows // TASK_ROWS)
    return tasks if tasks > spark.sparkContext.defaultParallelism else 0


def deal(df: DataFrame, rows: int, *by: str) -> DataFrame:
    """``df`` by the hash of ``by``, in tasks of about ``TASK_ROWS`` of ``rows`` rows; few rows are left to Spark.

    Spark's own partitions hold so many MB of compressed rows, and these may be millions.
    """
    tasks = dealt_tasks(df.sparkSession, rows)
    return df.repartition(tasks, *by) if tasks else df


def stage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` to the scratch folder and return the written table."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
