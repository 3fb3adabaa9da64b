"""Small helpers that the text operators share."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.storage import stage

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: ``[^\x20\x09-\x0D]+`` and its complement, for Spark's regular expressions
BLANKS = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared scratch folder; the shuffle files behind it are freed.

    Readers of the table do not depend on the executors that wrote it.
    """
    spark = df.sparkSession
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        return stage(df, name)
    finally:
        spark.conf.set(_CLEANUP, before)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that do not occur in ``df``."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def batches(columns: dict[str, pa.Array], schema: pa.Schema, rows: int = 4096) -> Iterator[pa.RecordBatch]:
    """One record batch of ``schema``, cut into pieces of ``rows``."""
    whole = pa.RecordBatch.from_arrays([_as(columns[f.name], f.type) for f in schema], schema=schema)
    for at in range(0, whole.num_rows, rows):
        yield whole.slice(at, rows)


def _as(values: object, kind: pa.DataType) -> pa.Array:
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    if isinstance(values, pa.Array):
        return values if values.type == kind else values.cast(kind)
    return pa.array(values, type=kind)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def same(a: DataFrame, b: DataFrame, columns: Iterable[str]) -> Column:
    """Equality of columns in which NULL equals NULL."""
    out = F.lit(True)
    for c in columns:
        out = out & a[c].eqNullSafe(b[c])
    return out
