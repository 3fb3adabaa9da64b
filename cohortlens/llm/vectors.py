"""Embedding vectors as integers, for the operators on vectors.

A component x becomes floor(256 x), x taken as double. Used inside Python tasks
only; whole batches are NumPy work.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# the functions below travel with the task, so executors need not have the package
register_pickle_by_value(sys.modules[__name__])

SCALE = 256
#: Largest squared length that a vector could have with its largest component everywhere.
LIMIT = 1 << 50


def listed(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which rows are not NULL, their lengths (0 where NULL) and all elements as doubles (NaN where NULL)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    valid = np.asarray(column.is_valid())
    length = np.where(valid, column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), 0).astype(np.int64)
    return valid, length, column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)


def matrix(values: np.ndarray, length: np.ndarray, width: int | None = None) -> np.ndarray:
    """Rows of the given lengths as one array; shorter rows end in zeros."""
    width = max(int(length.max(initial=0)), width or 0)
    if len(length) and (length == width).all():
        return values.reshape(len(length), width)
    out = np.zeros((len(length), width), dtype=values.dtype)
    out[np.arange(width)[None, :] < length[:, None]] = values
    return out


def whole_vectors(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which rows hold a vector without NULL and non-finite components; lengths and integers of those rows."""
    valid, length, values = listed(column)
    owner = np.repeat(np.arange(len(length)), length)
    finite = np.isfinite(values)
    keep = valid & (np.bincount(owner[~finite], minlength=len(length)) == 0)
    scaled = np.floor(values[keep[owner]] * SCALE)
    width = int(length[keep].max(initial=0))
    if len(scaled) and np.abs(scaled).max() ** 2 * width >= LIMIT:
        raise ValueError("a vector is too long for exact 64-bit scores")
    return keep, length[keep], scaled.astype(np.int64)


def integer_vectors(rows: DataFrame, vector: str) -> DataFrame:
    """``rows`` whose ``vector`` is whole, with it as array<bigint>."""

    def run(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in incoming:
            keep, length, values = whole_vectors(batch.column(vector))
            at = pa.array(np.concatenate([[0], np.cumsum(length)]), pa.int32())
            kept = batch.filter(pa.array(keep))
            columns = [pa.ListArray.from_arrays(at, pa.array(values)) if name == vector else kept.column(name) for name in batch.schema.names]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return rows.mapInArrow(run, rows.withColumn(vector, F.lit(None).cast("array<bigint>")).schema)
