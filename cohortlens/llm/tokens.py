"""Vectorised words and rolling hashes over Arrow text batches.

Used inside Python tasks only. A text column is taken as one byte buffer with
document offsets; all word and hash work is NumPy over slices of about a
megabyte, so a task's memory does not depend on the number of rows in a batch.
Null texts count as empty.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.cloudpickle import register_pickle_by_value

# the functions below travel with the task, so executors need not have the package
register_pickle_by_value(sys.modules[__name__])

U64 = np.uint64
#: Bytes handled at once; a longer single document is handled alone.
SLICE_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2^64
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


def _table(blanks: bytes) -> np.ndarray:
    out = np.ones(256, dtype=bool)
    out[list(blanks)] = False
    return out


#: ``[^\x20\x09-\x0D]+``
NOT_SPACE = _table(b" \t\n\x0b\x0c\r")
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing A-Z
ALPHANUMERIC = _table(bytes([*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (Murmur3's finaliser)."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


_BYTE_CODES = mix(np.arange(1, 257, dtype=U64) * U64(_BASE))


def _power(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=U64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and the offsets of the documents in them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def slices(offsets: np.ndarray, size: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about ``size`` bytes each."""
    n, at = len(offsets) - 1, 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1)
        yield at, min(end, n)
        at = min(end, n)


def words(data: np.ndarray, off: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end bytes of every word, and the offsets of the documents in the list of words."""
    inside = table[data]
    before = np.zeros_like(inside)
    before[1:] = inside[:-1]
    edges = off[(off > 0) & (off < len(data))]
    before[off[off < len(data)]] = False
    after = np.zeros_like(inside)
    after[:-1] = inside[1:]
    after[edges - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, off)


def byte_codes(data: np.ndarray) -> np.ndarray:
    return _BYTE_CODES[data]


def prefix_sums(codes: np.ndarray) -> np.ndarray:
    """Prefix sums of a polynomial hash of 64-bit codes; see ``span_hash``."""
    out = np.zeros(len(codes) + 1, dtype=U64)
    np.cumsum(codes * _power(_BASE, len(codes)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The same number for the same run of codes, wherever it stands."""
    return mix((prefix[ends] - prefix[starts]) * _power(_BASE_INVERSE, len(prefix))[starts] + (ends - starts).astype(U64))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return span_hash(prefix_sums(_BYTE_CODES[data]), starts, ends)


def gram_hashes(items: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of ``k`` consecutive items; len(items) - k + 1 of them, across document ends too."""
    n = len(items) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=U64)
    out = items[:n].copy()
    for j in range(1, k):
        out *= U64(0xD6E8FEB86659FD93)
        out += items[j : j + n]
    return mix(out)


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """Index of the leftmost smallest value in each window of ``width``; one pass whatever the width."""
    n = len(values)
    if n < width:
        return np.zeros(0, dtype=np.int64)
    best, at = values, np.arange(n)
    span = 1
    while span < width:
        step = min(span, width - span)
        left, right = best[: len(best) - step], best[step:]
        take = right < left
        at = np.where(take, at[step:], at[: len(at) - step])
        best = np.where(take, right, left)
        span += step
    return at


def joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words with one space after each, and where they now start and end."""
    lengths = ends - starts + 1
    new_ends = np.cumsum(lengths)
    new_starts = new_ends - lengths
    out = np.full(int(new_ends[-1]) if len(new_ends) else 0, 32, dtype=np.uint8)
    source = np.repeat(starts - new_starts, lengths) + np.arange(len(out))
    inside = np.ones(len(out), dtype=bool)
    inside[new_ends - 1] = False
    out[inside] = data[source[inside]]
    return out, new_starts, new_ends - 1
