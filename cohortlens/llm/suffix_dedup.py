"""Suffix-array deduplication of bytes.

Each byte that lies in a string of ``window`` bytes which also starts anywhere
else, in the same document or another, is removed. Suffixes are sampled: only
those at anchors (see ``anchors``) are sorted, one in eighty or so, and of these
only the ones whose anchor occurs in different contexts; all others are settled
by counting. The suffixes that are left are range-partitioned with sampled splitters
by their leading bytes. A bucket sorts its suffixes, and the reversed text before
them, with a multikey quicksort whose characters are eight bytes. From the longest
common prefixes of neighbours follow, for every length, the classes of suffixes
that begin alike; a window at offset a before the anchor is the pair of its
class to the right (window - a bytes) and to the left (a bytes), and it repeats
if its pair does. Splitters look at fewer bytes than an anchor has, so equal
windows are never on two sides of a boundary and the last suffix of a bucket has
no partner in the next one.

Texts are taken as UTF-8 bytes, NULL as empty. A NULL doc_id is a document like
any other; equal rows are copies of each other. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.anchors import Tokens, Unit, applied, kept_windows, keyed

# the functions below travel with the task, so executors need not have the package
register_pickle_by_value(sys.modules[__name__])

WINDOW = 200
ANCHOR = 40
LEADING = 16


def multikey_order(rows: np.ndarray) -> np.ndarray:
    """The order of byte rows of equal width: ranges that are still equal are split by their next eight bytes."""
    n, width = rows.shape
    padded = np.zeros((n, -(-width // 8) * 8), dtype=np.uint8)
    padded[:, :width] = rows
    characters = padded.view(">u8").astype(np.uint64)
    order, part = np.arange(n), np.zeros(n, dtype=np.int64)
    open_ = np.arange(n)
    for k in range(characters.shape[1]):
        if len(open_) < 2:
            break
        who = order[open_]
        value = characters[who, k]
        inside = np.lexsort((value, part[open_]))
        order[open_] = who[inside]
        value, old = value[inside], part[open_]
        new = np.ones(len(open_), dtype=bool)
        new[1:] = (old[1:] != old[:-1]) | (value[1:] != value[:-1])
        # ranges are named by their first position, so names stay sorted
        part[open_] = np.maximum.accumulate(np.where(new, open_, 0))
        alone = new & np.append(new[1:], True)
        open_ = open_[~alone]
    return order


def common_prefixes(rows: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Of each row in the order with the one before it; the first has 0."""
    out = np.zeros(len(order), dtype=np.int64)
    for at in range(1, len(order), 4096):
        a, b = rows[order[at - 1 : at + 4095][: len(order) - at]], rows[order[at : at + 4096]]
        differs = a != b
        out[at : at + len(b)] = np.where(differs.any(axis=1), differs.argmax(axis=1), rows.shape[1])
    return out


def repeated(texts: list[bytes], anchor: np.ndarray, count: np.ndarray, times: np.ndarray, window: int, gram: int) -> np.ndarray:
    """How often each window of each context occurs: a matrix of contexts by windows, 0 beyond a context's count."""
    n, reach = len(texts), window - gram
    right, left = np.zeros((n, window), dtype=np.uint8), np.zeros((n, reach), dtype=np.uint8)
    for i, text in enumerate(texts):
        raw = np.frombuffer(text, dtype=np.uint8)
        after, before = raw[anchor[i] :][:window], raw[: anchor[i]][::-1]
        right[i, : len(after)] = after
        left[i, : len(before)] = before
    by_right, by_left = multikey_order(right), multikey_order(left)
    lcp, lcs = common_prefixes(right, by_right), common_prefixes(left, by_left)
    out = np.zeros((n, int(count.max()) if n else 0), dtype=np.int64)
    right_class, left_class = np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64)
    for a in range(reach + 1):
        valid = np.flatnonzero((anchor >= a) & (anchor - a < count))
        if not len(valid):
            continue
        right_class[by_right] = np.cumsum(lcp < window - a)
        left_class[by_left] = np.cumsum(lcs < a) if a else 0
        pair = right_class[valid] * (n + 1) + left_class[valid]
        _, which = np.unique(pair, return_inverse=True)
        out[valid, anchor[valid] - a] = np.bincount(which, times[valid])[which]
    return out


def resolve(contexts: DataFrame, unit: Unit) -> DataFrame:
    """Masks of the contexts that occur once."""
    schema = pa.schema([("doc", pa.int64()), ("pos", pa.int32()), ("mask", pa.binary())])

    def run(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = list(incoming)
        if not batches:
            return
        bucket = pa.Table.from_batches(batches)
        count = bucket.column("count").to_numpy().astype(np.int64)
        n = bucket.column("n").to_numpy()
        found = repeated(bucket.column("tokens").to_pylist(), bucket.column("anchor").to_numpy().astype(np.int64), count, n, unit.window, unit.gram)
        once = np.flatnonzero(n == 1)
        masks = [(found[i, : count[i]] == 1).astype(np.uint8).tobytes() for i in once.tolist()]
        pick = pa.array(once)
        whole = pa.RecordBatch.from_arrays(
            [bucket.column("doc").combine_chunks().take(pick), bucket.column("pos").combine_chunks().take(pick), pa.array(masks, pa.binary())],
            schema=schema,
        )
        for at in range(0, whole.num_rows, 10_000):
            yield whole.slice(at, 10_000)

    leading = F.substring("tokens", F.col("anchor") + 1, F.lit(min(LEADING, unit.gram)))
    buckets = contexts.withColumn("leading", leading).repartitionByRange("leading")
    return buckets.select("doc", "pos", "anchor", "count", "n", "tokens").mapInArrow(run, "doc long, pos int, mask binary")


def repeats(documents: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, with_bytes: bool = False) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans and the SHA-256 of the remaining bytes; ``with_bytes``
    adds them."""
    unit = Unit(window, anchor, words=False)
    docs = keyed(documents)
    fields = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]
    ddl = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    if with_bytes:
        fields, ddl = [*fields, ("kept", pa.binary())], f"{ddl}, kept binary"
    schema = pa.schema(fields)

    def make(piece: pa.RecordBatch, data: np.ndarray, t: Tokens, removed: np.ndarray) -> pa.RecordBatch:
        total = np.concatenate([[0], np.cumsum(removed)])
        gone = total[t.at[1:]] - total[t.at[:-1]]
        begins = removed.copy()
        begins[1:] &= ~removed[:-1]
        heads = t.at[:-1][t.at[:-1] < t.at[1:]]
        begins[heads] = removed[heads]
        spans = np.concatenate([[0], np.cumsum(begins)])
        edges = (t.at - total[t.at]).tolist()
        raw = data[~removed].tobytes()
        kept = [raw[x:y] for x, y in zip(edges, edges[1:])]
        columns = [piece.column("doc_id"), pa.array(np.diff(t.at).astype(np.int64)), pa.array(gone.astype(np.int64))]
        columns += [pa.array((spans[t.at[1:]] - spans[t.at[:-1]]).astype(np.int64))]
        columns.append(pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string()))
        if with_bytes:
            columns.append(pa.array(kept, pa.binary()))
        return pa.RecordBatch.from_arrays(columns, schema=schema)

    return applied(docs, kept_windows(docs, unit, resolve, False), unit, make, ddl)
