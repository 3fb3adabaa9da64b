"""Hard-negative mining with Strassen multiplication on anchor-candidate tiles.

Every row that takes part is a candidate, in tiles against a block of anchors.
The scores of a tile are one product of int64 matrices by Strassen's recursion:
seven half-size products of exact sums, zero padding where a side is odd, and a
plain product below ``LEAF``. Integers wrap modulo 2^64 in all of it, so the
result is exact whenever the scores themselves fit, which is checked.

Two passes over the candidates, each with one block of at most about
``BLOCK_ANCHORS`` anchors broadcast at a time (8 MB at 64 components):

1. a heap of the best ``positives`` rows of its label for every anchor;
2. a heap of the best ``negatives`` rows for every anchor and positive, of another
   label and with a score inside the positive's window.

A task keeps its heaps over all its rows and emits them once; Spark merges the
heaps of all tasks by rank. No candidate is shuffled and no tile leaves its task.

Defined results: rows with a NULL label, a NULL vector, or a NULL or non-finite
component take no part; of rows that share a vec_id the one with the smallest
(label, vector) does. A row without vec_id is a candidate and no anchor, and comes
last among equal scores. Shorter vectors end in zeros. Other columns are ignored;
an empty table gives no rows. Vectors with components beyond about 16,000 (at 64
of them) end the job with an error, as scores would not be exact.
"""

from __future__ import annotations

import pickle
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.llm.common import staged
from cohortlens.llm.vectors import integer_vectors, listed, matrix

# the functions below travel with the task, so executors need not have the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

POSITIVES = 5
NEGATIVES = 3
#: Least and greatest share of the positive's score, in hundredths.
WINDOW = (50, 95)
BLOCK_ANCHORS = 16_384
#: Anchors and candidates of a tile; sides at which the recursion ends.
TILE = (512, 2048)
LEAF = 32
NONE = np.iinfo(np.int64).min


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """The product of int64 matrices, exact modulo 2^64."""
    n, k, m = a.shape[0], a.shape[1], b.shape[1]
    if min(n, k, m) <= leaf:
        return a @ np.asfortranarray(b)
    a = np.pad(a, ((0, n % 2), (0, k % 2)))
    b = np.pad(b, ((0, k % 2), (0, m % 2)))
    i, j, l = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:i, :j], a[:i, j:], a[i:, :j], a[i:, j:]
    b11, b12, b21, b22 = b[:j, :l], b[:j, l:], b[j:, :l], b[j:, l:]
    c = np.empty((2 * i, 2 * l), dtype=np.int64)
    c11, c12, c21, c22 = c[:i, :l], c[:i, l:], c[i:, :l], c[i:, l:]
    p = strassen(a11 + a22, b11 + b22, leaf)
    c11[:], c22[:] = p, p
    p = strassen(a21 + a22, b11, leaf)
    c21[:] = p
    c22 -= p
    p = strassen(a11, b12 - b22, leaf)
    c12[:] = p
    c22 += p
    p = strassen(a22, b21 - b11, leaf)
    c11 += p
    c21 += p
    p = strassen(a11 + a12, b22, leaf)
    c11 -= p
    c12 += p
    c22 += strassen(a21 - a11, b11 + b12, leaf)
    c11 += strassen(a12 - a22, b21 + b22, leaf)
    return c[:n, :m]


@dataclass
class Heaps:
    """The best ``size`` (score, id) of every slot, best first; scores come first, then smaller ids, NULL ids last."""

    score: np.ndarray
    id: np.ndarray
    missing: np.ndarray

    @classmethod
    def empty(cls, slots: int, size: int) -> "Heaps":
        return cls(np.full((slots, size), NONE), np.zeros((slots, size), np.int64), np.ones((slots, size), bool))

    def offer(self, slots: np.ndarray, scores: np.ndarray, allowed: np.ndarray | None, ids: np.ndarray, missing: np.ndarray) -> None:
        """Merge a tile (slots x candidates, candidates in order of id) into the heaps of ``slots``."""
        size, m = self.score.shape[1], scores.shape[1]
        if not m or not len(slots):
            return
        # equal scores are in order of id, so a score and a place make one number
        ranked = scores * m + np.arange(m - 1, -1, -1)
        if allowed is not None:
            ranked = np.where(allowed, ranked, NONE)
        open_ = self.score[slots, -1] == NONE
        last = np.where(open_, NONE, self.score[slots, -1])
        can = np.flatnonzero((ranked.max(axis=1) > NONE) & (open_ | (scores.max(axis=1) >= last)))
        if not len(can):
            return
        ranked, at = ranked[can], slots[can]
        top = min(size, m)
        best = np.partition(ranked, m - top, axis=1)[:, m - top :]
        place = m - 1 - best % m
        found = np.where(best == NONE, NONE, best // m)
        score = np.concatenate([self.score[at], found], axis=1)
        id_ = np.concatenate([self.id[at], ids[place]], axis=1)
        gone = np.concatenate([self.missing[at], missing[place] | (best == NONE)], axis=1)
        order = np.lexsort((id_, gone, -np.maximum(score, NONE + 1)), axis=1)[:, :size]
        self.score[at] = np.take_along_axis(score, order, axis=1)
        self.id[at] = np.take_along_axis(id_, order, axis=1)
        self.missing[at] = np.take_along_axis(gone, order, axis=1)


@dataclass
class Anchors:
    """A block of anchors, in order of label; ``low`` and ``high`` bound the windows of their positives."""

    id: np.ndarray
    label: np.ndarray
    x: np.ndarray
    low: np.ndarray | None = None
    high: np.ndarray | None = None


def _tiles(batch: pa.RecordBatch, width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Candidates by TILE: ids (0 where NULL), which are NULL, labels, vectors; each tile in order of id."""
    _, length, values = listed(batch.column("x"))
    x = matrix(values.astype(np.int64), length, width)
    ids = batch.column("vec_id").fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    missing = ~np.asarray(batch.column("vec_id").is_valid())
    label = batch.column("label").to_numpy(zero_copy_only=False).astype(np.int64)
    order = np.lexsort((ids, missing))
    for at in range(0, len(order), TILE[1]):
        some = order[at : at + TILE[1]]
        yield ids[some], missing[some], label[some], x[some]


def _padded(a: np.ndarray, width: int) -> np.ndarray:
    return np.pad(a, ((0, 0), (0, width - a.shape[1]))) if a.shape[1] < width else a


def best_of_label(anchors: Anchors, batches: Iterator[pa.RecordBatch], size: int) -> Heaps:
    """Heaps of the other rows of each anchor's label."""
    heaps = Heaps.empty(len(anchors.id), size)
    for batch in batches:
        for ids, missing, label, x in _tiles(batch, anchors.x.shape[1]):
            for value in np.unique(label):
                a, b = (np.searchsorted(anchors.label, value, side=side) for side in ("left", "right"))
                mine = np.flatnonzero(label == value)
                right = np.ascontiguousarray(x[mine].T)
                for at in range(a, b, TILE[0]):
                    slots = np.arange(at, min(at + TILE[0], b))
                    scores = strassen(_padded(anchors.x[slots], x.shape[1]), right)
                    own = (ids[mine][None, :] == anchors.id[slots][:, None]) & ~missing[mine][None, :]
                    heaps.offer(slots, scores, ~own, ids[mine], missing[mine])
    return heaps


def best_in_window(anchors: Anchors, batches: Iterator[pa.RecordBatch], size: int) -> Heaps:
    """Heaps of rows of other labels, one for each anchor and window; slot = anchor * windows + window."""
    windows = anchors.low.shape[1]
    heaps = Heaps.empty(len(anchors.id) * windows, size)
    for batch in batches:
        for ids, missing, label, x in _tiles(batch, anchors.x.shape[1]):
            right = np.ascontiguousarray(x.T)
            for at in range(0, len(anchors.id), TILE[0]):
                rows = np.arange(at, min(at + TILE[0], len(anchors.id)))
                scores = strassen(_padded(anchors.x[rows], x.shape[1]), right)
                other = label[None, :] != anchors.label[rows][:, None]
                for w in range(windows):
                    inside = (scores >= anchors.low[rows, w][:, None]) & (scores <= anchors.high[rows, w][:, None]) & other
                    some = np.flatnonzero(inside.any(axis=1))
                    heaps.offer(rows[some] * windows + w, scores[some], inside[some], ids, missing)
    return heaps


def prepared(embeddings: DataFrame, vector: str = "embedding") -> DataFrame:
    """Staged (vec_id, label, x): the rows that take part, as integers, one for a vec_id."""
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col(vector).alias("x"))
    rows = staged(integer_vectors(rows.where("label IS NOT NULL AND x IS NOT NULL"), "x"), "vectors")
    repeated = rows.where("vec_id IS NOT NULL").groupBy("vec_id").count().where("count > 1").select("vec_id")
    repeated = staged(repeated, "repeated-ids")
    if repeated.isEmpty():
        return rows
    once = rows.join(repeated, "vec_id", "left_anti")
    chosen = rows.join(repeated, "vec_id", "left_semi").groupBy("vec_id").agg(F.min(F.struct("label", "x")).alias("r"))
    return staged(once.unionByName(chosen.select("vec_id", "r.label", "r.x")), "vectors")


def _block(table: pa.Table) -> Anchors:
    """Anchors from (vec_id, label, x), by label and id."""
    table = table.sort_by([("label", "ascending"), ("vec_id", "ascending")])
    _, length, values = listed(table.column("x"))
    return Anchors(table.column("vec_id").to_numpy(), table.column("label").to_numpy(), matrix(values.astype(np.int64), length))


def _mined(candidates: DataFrame, anchors: Anchors, size: int, windows: int) -> DataFrame:
    """Heap entries of all tasks: (anchor_id, slot, id, score); ``windows`` is 0 for positives."""
    shared = candidates.sparkSession.sparkContext.broadcast(cloudpickle.dumps(anchors))
    schema = pa.schema([("anchor_id", pa.int64()), ("slot", pa.int32()), ("id", pa.int64()), ("score", pa.int64())])

    def run(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = pickle.loads(shared.value)
        heaps = best_in_window(block, incoming, size) if windows else best_of_label(block, incoming, size)
        slot, entry = np.nonzero(heaps.score != NONE)
        per = max(1, windows)
        columns = [
            pa.array(block.id[slot // per]),
            pa.array((slot % per).astype(np.int32)),
            pa.array(heaps.id[slot, entry], mask=heaps.missing[slot, entry]),
            pa.array(heaps.score[slot, entry]),
        ]
        out = pa.RecordBatch.from_arrays(columns, schema=schema)
        for at in range(0, out.num_rows, 65_536):
            yield out.slice(at, 65_536)

    found = candidates.mapInArrow(run, "anchor_id long, slot int, id long, score long")
    best = Window.partitionBy("anchor_id", "slot").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    merged = staged(found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= size), "heaps")
    shared.unpersist()
    return merged


def mine(
    embeddings: DataFrame,
    vector: str = "embedding",
    relabel: str = "label",
    anchor: str = "vec_id % 50 = 0",
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    window: tuple[int, int] = WINDOW,
    block_anchors: int = BLOCK_ANCHORS,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``relabel`` and ``anchor`` are SQL over vec_id and label. A negative's score lies between
    ``window[0]`` and ``window[1]`` hundredths of the positive's.
    """
    spark = embeddings.sparkSession
    rows = prepared(embeddings, vector)
    rows = rows.select("vec_id", F.expr(relabel).cast("long").alias("label"), "x").where("label IS NOT NULL")
    chosen = rows.where(f"vec_id IS NOT NULL AND ({anchor})")
    blocks = -(-chosen.count() // block_anchors)
    parts = []
    for block in range(blocks):
        mine_ = chosen.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == block)
        table = mine_.toArrow()  # about block_anchors rows
        if not table.num_rows:
            continue
        anchors = _block(table)
        near = _mined(rows, anchors, positives, 0)
        # at most block_anchors x positives rows
        found = near.select("anchor_id", "rank", "score").toArrow()
        anchors.low = np.ones((len(anchors.id), positives), np.int64)
        anchors.high = np.zeros((len(anchors.id), positives), np.int64)
        slot = {a: i for i, a in enumerate(anchors.id.tolist())}
        row = np.array([slot[a] for a in found.column("anchor_id").to_pylist()], dtype=np.int64)
        place, score = found.column("rank").to_numpy() - 1, found.column("score").to_numpy()
        anchors.low[row, place] = -(-window[0] * score // 100)
        anchors.high[row, place] = window[1] * score // 100
        hard = _mined(rows, anchors, negatives, positives)
        positive = near.select("anchor_id", (F.col("rank") - 1).alias("slot"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
        parts.append(
            hard.join(positive, ["anchor_id", "slot"]).select(
                "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
            )
        )
    if not parts:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out
