"""Quality classifier: a factorisation machine over words, structure and metadata.

A document is a sparse vector: hashed words (term weights of unit length),
statistics of its structure (as bins whose edges are quantiles of the training
rows) and metadata (the given length column, as bins). The score is

    w0 + sum_i w_i x_i + 1/2 sum_f [ (sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2 ]

through a sigmoid, so pairwise interactions cost one pass over the non-zero
entries. The model is fitted in one task on at most ``sample_rows`` labelled
rows (those with the smallest hash of doc_id, so reruns agree); every document
is scored, over its whole text, in Arrow batches.

Labels, language, source and doc_id are never inputs. Defined results: NULL and
empty texts are scored by their structure; a NULL length column has a bin of
its own; rows with a NULL doc_id are scored and never learned from; doc_ids
with contradicting labels are not learned from; with one class or no labels at
all the score is the share of label 1 (0.5 without labels). Extra columns are
carried along by ``classify`` and ``keep_good``.
"""

from __future__ import annotations

import pickle
import sys
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import fresh
from cohortlens.llm.tokens import ALPHANUMERIC, LOWER, NOT_SPACE, slices, text_buffer, word_hashes, words

# the functions below travel with the task, so executors need not have the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SAMPLE_ROWS = 12_000
BUCKET_BITS = 15
FACTORS = 8
BINS = 12
EPOCHS = 12
STATISTICS = (
    "bytes", "words", "lines", "word_bytes", "line_words", "distinct_words", "top_word", "repeated_neighbours",
    "upper", "digits", "symbols", "marked_words", "spaces", "no_end_mark", "repeated_lines", "length_column",
)


@dataclass
class Vectors:
    """Rows of hashed words (CSR) and of structure statistics."""

    at: np.ndarray
    index: np.ndarray
    value: np.ndarray
    stats: np.ndarray


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return part / np.maximum(whole, 1)


def _per_doc(mask: np.ndarray, off: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(mask)])
    return (total[off[1:]] - total[off[:-1]]).astype(np.float64)


def vectors(data: np.ndarray, off: np.ndarray, length: np.ndarray) -> Vectors:
    """Features of a slice of documents; ``length`` is the given length column, NaN where NULL."""
    n = len(off) - 1
    size = np.diff(off).astype(np.float64)
    low = LOWER[data]
    starts, ends, at = words(low, off, ALPHANUMERIC)
    hashes = word_hashes(low, starts, ends)
    count = np.diff(at)
    doc = np.repeat(np.arange(n, dtype=np.int64), count)
    key = (doc << BUCKET_BITS) | (hashes >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
    key, tf = np.unique(key, return_counts=True)
    row, index = key >> BUCKET_BITS, key & ((1 << BUCKET_BITS) - 1)
    value = 1 + np.log(tf)
    norm = np.sqrt(np.bincount(row, value * value, n))
    value = value / np.maximum(norm, 1e-9)[row]
    csr = np.searchsorted(row, np.arange(n + 1))
    top, distinct = np.zeros(n), np.diff(csr).astype(np.float64)
    np.maximum.at(top, row, tf)

    tokens, token_ends, token_at = words(data, off, NOT_SPACE)
    token_count = np.diff(token_at).astype(np.float64)
    letters = (data >= 0x80) | ((low >= 97) & (low <= 122))
    symbol = ~letters & NOT_SPACE[data] & ~((data >= 48) & (data <= 57))
    symbols = np.concatenate([[0], np.cumsum(symbol)])
    marked = np.concatenate([[0], np.cumsum(symbols[token_ends] - symbols[tokens] >= 2)])
    same = np.zeros(len(hashes) + 1, dtype=np.int64)
    if len(hashes) > 1:
        same[2:] = np.cumsum((hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1]))
    newline = data == 10
    lines = _per_doc(newline, off) + 1
    breaks = np.flatnonzero(newline)
    line_start = np.unique(np.concatenate([off[:-1], breaks + 1]))
    line_start = line_start[line_start < len(data)]
    repeated = np.zeros(n)
    if len(line_start):
        line_end = np.concatenate([line_start[1:], [len(data)]])
        line_doc = np.searchsorted(off, line_start, side="right") - 1
        line_hash = word_hashes(data, line_start, np.minimum(line_end, off[line_doc + 1]))
        pair = np.unique(np.stack([line_doc.astype(np.uint64), line_hash], axis=1), axis=0)
        kept = np.bincount(pair[:, 0].astype(np.int64), minlength=n)
        repeated = np.bincount(line_doc, minlength=n) - kept
    end_mark = (data == 46) | (data == 33) | (data == 63)
    stats = np.stack(
        [
            np.log1p(size),
            np.log1p(count),
            np.log1p(lines),
            _share(_per_doc(letters, off), count),
            np.log1p(count / lines),
            _share(distinct, count),
            _share(top, count),
            _share(same[at[1:]] - same[at[:-1]], count),
            _share(_per_doc((data >= 65) & (data <= 90), off), size),
            _share(_per_doc((data >= 48) & (data <= 57), off), size),
            _share(_per_doc(symbol, off), size),
            _share(marked[token_at[1:]] - marked[token_at[:-1]], token_count),
            _share(_per_doc(~NOT_SPACE[data], off), size),
            1 - np.minimum(1, _share(20 * _per_doc(end_mark, off), count)),
            _share(repeated, lines),
            np.log1p(np.maximum(length, 0)),
        ],
        axis=1,
    )
    return Vectors(csr, index, value.astype(np.float32), stats)


def joined(parts: list[Vectors]) -> Vectors:
    at = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(p.at) for p in parts]))])
    return Vectors(
        at,
        np.concatenate([p.index for p in parts]),
        np.concatenate([p.value for p in parts]),
        np.concatenate([p.stats for p in parts]),
    )


def batch_vectors(text: pa.Array, length: pa.Array) -> Iterator[Vectors]:
    data, off = text_buffer(text)
    numbers = length.cast(pa.float64()).to_numpy(zero_copy_only=False)
    for a, b in slices(off):
        yield vectors(data[off[a] : off[b]], off[a : b + 1] - off[a], numbers[a:b])


@dataclass
class Machine:
    """Weights of hashed words, then of the bins of every statistic."""

    bias: float
    linear: np.ndarray = field(default_factory=lambda: np.zeros(0))
    factors: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    edges: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))

    def binned(self, stats: np.ndarray) -> np.ndarray:
        """The feature number of each statistic's bin; NaN has the last bin."""
        out = np.empty(stats.shape, dtype=np.int64)
        for j in range(stats.shape[1]):
            b = np.searchsorted(self.edges[j], stats[:, j], side="right")
            out[:, j] = (1 << BUCKET_BITS) + j * (BINS + 1) + np.where(np.isnan(stats[:, j]), BINS, np.minimum(b, BINS - 1))
        return out

    def margins(self, x: Vectors) -> np.ndarray:
        n = len(x.at) - 1
        if not len(self.linear):
            return np.full(n, self.bias)
        bins = self.binned(x.stats)
        row = np.repeat(np.arange(n), np.diff(x.at))
        out = self.bias + np.bincount(row, self.linear[x.index] * x.value, n) + self.linear[bins].sum(axis=1)
        for f in range(self.factors.shape[1]):
            v = self.factors[:, f]
            term, level = v[x.index] * x.value, v[bins]
            total = np.bincount(row, term, n) + level.sum(axis=1)
            out += 0.5 * (total * total - np.bincount(row, term * term, n) - (level * level).sum(axis=1))
        return out

    def scores(self, x: Vectors) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(x), -30, 30)))


def fit(x: Vectors, y: np.ndarray, epochs: int = EPOCHS, factors: int = FACTORS, seed: int = 11) -> Machine:
    """Log loss by AdaGrad over mini-batches with a little weight decay; deterministic."""
    n = len(y)
    share = float(y.mean()) if n else 0.5
    if n == 0 or share in (0.0, 1.0):
        share = min(max(share, 0.0), 1.0)
        return Machine(bias=0.0 if n == 0 else (30.0 if share == 1 else -30.0))
    edges = np.stack([np.nan_to_num(np.nanquantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) if not np.isnan(c).all() else np.zeros(BINS - 1) for c in x.stats.T])
    rng = np.random.default_rng(seed)
    width = (1 << BUCKET_BITS) + len(STATISTICS) * (BINS + 1)
    m = Machine(float(np.log(share / (1 - share))), np.zeros(width), rng.normal(0, 0.01, (width, factors)), edges)
    bins = m.binned(x.stats)
    seen_w, seen_v, seen_b = np.full(width, 1e-6), np.full((width, factors), 1e-6), 1e-6
    per = x.stats.shape[1]
    for _ in range(epochs):
        order = rng.permutation(n)
        for at in range(0, n, 256):
            rows = order[at : at + 256]
            sizes = x.at[rows + 1] - x.at[rows]
            pick = np.repeat(x.at[rows] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
            row = np.concatenate([np.repeat(np.arange(len(rows)), sizes), np.repeat(np.arange(len(rows)), per)])
            index = np.concatenate([x.index[pick], bins[rows].ravel()])
            value = np.concatenate([x.value[pick], np.ones(len(rows) * per)])
            touched, local = np.unique(index, return_inverse=True)
            v = m.factors[index] * value[:, None]
            total = np.stack([np.bincount(row, v[:, f], len(rows)) for f in range(factors)], axis=1)
            squares = np.bincount(row, (v * v).sum(axis=1), len(rows))
            margin = m.bias + np.bincount(row, m.linear[index] * value, len(rows)) + 0.5 * ((total**2).sum(axis=1) - squares)
            error = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y[rows]) / len(rows)
            slope = error[row] * value
            g = np.bincount(local, slope, len(touched)) + 1e-6 * m.linear[touched]
            seen_w[touched] += g * g
            m.linear[touched] -= 0.15 * g / np.sqrt(seen_w[touched])
            for f in range(factors):
                gf = np.bincount(local, slope * (total[row, f] - v[:, f]), len(touched)) + 1e-5 * m.factors[touched, f]
                seen_v[touched, f] += gf * gf
                m.factors[touched, f] -= 0.05 * gf / np.sqrt(seen_v[touched, f])
            gb = error.sum()
            seen_b += gb * gb
            m.bias -= 0.05 * gb / np.sqrt(seen_b)
    return m


_MODEL = "bias double, linear array<double>, factors array<double>, edges array<double>"


def train(documents: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, holdout: bool = True) -> Machine:
    """A machine fitted on labelled documents; with ``holdout`` only on those whose
    crc32(doc_id as text) modulo 3 is not 1."""
    known = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    known = known.agg(F.min("quality").alias("low"), F.max("quality").alias("high")).where("low = high")
    if holdout:
        known = known.where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1)
    # at most sample_rows ids and labels: a bounded table, sent along with the scan
    picked = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows).select("doc_id", F.col("high").alias("y"))
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "n_chars")
    rows = rows.join(F.broadcast(picked), "doc_id").select("doc_id", "text", F.col("n_chars").cast("double"), F.col("y").cast("double"))
    # repeated ids must not lift the sample above its bound, nor tasks decide which text stands for an id
    one = F.min(F.struct(F.xxhash64("text", "n_chars").alias("h"), "text", "n_chars", "y")).alias("r")
    rows = rows.groupBy("doc_id").agg(one).select("doc_id", "r.text", "r.n_chars", "r.y")

    def features(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in incoming:
            parts = list(batch_vectors(batch.column("text"), batch.column("n_chars")))
            if parts:
                x = joined(parts)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id"),
                        batch.column("y"),
                        pa.ListArray.from_arrays(pa.array(x.at, pa.int32()), pa.array(x.index, pa.int32())),
                        pa.ListArray.from_arrays(pa.array(x.at, pa.int32()), pa.array(x.value, pa.float32())),
                        pa.array(list(x.stats), pa.list_(pa.float64())),
                    ],
                    names=["doc_id", "y", "index", "value", "stats"],
                )

    def learn(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("doc_id")
        x = Vectors(
            np.concatenate([[0], np.cumsum([len(i) for i in pdf["index"]])]).astype(np.int64),
            np.concatenate(list(pdf["index"])).astype(np.int64),
            np.concatenate(list(pdf["value"])),
            np.stack(list(pdf["stats"])),
        )
        m = fit(x, pdf["y"].to_numpy(np.float64))
        return pd.DataFrame({"bias": [m.bias], "linear": [m.linear], "factors": [m.factors.ravel()], "edges": [m.edges.ravel()]})

    table = rows.mapInArrow(features, "doc_id long, y double, index array<int>, value array<float>, stats array<double>")
    found = table.groupBy(F.lit(0).alias("all")).applyInPandas(learn, _MODEL).collect()
    if not found:
        return Machine(bias=0.0)
    r = found[0]
    if not r["linear"]:
        return Machine(bias=r["bias"])
    linear = np.array(r["linear"])
    return Machine(r["bias"], linear, np.array(r["factors"]).reshape(len(linear), -1), np.array(r["edges"]).reshape(len(STATISTICS), -1))


def classify(documents: DataFrame, machine: Machine, score: str = "score") -> DataFrame:
    """``documents`` with one more column, the score of the whole text."""
    shared = documents.sparkSession.sparkContext.broadcast(cloudpickle.dumps(machine))

    def run(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = pickle.loads(shared.value)
        for batch in incoming:
            parts = [fitted.scores(x) for x in batch_vectors(batch.column("text"), batch.column("n_chars"))]
            scores = pa.array(np.concatenate(parts) if parts else np.zeros(0), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, scores], names=[*batch.schema.names, score])

    return documents.mapInArrow(run, documents.select("*", F.lit(0.0).alias(score)).schema)


def score_documents(documents: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row per document: doc_id, held_out, score and predicted."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("n_chars").cast("double").alias("n_chars"))
    scored = classify(rows, train(documents, labels, sample_rows))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    return scored.select(
        "doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).cast("int").alias("predicted")
    )


def keep_good(documents: DataFrame, labels: DataFrame, threshold: float = 0.5, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The documents that score at least ``threshold``, with their columns."""
    (score,) = fresh(documents, "score")
    scored = classify(documents, train(documents, labels, sample_rows), score)
    return scored.where(F.col(score) >= threshold).drop(score)
