"""Vector code compression: product codebooks refined with norm-of-sum bounds.

A vector is cut into ``parts`` equal parts; each part is coded by the nearest
entry of its part's codebook. Codebooks start from given vectors and are refined
in rounds: assign all parts, then move each entry to the mean of its parts.

A part keeps its entry, a lower bound of its distance to every other entry, and
the stamp of the round the bound was measured in. The codebooks of all rounds are
kept, so in a later round the bound falls only by the true net displacement of
entries since the stamp, the norm of the sum of their moves; moves that cancel out
cost nothing, whereas adding up drifts round by round would. A part whose distance
to its own entry stays below that keeps its entry unseen; the others are scanned
exactly against all entries, which renews bound and stamp. Distances are squared
integers, and bounds lean to the safe side, so codes are those of a full scan.

Each round is one pass over the staged vectors that writes the new codes, bounds
and stamps next to them, and one aggregate of sums and counts, combined in each
task first. Only codebooks (parts x entries x components numbers) pass the driver.

Defined results: rows with a NULL vector or a NULL or non-finite component are
dropped. Vectors of unequal length, or of a length that ``parts`` does not divide,
end in zeros up to the next multiple above the longest. The codebooks start with
the smallest vec_ids, NULLs left out; of rows that share one of these, the
smallest vector counts. All rows are coded, repeated ones too. With fewer ids the
codebooks are smaller; without any, codes and errors are NULL. An entry without
parts stays where it is. An empty table gives no rows. Other columns are ignored;
vectors with components beyond about 16,000 end the job with an error.
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

from cohortlens.llm.common import staged
from cohortlens.llm.vectors import integer_vectors, listed, matrix

# the functions below travel with the task, so executors need not have the package
register_pickle_by_value(sys.modules[__name__])

PARTS = 16
ENTRIES = 64
ROUNDS = 2
#: Vectors handled at once in a task.
CHUNK = 2048
#: Relative slack of measured distances, far above the rounding of a square root.
SLACK = 1e-9


def squares(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Squared distances (rows x entries) of int64 rows; exact."""
    return (x * x).sum(axis=1)[:, None] - 2 * (x @ book.T) + (book * book).sum(axis=1)[None, :]


def falls(history: list[np.ndarray]) -> np.ndarray:
    """How far a lower bound falls: [stamp, part, own entry], the longest net way of any other entry since the stamp."""
    now = history[-1]
    out = np.zeros((len(history), now.shape[0], now.shape[1]))
    for stamp, then in enumerate(history):
        # rounded up
        way = np.sqrt(((now - then) ** 2).sum(axis=2).astype(np.float64)) * (1 + SLACK)
        for p in range(way.shape[0]):
            order = np.sort(way[p])
            # the longest, or the second longest for the entry that went it
            out[stamp, p] = np.where(np.arange(len(order)) == way[p].argmax(), order[-2] if len(order) > 1 else 0.0, order[-1])
    return out


def assigned(x: np.ndarray, history: list[np.ndarray], state: tuple[np.ndarray, np.ndarray, np.ndarray] | None):
    """Entries, bounds, stamps and squared distances (rows x parts) under the last codebooks, and the number of parts scanned."""
    books, now = history[-1], len(history) - 1
    parts, entries, _ = books.shape
    x = x.reshape(len(x), parts, -1)
    if state is None:
        code = np.zeros(x.shape[:2], np.uint8)
        bound, stamp = np.full(x.shape[:2], -1.0), np.zeros(x.shape[:2], np.uint8)
    else:
        code, bound, stamp = state[0].copy(), state[1].astype(np.float64), state[2].copy()
    own = ((x - books[np.arange(parts)[None, :], code]) ** 2).sum(axis=2)
    fall = falls(history)[stamp, np.arange(parts)[None, :], code]
    scan = np.sqrt(own.astype(np.float64)) * (1 + SLACK) >= bound - fall
    for p in range(parts):
        rows = np.flatnonzero(scan[:, p])
        if not len(rows):
            continue
        found = squares(x[rows, p], books[p])
        best = found.argmin(axis=1)  # the first of equal ones
        code[rows, p], own[rows, p], stamp[rows, p] = best, found[np.arange(len(rows)), best], now
        found[np.arange(len(rows)), best] = np.iinfo(np.int64).max
        # rounded down; of one entry alone there is no other
        bound[rows, p] = np.sqrt(found.min(axis=1).astype(np.float64)) * (1 - SLACK) if entries > 1 else np.inf
    return code, bound, stamp, own, int(scan.sum())


def _packed(a: np.ndarray, kind: str) -> pa.Array:
    raw = np.ascontiguousarray(a, dtype=kind)
    return pa.array([r.tobytes() for r in raw], pa.binary())


def _unpacked(column: pa.Array, kind: str, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind).reshape(-1, width)


def _chunks(incoming: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in incoming:
        for at in range(0, batch.num_rows, CHUNK):
            piece = batch.slice(at, CHUNK)
            _, length, values = listed(piece.column("x"))
            yield piece, matrix(values.astype(np.int64), length, width)


def _round(table: DataFrame, history: list[np.ndarray], width: int) -> DataFrame:
    """The staged (vec_id, label, x, code, bound, stamp, error, scanned) under the last codebooks."""
    parts = history[0].shape[0]
    shared = table.sparkSession.sparkContext.broadcast(history)
    kept = "code" in table.columns

    def run(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, x in _chunks(incoming, width):
            state = None
            if kept:
                state = tuple(_unpacked(piece.column(c), kind, parts) for c, kind in (("code", "u1"), ("bound", "f4"), ("stamp", "u1")))
            code, bound, stamp, own, scanned = assigned(x, shared.value, state)
            columns = [piece.column(c) for c in ("vec_id", "label", "x")]
            columns += [_packed(code, "u1"), _packed(np.nextafter(bound.astype("f4"), np.float32(-np.inf)), "f4"), _packed(stamp, "u1")]
            columns += [pa.array(own.sum(axis=1)), pa.array([scanned] + [0] * (len(x) - 1), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "label", "x", "code", "bound", "stamp", "error", "scanned"])

    label = dict(table.dtypes)["label"]
    out = table.mapInArrow(run, f"vec_id long, label {label}, x array<bigint>, code binary, bound binary, stamp binary, error long, scanned long")
    out = staged(out, "codes")
    shared.unpersist()
    return out


def _moved(table: DataFrame, book: np.ndarray, width: int) -> np.ndarray:
    """The codebooks at the means of their parts, rounded down; entries without parts stay."""
    parts, entries, size = book.shape

    def run(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, size), np.int64)
        for piece, x in _chunks(incoming, width):
            x, code = x.reshape(len(x), parts, size), _unpacked(piece.column("code"), "u1", parts)
            for p in range(parts):
                np.add.at(count[p], code[:, p], 1)
                np.add.at(total[p], code[:, p], x[:, p])
        p, e = np.nonzero(count)
        numbers = np.concatenate([count[p, e][:, None], total[p, e]], axis=1)
        at = pa.array(np.arange(len(p) + 1) * (size + 1), pa.int32())
        columns = [pa.array(p.astype(np.int32)), pa.array(e.astype(np.int32)), pa.ListArray.from_arrays(at, pa.array(numbers.ravel()))]
        yield pa.RecordBatch.from_arrays(columns, names=["part", "entry", "numbers"])

    found = table.select("x", "code").mapInArrow(run, "part int, entry int, numbers array<bigint>")
    sums = found.select("part", "entry", F.posexplode("numbers").alias("place", "s")).groupBy("part", "entry", "place")
    # parts x entries x (components + 1) rows
    rows = sums.agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    counts = {(r.part, r.entry): int(r.s) for r in rows if r.place == 0}
    out = book.copy()
    for r in rows:
        if r.place:
            out[r.part, r.entry, r.place - 1] = int(r.s) // counts[r.part, r.entry]
    return out


def starting_books(rows: DataFrame, width: int, parts: int, entries: int) -> np.ndarray:
    """Codebooks (parts x entries x components) from the vectors with the smallest ids."""
    # only ids travel; vectors are read of at most ``entries`` of them
    first = rows.select("vec_id").where("vec_id IS NOT NULL").distinct().orderBy("vec_id").limit(entries)
    chosen = rows.join(F.broadcast(first), "vec_id").groupBy("vec_id").agg(F.min("x").alias("x"))
    vectors = sorted((r.vec_id, list(r.x)) for r in chosen.collect())
    books = np.zeros((len(vectors), width), np.int64)
    for i, (_, x) in enumerate(vectors):
        books[i, : len(x)] = x
    return np.ascontiguousarray(books.reshape(len(vectors), parts, width // parts).transpose(1, 0, 2))


def encode(
    embeddings: DataFrame, vector: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS
) -> tuple[DataFrame, list[np.ndarray], list[int]]:
    """The coded table (vec_id, label, x, code, bound, stamp, error), the codebooks of all rounds and the parts scanned in each pass."""
    if not 1 <= entries <= 256:
        raise ValueError(f"entries: {entries}")
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.col(vector).alias("x")).where("x IS NOT NULL")
    rows = staged(integer_vectors(rows, "x"), "vectors")
    longest = rows.agg(F.max(F.size("x"))).first()[0] or 0
    width = -(-longest // parts) * parts
    history = [starting_books(rows, width, parts, entries)]
    if not history[0].shape[1]:
        return rows.selectExpr("*", "CAST(NULL AS BINARY) AS code", "CAST(NULL AS BIGINT) AS error"), history, []
    scanned, table = [], _round(rows, history, width)
    for _ in range(rounds):
        scanned.append(table.agg(F.sum("scanned")).first()[0])
        history.append(_moved(table, history[-1], width))
        table = _round(table, history, width)
    scanned.append(table.agg(F.sum("scanned")).first()[0])
    return table, history, scanned


def books_digest(books: np.ndarray) -> str:
    """SHA-256 of the components by part, entry and place, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(embeddings: DataFrame, vector: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """One row per kept vector: vec_id, code (two hex digits a part), error, label_error and codebooks_sha256."""
    table, history, _ = encode(embeddings, vector, parts, entries, rounds)
    rows = table.select("vec_id", "label", F.lower(F.hex("code")).alias("code"), "error")
    # one row per label
    totals = rows.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of")
    both = rows.join(totals, rows["label"].eqNullSafe(totals["of"]))
    return both.select("vec_id", "code", "error", "label_error", F.lit(books_digest(history[-1])).alias("codebooks_sha256"))
