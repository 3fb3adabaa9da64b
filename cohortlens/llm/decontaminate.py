"""Benchmark decontamination with a broadcast set of test n-grams.

Words are runs of digits, letters a-z (after lower-casing A-Z) and any
character outside ASCII. A window is ``n`` consecutive words of a benchmark
item; a shorter item is one window of all its words. The hashes of all windows
are broadcast, every document's token windows are scanned against them, and
each hit is verified word for word against the item before it counts.

What is broadcast has a bound: a block of benchmark items of at most
``block_bytes`` of text. A larger benchmark is scanned block by block, each
block against all documents, and the hits of the blocks are united.

Defined results: a NULL or empty text has no words and no hits. Items without
words or without item_id match nothing. Repeated items count once, by item_id.
Repeated documents each get their own row. Extra columns are carried along
untouched by ``remove_documents`` and ``remove_spans``.
"""

from __future__ import annotations

import hashlib
import pickle
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import fresh, staged
from cohortlens.llm.tokens import ALPHANUMERIC, LOWER, gram_hashes, joined, slices, text_buffer, word_hashes, words

# the functions below travel with the task, so executors need not have the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

WINDOW = 10
BLOCK_BYTES = 8 << 20
_SIEVE_BITS = 20


@dataclass
class WindowTable:
    """The distinct windows of one length: sorted hashes, the place of one copy of each, and its items."""

    keys: np.ndarray
    starts: np.ndarray  # bytes in the normalised benchmark
    ends: np.ndarray
    item_at: np.ndarray  # item_at[i]:item_at[i + 1] of items have window i
    items: np.ndarray
    sieve: np.ndarray

    def find(self, hashes: np.ndarray, sieve_shift: int = 64 - _SIEVE_BITS) -> tuple[np.ndarray, np.ndarray]:
        """Positions with a known hash, and the first window that has it."""
        at = np.flatnonzero(self.sieve[hashes >> np.uint64(sieve_shift)])
        found = np.searchsorted(self.keys, hashes[at])
        found[found == len(self.keys)] = 0
        good = self.keys[found] == hashes[at]
        return at[good], found[good]


@dataclass
class Benchmark:
    """The normalised windows of a block of items; what a task gets."""

    text: np.ndarray
    ids: list[str]
    tables: dict[int, WindowTable]


def normalised(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, word starts and ends, document offsets in words, word hashes."""
    data = LOWER[data]
    starts, ends, at = words(data, off, ALPHANUMERIC)
    return data, starts, ends, at, word_hashes(data, starts, ends)


def build(items: list[tuple[str, str]], n: int = WINDOW) -> Benchmark:
    """The window tables of (item id, text) pairs."""
    data, off = text_buffer(pa.array([t for _, t in items], type=pa.large_string()))
    data, starts, ends, at, hashes = normalised(data, off)
    text, starts, ends = joined(data, starts, ends)
    ids = sorted({i for i, _ in items})
    number = {i: k for k, i in enumerate(ids)}
    owner = np.array([number[i] for i, _ in items], dtype=np.int64)
    counts = np.diff(at)
    tables = {}
    for length in sorted({min(n, int(c)) for c in counts if c}):
        places = [
            np.arange(at[k], at[k + 1] - length + 1)
            for k in np.flatnonzero(counts >= n if length == n else counts == length)
        ]
        place = np.concatenate(places)
        item = np.repeat(
            owner[np.flatnonzero(counts >= n if length == n else counts == length)], [len(p) for p in places]
        )
        grams = gram_hashes(hashes, length)[place]
        by: dict[tuple[int, bytes], tuple[int, set[int]]] = {}
        for h, p, i in zip(grams.tolist(), place.tolist(), item.tolist()):
            by.setdefault((h, text[starts[p] : ends[p + length - 1]].tobytes()), (p, set()))[1].add(i)
        entries = sorted(by.items(), key=lambda x: x[0])
        keys = np.array([k[0] for k, _ in entries], dtype=np.uint64)
        first = np.array([p for _, (p, _) in entries], dtype=np.int64)
        sieve = np.zeros(1 << _SIEVE_BITS, dtype=bool)
        sieve[keys >> np.uint64(64 - _SIEVE_BITS)] = True
        tables[length] = WindowTable(
            keys,
            starts[first],
            ends[first + length - 1],
            np.concatenate([[0], np.cumsum([len(s) for _, (_, s) in entries])]).astype(np.int64),
            np.array([i for _, (_, s) in entries for i in sorted(s)], dtype=np.int64),
            sieve,
        )
    return Benchmark(text, ids, tables)


def equal_spans(a: np.ndarray, a_start: np.ndarray, b: np.ndarray, b_start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether a[a_start:][:length] equals b[b_start:][:length], for many spans at once."""
    total = int(length.sum())
    if not total:
        return np.ones(len(length), dtype=bool)
    begin = np.cumsum(length) - length
    step = np.arange(total) - np.repeat(begin, length)
    same = a[np.repeat(a_start, length) + step] == b[np.repeat(b_start, length) + step]
    return np.logical_and.reduceat(same, begin)


@dataclass
class Hits:
    counts: np.ndarray  # words of each document
    hit: np.ndarray  # mask over all words
    at: np.ndarray  # document offsets in words
    starts: np.ndarray  # bytes of words in the slice
    ends: np.ndarray
    items: dict[int, set[int]]  # document -> items


def scan(data: np.ndarray, off: np.ndarray, bench: Benchmark) -> Hits:
    """All verified hits in a slice of documents."""
    data, starts, ends, at, hashes = normalised(data, off)
    n = len(hashes)
    cover = np.zeros(n + 1, dtype=np.int64)
    items: dict[int, set[int]] = {}
    doc = np.repeat(np.arange(len(off) - 1), np.diff(at))
    flat = None
    for length, windows in bench.tables.items():
        grams = gram_hashes(hashes, length)
        place, found = windows.find(grams)
        inside = doc[place] == doc[place + length - 1] if len(place) else np.zeros(0, dtype=bool)
        place, found = place[inside], found[inside]
        while len(place):
            flat = flat or joined(data, starts, ends)
            text, new_starts, new_ends = flat
            have, want = new_ends[place + length - 1] - new_starts[place], windows.ends[found] - windows.starts[found]
            good = have == want
            good[good] = equal_spans(text, new_starts[place[good]], bench.text, windows.starts[found[good]], have[good])
            np.add.at(cover, place[good], 1)
            np.add.at(cover, place[good] + length, -1)
            for d, w in np.unique(np.stack([doc[place[good]], found[good]], axis=1), axis=0).tolist():
                items.setdefault(d, set()).update(windows.items[windows.item_at[w] : windows.item_at[w + 1]].tolist())
            # another window with the same hash?
            more = ~good & (found + 1 < len(windows.keys))
            place, found = place[more], found[more] + 1
            again = windows.keys[found] == grams[place]
            place, found = place[again], found[again]
    return Hits(np.diff(at), np.cumsum(cover)[:n] > 0, at, starts, ends, items)


def cut(raw: bytes, hits: Hits, d: int, base: int) -> str:
    """The text without its maximal runs of hit words."""
    lo, hi = hits.at[d], hits.at[d + 1]
    mask = hits.hit[lo:hi]
    edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    out, at = [], 0
    for a, b in zip(edges[::2], edges[1::2]):
        out.append(raw[at : hits.starts[lo + a] - base])
        at = hits.ends[lo + b - 1] - base
    return b"".join([*out, raw[at:]]).decode("utf-8")


def blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[str, str]]]:
    """The items in lists of bounded size; reads one partition of the table at a time."""
    rows = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("string"), "text")
    held: list[tuple[str, str]] = []
    size = 0
    for item, text in rows.toLocalIterator():
        held.append((item, text))
        size += len(text.encode())
        if size >= block_bytes:
            yield held
            held, size = [], 0
    if held:
        yield held


def _mapper(shared, id_name: str, text_name: str, out: pa.Schema, mode: str, marks: str = ""):
    """mode: "report" gives counts and items, "keep" rows without a hit, "spans" all rows, cut;
    "mark" adds the hit words to those of column ``marks``, "marked" cuts the words it names."""

    def run(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bench = pickle.loads(shared.value)
        for batch in incoming:
            data, off = text_buffer(batch.column(text_name))
            for a, b in slices(off):
                base = int(off[a])
                hits = scan(data[base : off[b]], off[a : b + 1] - base, bench)
                total = np.concatenate([[0], np.cumsum(hits.hit)])
                n_hit = total[hits.at[1:]] - total[hits.at[:-1]]
                piece = batch.slice(a, b - a)
                if mode == "keep":
                    yield piece.filter(pa.array(n_hit == 0))
                elif mode == "mark":
                    known = piece.column(marks).to_pylist()
                    for d in np.flatnonzero(n_hit).tolist():
                        words = np.flatnonzero(hits.hit[hits.at[d] : hits.at[d + 1]]).tolist()
                        known[d] = sorted({*known[d], *words})
                    yield _with(piece, marks, known)
                elif mode in ("spans", "marked"):
                    texts = piece.column(text_name).to_pylist()
                    if mode == "marked":
                        for d, words in enumerate(piece.column(marks).to_pylist()):
                            hits.hit[hits.at[d] + np.array(words, dtype=np.int64)] = True
                            n_hit[d] = len(words)
                    for d in np.flatnonzero(n_hit).tolist():
                        raw = data[off[a + d] : off[a + d + 1]].tobytes()
                        texts[d] = cut(raw, hits, d, int(off[a + d]) - base)
                    yield _with(piece, text_name, texts)
                else:
                    yield _report(piece, hits, n_hit, bench, id_name, out, mode)

    return run


def _with(piece: pa.RecordBatch, name: str, values: list) -> pa.RecordBatch:
    columns = [pa.array(values, type=f.type) if f.name == name else piece.column(f.name) for f in piece.schema]
    return pa.RecordBatch.from_arrays(columns, schema=piece.schema)


def _report(piece, hits: Hits, n_hit, bench: Benchmark, id_name: str, out: pa.Schema, mode: str) -> pa.RecordBatch:
    names = [sorted(bench.ids[i] for i in hits.items.get(d, ())) for d in range(piece.num_rows)]
    columns = {
        "doc_id": piece.column(id_name),
        "n_words": pa.array(hits.counts, pa.int64()),
        "n_hit": pa.array(n_hit, pa.int64()),
    }
    if mode == "parts":
        where = [
            [int(x) for x in np.flatnonzero(hits.hit[hits.at[d] : hits.at[d + 1]])] for d in range(piece.num_rows)
        ]
        columns |= {
            "row_key": piece.column("row_key"),
            "hit_words": pa.array(where, pa.list_(pa.int64())),
            "items": pa.array(names, pa.list_(pa.string())),
        }
    else:
        digests = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in names]
        columns |= {
            "n_items": pa.array([len(x) for x in names], pa.int64()),
            "items_sha256": pa.array(digests, pa.string()),
            "contaminated": pa.array(n_hit > 0),
        }
    return pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) for f in out], schema=out)


def _run(docs: DataFrame, items, n: int, mode: str, schema: str, out: pa.Schema | None) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(cloudpickle.dumps(build(items, n)))
    return docs.mapInArrow(_mapper(shared, "doc_id", "text", out, mode), schema)


def contamination(
    documents: DataFrame, benchmark: DataFrame, n: int = WINDOW, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256 and contaminated."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
    out = pa.schema(
        [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64())]
        + [("items_sha256", pa.string()), ("contaminated", pa.bool_())]
    )
    parts = blocks(benchmark, block_bytes)
    first, second = next(parts, []), next(parts, None)
    if second is None:
        return _run(docs, first, n, "report", schema, out)
    keyed = docs.withColumn("row_key", F.sha2(F.coalesce("text", F.lit("")), 256))
    kinds = [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("row_key", pa.string())]
    kinds += [("hit_words", pa.list_(pa.int64())), ("items", pa.list_(pa.string()))]
    part_schema = "doc_id long, n_words long, n_hit long, row_key string, hit_words array<long>, items array<string>"

    def one(items):
        return _run(keyed, items, n, "parts", part_schema, pa.schema(kinds)).where("n_hit > 0").drop("n_hit", "n_words")

    hits = None
    for items in [first, second]:
        hits = one(items) if hits is None else hits.unionByName(one(items))
    for items in parts:
        hits = staged(hits, "hits").unionByName(one(items))
    # equal (doc_id, text) rows have equal hits: one line of hits for all of them
    hits = hits.groupBy("doc_id", "row_key").agg(
        F.array_distinct(F.flatten(F.collect_list("hit_words"))).alias("hit_words"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    all_rows = _run(keyed, [], n, "parts", part_schema, pa.schema(kinds)).select("doc_id", "row_key", "n_words")
    both = all_rows.alias("d").join(
        hits.alias("h"),
        F.col("d.doc_id").eqNullSafe(F.col("h.doc_id")) & (F.col("d.row_key") == F.col("h.row_key")),
        "left",
    )
    items = F.coalesce("items", F.array().cast("array<string>"))
    return both.select(
        F.col("d.doc_id"),
        "n_words",
        F.coalesce(F.size("hit_words"), F.lit(0)).cast("long").alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        F.col("hit_words").isNotNull().alias("contaminated"),
    )


def _scanned(documents: DataFrame, items, n: int, mode: str, marks: str = "") -> DataFrame:
    shared = documents.sparkSession.sparkContext.broadcast(cloudpickle.dumps(build(items, n)))
    return documents.mapInArrow(_mapper(shared, "doc_id", "text", None, mode, marks), documents.schema)


def remove_documents(
    documents: DataFrame, benchmark: DataFrame, n: int = WINDOW, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """The documents without any hit, with all their columns.

    With a benchmark of several blocks, what a block leaves is written before the next one scans it.
    """
    parts = blocks(benchmark, block_bytes)
    out = _scanned(documents, next(parts, []), n, "keep")
    for items in parts:
        out = _scanned(staged(out, "kept"), items, n, "keep")
    return out


def remove_spans(
    documents: DataFrame, benchmark: DataFrame, n: int = WINDOW, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """All documents with their columns; every maximal run of hit words is cut out of ``text``.

    With a benchmark of several blocks each of them scans the whole texts and
    notes its hits beside them; they are cut out together at the end, so the
    result does not depend on how the benchmark is divided.
    """
    parts = blocks(benchmark, block_bytes)
    first, second = next(parts, []), next(parts, None)
    if second is None:
        return _scanned(documents, first, n, "spans")
    (marks,) = fresh(documents, "hit_words")
    marked = documents.withColumn(marks, F.array().cast("array<bigint>"))
    marked = staged(_scanned(marked, first, n, "mark", marks), "marks")
    marked = staged(_scanned(marked, second, n, "mark", marks), "marks")
    for items in parts:
        marked = staged(_scanned(marked, items, n, "mark", marks), "marks")
    return _scanned(marked, [], n, "marked", marks).drop(marks)


__all__ = ["build", "contamination", "remove_documents", "remove_spans", "scan"]
