"""Repeated windows of a corpus through content-defined anchors.

A window is W consecutive tokens of one document (words, or bytes). Its anchor
is the run of G tokens inside it with the smallest hash, the leftmost of equal
ones. Which run that is depends on the content of the window alone, so equal
windows have equal anchors at equal offsets, wherever they stand. Neighbouring
windows mostly share an anchor; such a run of windows is one row: hash of the
anchor, hash of the context (all tokens of these windows), and its place.

Rows are combined by (anchor, context), then contexts are counted by anchor:

* an anchor with one context says all: its windows occur as often as the context;
* the contexts of an anchor with several of them are fetched and resolved
  together (``resolve``, which is where the two operators differ);
* an anchor with more than ``GROUP`` contexts (a passage that very many
  documents quote) is resolved window by window with grouped aggregates, which
  have no group that must fit anywhere.

Every shuffle but the fetch of contexts is a grouped aggregate with map-side
combining, so copies and quotes are combined before they move. Windows that are
to stay go back to their document as (first window, which of the run).

Hashes of 64 bits of anchor and context, 128 together, stand for equality.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import staged
from cohortlens.llm.tokens import NOT_SPACE, U64, byte_codes, prefix_sums, slices, sliding_argmin, span_hash, text_buffer, word_hashes, words

# the functions below travel with the task, so executors need not have the package
register_pickle_by_value(sys.modules[__name__])

FIRST_ID = -(1 << 63)
GROUP = 4096
_POS_BITS = 31


@dataclass(frozen=True)
class Unit:
    """What a token is, how many make a window and an anchor."""

    window: int
    gram: int
    words: bool


@dataclass
class Tokens:
    """The tokens of a slice: byte edges, offsets of documents, and the prefix sums of their hash."""

    starts: np.ndarray
    ends: np.ndarray
    at: np.ndarray
    prefix: np.ndarray


@dataclass
class Runs:
    """Runs of windows with one anchor; positions count tokens of the slice."""

    doc: np.ndarray
    start: np.ndarray  # first window
    count: np.ndarray  # windows
    anchor: np.ndarray  # first token of the anchor
    key: np.ndarray
    context: np.ndarray


def tokens(data: np.ndarray, off: np.ndarray, unit: Unit) -> Tokens:
    if not unit.words:
        place = np.arange(len(data) + 1)
        return Tokens(place[:-1], place[1:], off, prefix_sums(byte_codes(data)))
    starts, ends, at = words(data, off, NOT_SPACE)
    return Tokens(starts, ends, at, prefix_sums(word_hashes(data, starts, ends)))


def runs(t: Tokens, unit: Unit) -> Runs:
    n, w, g = len(t.starts), unit.window, unit.gram
    if n < w:
        none = np.zeros(0, dtype=np.int64)
        return Runs(none, none, none, none, none.astype(U64), none.astype(U64))
    place = np.arange(n - g + 1)
    grams = span_hash(t.prefix, place, place + g)
    anchor = sliding_argmin(grams, w - g + 1)
    start = np.arange(n - w + 1)
    doc = np.searchsorted(t.at, start, side="right") - 1
    inside = start + w <= t.at[doc + 1]
    start, anchor, doc = start[inside], anchor[inside], doc[inside]
    if not len(start):
        return Runs(doc, start, start, anchor, grams[:0], grams[:0])
    new = np.ones(len(start), dtype=bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(start)))
    s, p = start[first], anchor[first]
    context = span_hash(t.prefix, s, s + count - 1 + w) ^ (p - s).astype(U64) * U64(0x9FB21C651E98DF25)
    return Runs(doc[first], s, count, p, grams[p], context)


def sliced(batch: pa.RecordBatch, unit: Unit) -> Iterator[tuple[int, int, np.ndarray, Tokens, Runs]]:
    data, off = text_buffer(batch.column("text"))
    for a, b in slices(off):
        piece = data[off[a] : off[b]]
        t = tokens(piece, off[a : b + 1] - off[a], unit)
        yield a, b, piece, t, runs(t, unit)


def keyed(documents: DataFrame) -> DataFrame:
    """``doc`` (doc_id, the smallest number for NULL), ``doc_id`` and ``text``."""
    doc_id = F.col("doc_id").cast("long")
    return documents.select(
        F.coalesce(doc_id, F.lit(FIRST_ID).cast("long")).alias("doc"),
        doc_id.alias("doc_id"),
        F.col("text").cast("string").alias("text"),
    )


class Places:
    """(doc, position) as one number that orders them: a long where the ids allow it, else a decimal."""

    def __init__(self, docs: DataFrame) -> None:
        low, high = docs.agg(F.min("doc"), F.max("doc")).first()
        self.base = low or 0
        self.narrow = (high or 0) - self.base < 1 << 32
        self.kind = "long" if self.narrow else "decimal(38,0)"

    def pack(self, doc: Column, pos: Column) -> Column:
        if self.narrow:
            return F.shiftleft(doc - F.lit(self.base), _POS_BITS).bitwiseOR(pos.cast("long")).bitwiseXOR(F.lit(FIRST_ID))
        return (doc.cast("decimal(20,0)") * F.lit(1 << _POS_BITS).cast("decimal(10,0)") + pos).cast("decimal(38,0)")

    def pos(self, place: Column) -> Column:
        if self.narrow:
            return place.bitwiseXOR(F.lit(FIRST_ID)).bitwiseAND(F.lit((1 << _POS_BITS) - 1)).cast("int")
        return F.pmod(place, F.lit(1 << _POS_BITS).cast("decimal(38,0)")).cast("int")

    def doc(self, place: Column) -> Column:
        if self.narrow:
            return F.shiftrightunsigned(place.bitwiseXOR(F.lit(FIRST_ID)), _POS_BITS) + F.lit(self.base)
        whole = (place - self.pos(place).cast("decimal(38,0)")).cast("decimal(38,0)")
        return (whole / F.lit(1 << _POS_BITS).cast("decimal(10,0)")).cast("decimal(20,0)").cast("long")


def _rows(docs: DataFrame, unit: Unit) -> DataFrame:
    schema = pa.schema([("key", pa.int64()), ("context", pa.int64()), ("doc", pa.int64()), ("pos", pa.int32())])

    def run(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in incoming:
            ids = batch.column("doc").to_numpy()
            for a, b, _, t, r in sliced(batch, unit):
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(r.key.view(np.int64)),
                        pa.array(r.context.view(np.int64)),
                        pa.array(ids[a:b][r.doc]),
                        pa.array((r.start - t.at[r.doc]).astype(np.int32)),
                    ],
                    schema=schema,
                )

    return docs.select("doc", "text").mapInArrow(run, "key long, context long, doc long, pos int")


def _fetched(docs: DataFrame, wanted: DataFrame, unit: Unit, single: bool) -> DataFrame:
    """The contexts that ``wanted`` (doc, list of pos, key, n) names; with ``single`` their windows one by one."""
    if single:
        fields = [("w1", pa.int64()), ("w2", pa.int64()), ("doc", pa.int64()), ("pos", pa.int32()), ("bit", pa.int32()), ("n", pa.int64())]
        ddl = "w1 long, w2 long, doc long, pos int, bit int, n long"
    else:
        fields = [("key", pa.int64()), ("doc", pa.int64()), ("pos", pa.int32()), ("anchor", pa.int32()), ("count", pa.int32()), ("n", pa.int64()), ("tokens", pa.binary())]
        ddl = "key long, doc long, pos int, anchor int, count int, n long, tokens binary"
    schema = pa.schema(fields)

    def run(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in incoming:
            ids, lists = batch.column("doc").to_numpy(), batch.column("wanted")
            edge = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            flat = lists.flatten()
            pos, n = flat.field("pos").to_numpy(), flat.field("n").to_numpy()
            for a, b, data, t, r in sliced(batch, unit):
                owner = np.repeat(np.arange(b - a), np.diff(edge[a : b + 1]))
                want = t.at[owner] + pos[edge[a] : edge[b]]
                times = n[edge[a] : edge[b]]
                hit = np.searchsorted(r.start, want)
                hit[hit == len(r.start)] = 0
                # rows that share a doc_id are offered each other's places
                good = (r.start[hit] == want) & (r.doc[hit] == owner) if len(r.start) else np.zeros(len(want), bool)
                hit, times = hit[good], times[good]
                s, c, d = r.start[hit], r.count[hit], r.doc[hit]
                base = [pa.array(ids[a:b][d]), pa.array((s - t.at[d]).astype(np.int32))]
                if single:
                    i = np.repeat(np.arange(len(hit)), c)
                    bit = np.arange(len(i)) - np.repeat(np.cumsum(c) - c, c)
                    x = s[i] + bit
                    w1 = span_hash(t.prefix, x, x + unit.window)
                    w2 = r.key[hit][i] ^ (r.anchor[hit][i] - x).astype(U64) * U64(0x9FB21C651E98DF25)
                    columns = [pa.array(w1.view(np.int64)), pa.array(w2.view(np.int64)), base[0].take(pa.array(i)), base[1].take(pa.array(i))]
                    columns += [pa.array(bit.astype(np.int32)), pa.array(times[i])]
                else:
                    raw = data.tobytes()
                    first, last = t.starts[s], t.ends[s + c - 1 + unit.window - 1]
                    texts = [raw[x:y] for x, y in zip(first.tolist(), last.tolist())]
                    columns = [pa.array(r.key[hit].view(np.int64)), *base, pa.array((r.anchor[hit] - s).astype(np.int32))]
                    columns += [pa.array(c.astype(np.int32)), pa.array(times), pa.array(texts, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    lists = wanted.groupBy("doc").agg(F.collect_list(F.struct("pos", "n")).alias("wanted"))
    return docs.select("doc", "text").join(lists, "doc").select("doc", "text", "wanted").mapInArrow(run, ddl)


#: (contexts, unit) -> (doc, pos, mask); the mask has one byte per window of the run, odd ("1" too) to keep it
Resolve = Callable[[DataFrame, Unit], DataFrame]


def kept_windows(docs: DataFrame, unit: Unit, resolve: Resolve, first_stays: bool, group: int = GROUP) -> DataFrame:
    """What stays, by document: (doc, whole: list of pos, parts: list of (pos, mask)).

    ``first_stays``: the first occurrence of a window stays; else no window that occurs twice does.
    """
    places = Places(docs)
    doc_of, pos_of = places.doc(F.col("place")), places.pos(F.col("place"))
    rows = _rows(docs, unit).select("key", "context", places.pack(F.col("doc"), F.col("pos")).alias("place"))
    contexts = rows.groupBy("key", "context").agg(F.min("place").alias("place"), F.count(F.lit(1)).alias("n"))
    # all columns of contexts are used on both sides, so that one scan and shuffle serves both
    several = contexts.groupBy("key").agg(
        F.count(F.lit(1)).alias("contexts"), F.max("n").alias("most"), F.min("place").alias("least")
    )
    several = several.where("contexts > 1 AND most > 0 AND least IS NOT NULL").select("key", "contexts")
    found = contexts.join(several, "key", "left").select("place", "n", "contexts")
    if not first_stays:
        found = found.where("contexts IS NOT NULL OR n = 1")
    found = staged(found, "contexts")
    whole = found.where("contexts IS NULL").select(doc_of.alias("doc"), pos_of.alias("pos"))
    shared = found.where(F.col("contexts") <= group).select(doc_of.alias("doc"), pos_of.alias("pos"), "n")
    parts = resolve(staged(_fetched(docs, shared, unit, False), "context-texts"), unit)
    crowded = found.where(F.col("contexts") > group)
    if not crowded.isEmpty():
        crowd = crowded.select(doc_of.alias("doc"), pos_of.alias("pos"), "n")
        parts = parts.unionByName(_window_by_window(_fetched(docs, crowd, unit, True), places, first_stays))
    stays = whole.select("doc", "pos", F.lit(None).cast("binary").alias("mask")).unionByName(staged(parts, "masks"))
    return stays.groupBy("doc").agg(
        F.collect_list(F.when(F.col("mask").isNull(), F.col("pos"))).alias("whole"),
        F.collect_list(F.when(F.col("mask").isNotNull(), F.struct("pos", "mask"))).alias("parts"),
    )


def _window_by_window(windows: DataFrame, places: Places, first_stays: bool) -> DataFrame:
    """Masks of crowded contexts: each window is combined over all of them."""
    # the bit is part of the place, since several windows of a run may stay
    packed = F.struct("place", "bit")
    rows = windows.select("w1", "w2", "n", "bit", places.pack(F.col("doc"), F.col("pos")).alias("place"))
    one = rows.groupBy("w1", "w2").agg(F.min(packed).alias("first"), F.sum("n").alias("n"))
    if not first_stays:
        one = one.where("n = 1")
    stay = one.groupBy(F.col("first.place").alias("place")).agg(F.collect_set("first.bit").alias("bits"))
    flags = F.transform(
        F.sequence(F.lit(0), F.array_max("bits")),
        lambda b: F.when(F.array_contains("bits", b), F.lit("1")).otherwise(F.lit("0")),
    )
    mask = F.array_join(flags, "").cast("binary")
    return stay.select(places.doc(F.col("place")).alias("doc"), places.pos(F.col("place")).alias("pos"), mask.alias("mask"))


def removed_tokens(t: Tokens, r: Runs, unit: Unit, whole: list[np.ndarray], parts: list[list[tuple[int, bytes]]]) -> np.ndarray:
    """Which tokens of a slice are covered by a window that does not stay."""
    n = len(t.starts)
    gone = np.zeros(n + 1, dtype=np.int64)
    if len(r.start):
        wanted = [t.at[d] + w for d, w in enumerate(whole) if len(w)]
        wanted = np.concatenate(wanted) if wanted else np.zeros(0, np.int64)
        open_ = np.flatnonzero(~np.isin(r.start, wanted))
        masks = {int(t.at[d]) + pos: mask for d, some in enumerate(parts) for pos, mask in some}
        for i in open_.tolist() if masks else ():
            mask = masks.get(int(r.start[i]))
            if mask is not None:
                keep = np.zeros(int(r.count[i]), dtype=bool)
                keep[: len(mask)] = (np.frombuffer(mask, dtype=np.uint8)[: len(keep)] & 1) == 1
                x = r.start[i] + np.flatnonzero(~keep)
                np.add.at(gone, x, 1)
                np.add.at(gone, x + unit.window, -1)
        fully = np.array([i for i in open_.tolist() if int(r.start[i]) not in masks], dtype=np.int64) if masks else open_
        np.add.at(gone, r.start[fully], 1)
        np.add.at(gone, r.start[fully] + r.count[fully] - 1 + unit.window, -1)
    return np.cumsum(gone)[:n] > 0


def applied(docs: DataFrame, stays: DataFrame, unit: Unit, make: Callable[..., pa.RecordBatch], ddl: str) -> DataFrame:
    """``make(batch, a, b, data, tokens, removed)`` for every slice of documents."""

    def run(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in incoming:
            whole, parts = batch.column("whole"), batch.column("parts")
            for a, b, data, t, r in sliced(batch, unit):
                lists = [np.asarray(whole[i].values or [], dtype=np.int64) for i in range(a, b)]
                some = [[(x["pos"], x["mask"]) for x in parts[i].as_py() or ()] for i in range(a, b)]
                yield make(batch.slice(a, b - a), data, t, removed_tokens(t, r, unit, lists, some))

    joined = docs.join(stays, "doc", "left").select("doc_id", "text", "whole", "parts")
    return joined.mapInArrow(run, ddl)
