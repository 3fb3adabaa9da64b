"""Substring deduplication with suffix automata of reference shards.

A suffix automaton of reference text gives, while a document streams through
it, the length of the longest match that ends at each word (its matching
statistics); spans above the threshold go.

``remove_reference_spans`` takes a reference of its own: it is cut into shards
of at most ``SHARD_WORDS`` words, each is broadcast, and every document is
streamed through it.

``remove_repeats`` takes the corpus itself as the reference: a word goes if a
window of ``window`` words that covers it also starts earlier. Such a reference
has no bound on its size, so its shards are not broadcast but sent by shuffle:
the windows of the corpus meet by their anchors (see ``anchors``), and for each
anchor with different contexts the contexts are streamed, in the order of their
places, through the automaton of those before them.

Words are ``[^\\x20\\x09-\\x0D]+``, unchanged. Defined results: NULL and empty
texts have no words. A NULL doc_id counts as the smallest. Rows with the same
doc_id are one place: a window that starts there is earlier for none of them.
Extra columns are ignored, or kept where a function says so.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Hashable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.anchors import Tokens, Unit, applied, kept_windows, keyed
from cohortlens.llm.tokens import joined

# the functions below travel with the task, so executors need not have the package
register_pickle_by_value(sys.modules[__name__])

WINDOW = 20
ANCHOR = 10
SHARD_WORDS = 200_000


class SuffixAutomaton:
    """All substrings of the sequences added so far."""

    def __init__(self) -> None:
        self.next: list[dict[Hashable, int]] = [{}]
        self.link = [-1]
        self.length = [0]

    def _state(self, length: int, link: int, following: dict[Hashable, int]) -> int:
        self.next.append(following)
        self.length.append(length)
        self.link.append(link)
        return len(self.length) - 1

    def _split(self, p: int, token: Hashable, q: int) -> int:
        """The state of the longest suffix that p and token make, apart from longer ones that share q."""
        if self.length[p] + 1 == self.length[q]:
            return q
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(token) == q:
            self.next[p][token] = clone
            p = self.link[p]
        return clone

    def add(self, tokens: Sequence[Hashable]) -> None:
        last = 0
        for token in tokens:
            known = self.next[last].get(token)
            if known is not None:
                last = self._split(last, token, known)
                continue
            new = self._state(self.length[last] + 1, 0, {})
            p = last
            while p >= 0 and token not in self.next[p]:
                self.next[p][token] = new
                p = self.link[p]
            if p >= 0:
                self.link[new] = self._split(p, token, self.next[p][token])
            last = new

    def matching(self, tokens: Sequence[Hashable]) -> list[int]:
        """For each token the length of the longest known sequence that ends with it."""
        state, size, out = 0, 0, []
        for token in tokens:
            while state and token not in self.next[state]:
                state = self.link[state]
                size = self.length[state]
            known = self.next[state].get(token)
            if known is None:
                state, size = 0, 0
            else:
                state, size = known, size + 1
            out.append(size)
        return out


def _masks(contexts: list[tuple[bytes, int]], window: int) -> list[bytes]:
    """For contexts of one anchor in the order of their places: which windows none before it has."""
    automaton, out = SuffixAutomaton(), []
    for k, (text, count) in enumerate(contexts):
        tokens = text.split()
        if k:
            sizes = automaton.matching(tokens)
            out.append(bytes(0 if sizes[i + window - 1] >= window else 1 for i in range(count)))
        else:
            out.append(b"\x01" * count)
        if k + 1 < len(contexts):
            automaton.add(tokens)
    return out


def resolve(contexts: DataFrame, unit: Unit) -> DataFrame:
    """One shard per anchor: what of each context is new."""
    schema = pa.schema([("doc", pa.int64()), ("pos", pa.int32()), ("mask", pa.binary())])

    def made(held: list[tuple[int, int, bytes, int]]) -> list[tuple[int, int, bytes]]:
        masks = _masks([(t, c) for _, _, t, c in held], unit.window)
        return [(d, p, m) for (d, p, _, _), m in zip(held, masks)]

    def run(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, out = None, [], []
        for batch in incoming:
            columns = [batch.column(c).to_pylist() for c in ("key", "doc", "pos", "tokens", "count")]
            for k, doc, pos, text, count in zip(*columns):
                if k != key:
                    out += made(held)
                    key, held = k, []
                held.append((doc, pos, text, count))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
                out = []
        out = made(held)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    together = contexts.select("key", "doc", "pos", "tokens", "count").repartition("key")
    return together.sortWithinPartitions("key", "doc", "pos").mapInArrow(run, "doc long, pos int, mask binary")


def _kept(data: np.ndarray, t: Tokens, removed: np.ndarray) -> Iterator[bytes]:
    """The kept words of each document joined by one space."""
    stay = ~removed
    text, starts, _ = joined(data, t.starts[stay], t.ends[stay])
    at = np.concatenate([[0], np.cumsum(stay)])[t.at]
    edges = np.append(starts, len(text))[at].tolist()
    raw = text.tobytes()
    for x, y in zip(edges, edges[1:]):
        yield raw[x : max(x, y - 1)]


def _counts(t: Tokens, removed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    total = np.concatenate([[0], np.cumsum(removed)])
    return np.diff(t.at), total[t.at[1:]] - total[t.at[:-1]]


def repeats(documents: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, with_text: bool = False) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed and the SHA-256 of the kept words; ``with_text`` adds them."""
    unit = Unit(window, anchor, words=True)
    docs = keyed(documents)
    fields = [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())]
    ddl = "doc_id long, n_words long, n_removed long, kept_sha256 string"
    if with_text:
        fields, ddl = [*fields, ("kept_text", pa.string())], f"{ddl}, kept_text string"
    schema = pa.schema(fields)

    def make(piece: pa.RecordBatch, data: np.ndarray, t: Tokens, removed: np.ndarray) -> pa.RecordBatch:
        n, gone = _counts(t, removed)
        kept = list(_kept(data, t, removed))
        columns = [piece.column("doc_id"), pa.array(n.astype(np.int64)), pa.array(gone.astype(np.int64))]
        columns.append(pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string()))
        if with_text:
            columns.append(pa.array([x.decode() for x in kept], pa.string()))
        return pa.RecordBatch.from_arrays(columns, schema=schema)

    return applied(docs, kept_windows(docs, unit, resolve, True), unit, make, ddl)


def remove_repeats(documents: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """doc_id and the text of kept words, joined by one space."""
    return repeats(documents, window, anchor, True).select("doc_id", F.col("kept_text").alias("text"))


def shards(reference: DataFrame, shard_words: int) -> Iterator[list[list[str]]]:
    """The reference's texts as lists of words, in shards of bounded size."""
    held: list[list[str]] = []
    size = 0
    for (text,) in reference.where("text IS NOT NULL").select(F.col("text").cast("string")).toLocalIterator():
        tokens = text.encode().split()
        for at in range(0, len(tokens), shard_words):
            # a long text goes on in the next shard with as much of it as a match needs
            held.append(tokens[max(0, at - 1000) : at + shard_words])
            size += len(held[-1])
            if size >= shard_words:
                yield held
                held, size = [], 0
    if held:
        yield held


def remove_reference_spans(
    documents: DataFrame, reference: DataFrame, min_words: int = WINDOW, shard_words: int = SHARD_WORDS
) -> DataFrame:
    """``documents`` with words cut out that lie in a match of ``min_words`` (at most 1,000) words or more with ``reference``.

    Documents with a match get their kept words joined by one space; others and all columns stay as they are.
    """
    if not 0 < min_words <= 1000:
        raise ValueError("min_words must be from 1 to 1000")
    out = documents
    marks = []
    for shard in shards(reference, shard_words):
        marks.append(documents.sparkSession.sparkContext.broadcast(shard))
    if not marks:
        return out

    def cut(tokens: list[bytes], automata: list[SuffixAutomaton]) -> list[bytes] | None:
        gone = np.zeros(len(tokens) + 1, dtype=np.int64)
        for automaton in automata:
            for end, size in enumerate(automaton.matching(tokens)):
                if size >= min_words:
                    gone[end - size + 1] += 1
                    gone[end + 1] -= 1
        removed = np.cumsum(gone)[:-1] > 0
        return [w for w, r in zip(tokens, removed) if not r] if removed.any() else None

    def run(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata = []
        for mark in marks:
            automaton = SuffixAutomaton()
            for tokens in mark.value:
                automaton.add(tokens)
            automata.append(automaton)
        for batch in incoming:
            texts = batch.column("text").to_pylist()
            for i, text in enumerate(texts):
                kept = cut(text.encode().split(), automata) if text else None
                if kept is not None:
                    texts[i] = b" ".join(kept).decode()
            columns = [pa.array(texts, f.type) if f.name == "text" else batch.column(f.name) for f in batch.schema]
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return out.mapInArrow(run, out.schema)
