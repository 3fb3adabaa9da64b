"""Toxicity: a weighted lexicon matched by Aho-Corasick on folded text.

Folding maps every character to one of a-z, a digit or a blank: case, accents and
styled letters go by their Unicode decomposition, homoglyphs of other scripts and
the digits and signs that stand in for letters by the tables below, and i, l, 1, !
and | all become i. Zero-width characters are removed first. Blanks part words.

The lexicon is learned from labelled documents: words, and beginnings of words,
that toxic documents hold and others do not, each weighted by the logarithm of how
much more often. Of a beginning and its continuations those are kept that cover its
documents with the fewest assumptions: the continuation where (nearly) all its
documents share it, else the beginning itself. Phrases of a lexicon word and its
neighbour that occur in clean documents and hardly in toxic ones are exceptions:
together with the ``exceptions`` given, they go into the same automaton and shield
the words they cover.

The score is a logistic function of the sum of weights of the unshielded matches,
divided by 1 + ln(1 + words). All of it is fitted on at most ``sample_rows`` labelled
documents of each class (those with the smallest hash of doc_id, so reruns agree);
every document is scored, over its whole text, in Arrow batches. One automaton of
at most ``LEXICON`` words and as many exceptions is broadcast.

Labels, language, source and doc_id are never inputs of a score. Defined results:
NULL and empty texts have no words and get the score of no match; documents with a
NULL doc_id are scored and never learned from; doc_ids with contradicting labels are
not learned from; of several texts with one doc_id that with the smallest hash
counts; without documents of both classes the score is the share of label 1 (0.5
without labels). Extra columns are carried along by ``classify``.
"""

from __future__ import annotations

import pickle
import sys
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from math import log

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.llm.common import staged

# the functions below travel with the task, so executors need not have the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SAMPLE_ROWS = 6_000
LEXICON = 4_096
#: Lengths of word beginnings that are looked at.
SHORTEST, LONGEST = 3, 12
#: A lexicon word is in at least so many toxic documents.
LEAST_DOCS = 3
#: Log-likelihood ratio of its counts: how far beyond chance, seen that many words are looked at.
EVIDENCE = 20.0
#: Natural logarithm of how much more often toxic documents hold a lexicon word; the most that counts;
#: by how much a longer word must outweigh its beginning to be one of its own.
LEAST_WEIGHT, MOST_WEIGHT, MORE_WEIGHT = 2.0, 8.0, 0.5
#: A continuation that this share of a beginning's documents hold replaces it.
SHARED = 0.9
THRESHOLD = 0.7

# Letters of other scripts, by the letter they look like.
HOMOGLYPHS = {
    "a": "аαɑ",
    "b": "вьβ",
    "c": "сϲ",
    "d": "ԁ",
    "e": "еєεҽ",
    "g": "ɡց",
    "h": "һн",
    "i": "іıιӏł",
    "j": "јϳ",
    "k": "кκ",
    "m": "мϻ",
    "n": "ոηп",
    "o": "оοօø",
    "p": "рρ",
    "q": "ԛ",
    "r": "гɾ",
    "s": "ѕʂ",
    "t": "тτ",
    "u": "υսц",
    "v": "ѵν",
    "w": "ԝωшѡ",
    "x": "хχ",
    "y": "уγүʏ",
    "z": "ʐ",
}
# Digits and signs that stand in for letters.
STAND_INS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "i", "€": "e", "l": "i"}
# Characters without width.
INVISIBLE = "\u00ad\u200b\u200c\u200d\u2060\ufe0f\ufeff"
#: Phrases in which a lexicon word is harmless, whatever the labels say.
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "recycle trash", "circus clown", "clown fish", "sore loser rule")


class Fold(dict):
    """Translation table from characters to their folded form, filled as they occur."""

    def __missing__(self, code: int) -> str:
        found = _folded(chr(code))
        self[code] = found
        return found


_LOOKS = {c: letter for letter, several in HOMOGLYPHS.items() for c in several}


def _folded(c: str) -> str:
    low = c.lower()
    for form in (c, low, unicodedata.normalize("NFKD", low)[:1]):
        form = _LOOKS.get(form, form)
        if form in STAND_INS:
            return STAND_INS[form]
        if form in "0123456789abcdefghijklmnopqrstuvwxyz" and form:
            return form
    # letters of other scripts stay as they are, everything else parts words
    return low if len(low) == 1 and low.isalnum() else " "


_FOLD = Fold()
_GONE = dict.fromkeys(map(ord, INVISIBLE))


def _visible(text: str) -> str:
    # signs that stand in for letters part words at their ends: "Stop!" is no "stopi"
    return text if text.isascii() else unicodedata.normalize("NFC", text.translate(_GONE))


def folded(text: str | None) -> str:
    """The folded text between two blanks; words are parted by one blank."""
    out = []
    for token in _visible(text or "").split():
        start, end = 0, len(token)
        # punctuation around a word is none of its letters; a digit may be
        while start < end and not (token[start].isalnum() or token[start] in "@$"):
            start += 1
        while end > start and not (token[end - 1].isalnum() or token[end - 1] in "@$"):
            end -= 1
        word = token[start:end]
        # numbers are no words
        if any(c.isalpha() for c in word):
            out.append(word.translate(_FOLD))
    return " " + " ".join(" ".join(out).split()) + " "


def beginnings(words: Iterable[str]) -> Iterator[str]:
    """Beginnings of folded words after a blank; whole words also end in one."""
    for w in words:
        for n in range(SHORTEST, min(len(w), LONGEST) + 1):
            yield f" {w[:n]}"
        if len(w) >= SHORTEST:
            yield f" {w} "


@dataclass
class Lexicon:
    """Folded words (" word ") and word beginnings (" beg") with weights, exception phrases, and the score's two numbers."""

    weights: dict[str, float] = field(default_factory=dict)
    exceptions: tuple[str, ...] = ()
    coefficients: tuple[float, ...] = (0.0, 0.0, 0.0)

    def automaton(self) -> ahocorasick.Automaton | None:
        if not self.weights:
            return None
        words = ahocorasick.Automaton()
        for word, weight in self.weights.items():
            words.add_word(word, (len(word), weight))
        for phrase in self.exceptions:
            if phrase not in self.weights:
                words.add_word(phrase, (len(phrase), None))
        words.make_automaton()
        return words

    def scores(self, total: np.ndarray, words: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(measures(total, words) @ np.array(self.coefficients), -30, 30)))


def matches(words: ahocorasick.Automaton, text: str) -> list[tuple[int, int, float]]:
    """(start, end, weight) of the unshielded matches in a folded text; of those that start together the heaviest."""
    found: dict[int, tuple[int, float]] = {}
    shields: list[tuple[int, int]] = []
    for last, (n, weight) in words.iter(text):
        start = last - n + 1
        if weight is None:
            shields.append((start, last + 1))
        elif start not in found or weight > found[start][1]:
            found[start] = (last + 1, weight)
    if shields:
        # a shield ends with the blank that a word may start with
        found = {s: e for s, e in found.items() if not any(a <= s and s < b - 1 and min(e[0], s + 2) <= b for a, b in shields)}
    return [(s, e, w) for s, (e, w) in sorted(found.items())]


def weighed(words: ahocorasick.Automaton | None, text: str | None) -> tuple[float, int]:
    """Weight of the unshielded matches and number of words of a whole text."""
    low = folded(text)
    total = sum(w for _, _, w in matches(words, low)) if words is not None else 0.0
    return total, low.count(" ") - 1 if low.strip() else 0


# learning


def evidence(t: int, c: int, toxic: int, clean: int) -> float:
    """Log-likelihood ratio of t of ``toxic`` and c of ``clean`` documents against equal shares."""

    def fit(n: int, of: int, share: float) -> float:
        return (n * log(share) if n else 0.0) + ((of - n) * log(1 - share) if of > n else 0.0)

    both = (t + c) / (toxic + clean)
    return 2 * (fit(t, toxic, t / toxic) + fit(c, clean, c / clean) - fit(t, toxic, both) - fit(c, clean, both))


def chosen_words(counts: dict[str, tuple[int, int]], toxic: int, clean: int) -> dict[str, float]:
    """Lexicon words and weights from (toxic, clean) document counts of all beginnings and words."""

    def weight_of(t: int, c: int) -> float:
        return min(MOST_WEIGHT, log((t + 0.5) / (toxic + 1)) - log((c + 0.5) / (clean + 1)))

    def certain(t: int, c: int) -> bool:
        return t >= LEAST_DOCS and weight_of(t, c) >= LEAST_WEIGHT and evidence(t, c, toxic, clean) >= EVIDENCE

    weight = {w: weight_of(t, c) for w, (t, c) in counts.items()}
    sure = {w for w, (t, c) in counts.items() if certain(t, c)}
    after: dict[str, list[str]] = {}
    for w in counts:
        after.setdefault(w[:-1], []).append(w)

    def settled(w: str) -> list[str]:
        """``w``, or the few continuations that stand for it."""
        more = sorted((v for v in after.get(w, ()) if v in sure), key=lambda v: (-counts[v][0], v))[:3]
        if more and sum(counts[v][0] for v in more) >= SHARED * counts[w][0]:
            return [x for v in more for x in settled(v)]
        return [w]

    out: dict[str, float] = {}
    # what is left of a beginning's documents when those of its heavier words are taken off
    left = dict(counts)
    for w in sorted(sure, key=lambda w: (-weight[w], len(w), w)):
        if not certain(*left[w]):
            continue
        for v in settled(w):
            spoken = max((out[v[:n]] for n in range(SHORTEST + 1, len(v)) if v[:n] in out), default=0.0)
            if v not in out and weight[v] > spoken + (MORE_WEIGHT if spoken else 0.0):
                out[v] = weight[v]
                for n in range(SHORTEST + 1, len(v)):
                    if v[:n] in left:
                        left[v[:n]] = tuple(max(0, a - b) for a, b in zip(left[v[:n]], counts[v]))
    best = sorted(out, key=lambda w: (-out[w] * counts[w][0] ** 0.5, w))[:LEXICON]
    return {w: out[w] for w in sorted(best)}


def measures(total: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The sum of weights against the length of the text, in two ways: slowly falling with it, and for each word."""
    return np.stack([np.ones(len(total)), total / (1 + np.log1p(words)), np.log1p(100 * total / (words + 10))], axis=1)


def calibrated(design: np.ndarray, y: np.ndarray, importance: np.ndarray, steps: int = 50) -> np.ndarray:
    """Coefficients of a logistic fit with a little shrinkage, by Newton's method."""
    w = np.zeros(design.shape[1])
    shrink = np.array([1e-5] + [1e-4] * (design.shape[1] - 1)) * importance.sum()
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        slope = design.T @ (importance * (p - y)) + shrink * w
        curve = (design * (importance * p * (1 - p))[:, None]).T @ design + np.diag(shrink)
        step = np.linalg.solve(curve, slope)
        w -= step * min(1.0, 4.0 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-9:
            break
    return w


def _unlike(rows: DataFrame) -> DataFrame:
    """``rows`` without (nearly all) copies and near copies: of texts that share one of three least hashes of
    their word runs, one stays, so that a group of copies counts as one document."""

    def run(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in incoming:
            marks = []
            for text in batch.column("text").to_pylist():
                words = folded(text).split()
                runs = {" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))}
                marks.append([min(zlib.crc32(r.encode(), seed) for r in runs) for seed in (1, 2, 3)])
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array([m[i] for m in marks], pa.int64()) for i in range(3))], names=[*batch.schema.names, "m0", "m1", "m2"])

    out = rows.mapInArrow(run, rows.selectExpr("*", "0L AS m0", "0L AS m1", "0L AS m2").schema)
    for mark in ("m0", "m1", "m2"):
        first = Window.partitionBy(mark).orderBy(F.xxhash64("doc_id"), "doc_id")
        out = out.withColumn("place", F.row_number().over(first)).where("place = 1").drop("place")
    return out.drop("m0", "m1", "m2")


def _counted(rows: DataFrame, only: frozenset[str] | None) -> DataFrame:
    """(word, n): documents that hold a beginning or word, of all or of ``only`` some."""
    shared = rows.sparkSession.sparkContext.broadcast(only)

    def run(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: Counter[str] = Counter()
        for batch in incoming:
            for text in batch.column("text").to_pylist():
                held = set(beginnings(set(folded(text).split())))
                count.update(held if shared.value is None else held & shared.value)
        words = list(count)
        for at in range(0, len(words), 10_000):
            some = words[at : at + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.string()), pa.array([count[w] for w in some], pa.int64())], names=["word", "n"])

    return rows.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _phrases(rows: DataFrame, lexicon: Lexicon) -> DataFrame:
    """(phrase, y, n): documents that hold a lexicon word with its neighbour on either side."""
    shared = rows.sparkSession.sparkContext.broadcast(cloudpickle.dumps(lexicon))

    def run(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, count = pickle.loads(shared.value).automaton(), Counter()
        for batch in incoming:
            for text, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist()):
                low, held = folded(text), set()
                for start, _, _ in matches(words, low):
                    end = low.find(" ", start + 1)
                    before, after = low.rfind(" ", 0, start), low.find(" ", end + 1)
                    if before >= 0:
                        held.add(low[before : end + 1])
                    if after >= 0:
                        held.add(low[start : after + 1])
                count.update((phrase, y) for phrase in held)
        keys = list(count)
        for at in range(0, len(keys), 10_000):
            some = keys[at : at + 10_000]
            columns = [pa.array([k[0] for k in some], pa.string()), pa.array([k[1] for k in some], pa.int64()), pa.array([count[k] for k in some], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["phrase", "y", "n"])

    return rows.select("text", "y").mapInArrow(run, "phrase string, y long, n long").groupBy("phrase", "y").agg(F.sum("n").alias("n"))


def _measured(rows: DataFrame, lexicon: Lexicon, columns: list[str], total: str, words: str) -> DataFrame:
    """``columns`` of ``rows`` with the weight and the words of the whole ``text`` (the first column)."""
    shared = rows.sparkSession.sparkContext.broadcast(cloudpickle.dumps(lexicon))

    def run(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = pickle.loads(shared.value).automaton()
        for batch in incoming:
            for at in range(0, batch.num_rows, 256):
                piece = batch.slice(at, 256)
                found = [weighed(automaton, text) for text in piece.column(0).to_pylist()]
                numbers = [pa.array([f[0] for f in found], pa.float64()), pa.array([f[1] for f in found], pa.int64())]
                yield pa.RecordBatch.from_arrays([*piece.columns[1:], *numbers], names=[*piece.schema.names[1:], total, words])

    source = rows.select(F.col("text").alias("measured_text"), *columns)
    return source.mapInArrow(run, source.select(*columns, F.lit(0.0).alias(total), F.lit(0).cast("long").alias(words)).schema)


def train(
    documents: DataFrame,
    labels: DataFrame,
    sample_rows: int = SAMPLE_ROWS,
    holdout: bool = True,
    exceptions: Iterable[str] = EXCEPTIONS,
) -> Lexicon:
    """A lexicon learned from labelled documents; with ``holdout`` only from those whose crc32(doc_id as text) modulo 3 is not 1."""
    known = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    known = known.agg(F.min("toxic").alias("low"), F.max("toxic").alias("high")).where("low = high")
    if holdout:
        known = known.where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1)
    known = staged(known.select("doc_id", F.col("high").cast("long").alias("y")), "toxic-labels")
    sizes = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    if len(sizes) < 2:
        return Lexicon(coefficients=(0.0 if not sizes else (30.0 if 1 in sizes else -30.0), 0.0, 0.0))
    picked = [known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows) for y in (0, 1)]
    # at most 2 x sample_rows ids and labels: a bounded table, sent along with the scan
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.join(F.broadcast(picked[0].unionByName(picked[1])), "doc_id")
    # repeated ids must not lift the sample above its bound
    rows = rows.groupBy("doc_id", "y").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    rows = staged(_unlike(rows), "toxic-sample")
    found = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    if len(found) < 2:
        return Lexicon()
    toxic, clean = found[1], found[0]

    # words of at most sample_rows documents that at least LEAST_DOCS of them hold
    held = {r["word"]: r["n"] for r in _counted(rows.where("y = 1"), None).where(F.col("n") >= max(LEAST_DOCS, toxic // 500)).collect()}
    other = {r["word"]: r["n"] for r in _counted(rows.where("y = 0"), frozenset(held)).collect()}
    lexicon = Lexicon(chosen_words({w: (n, other.get(w, 0)) for w, n in held.items()}, toxic, clean))
    if not lexicon.weights:
        return Lexicon(coefficients=(log(sizes[1] / sizes[0]), 0.0, 0.0))

    # phrases that clean documents hold beyond chance, and toxic ones at most a tenth as often
    often = _phrases(rows, lexicon).groupBy("phrase").agg(
        F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("t"), F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("c")
    )
    often = often.where((F.col("c") >= LEAST_DOCS) & (F.col("t") / toxic <= F.col("c") / (10 * clean))).orderBy(F.desc("c"), "phrase").limit(LEXICON)
    harmless = [r["phrase"] for r in often.collect() if evidence(r["c"], r["t"], clean, toxic) >= EVIDENCE / 2]
    lexicon.exceptions = tuple(sorted({*harmless, *map(folded, exceptions)} - {"  "}))

    # two numbers for each document of the sample
    pairs = _measured(rows, lexicon, ["y"], "total", "words").orderBy("y", "total", "words").toArrow()
    y, total, words = (pairs.column(c).to_numpy().astype(np.float64) for c in ("y", "total", "words"))
    importance = np.where(y == 1, sizes[1] / toxic, sizes[0] / clean)
    lexicon.coefficients = tuple(calibrated(measures(total, words), y, importance / importance.mean()).tolist())
    return lexicon


def classify(documents: DataFrame, lexicon: Lexicon, score: str = "score") -> DataFrame:
    """``documents`` with one more column, the toxicity of the whole text."""
    shared = documents.sparkSession.sparkContext.broadcast(cloudpickle.dumps(lexicon))

    def run(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learned = pickle.loads(shared.value)
        automaton = learned.automaton()
        for batch in incoming:
            for at in range(0, batch.num_rows, 256):
                piece = batch.slice(at, 256)
                found = np.array([weighed(automaton, text) for text in piece.column("text").to_pylist()])
                scores = learned.scores(found[:, 0], found[:, 1])
                yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(scores)], names=[*piece.schema.names, score])

    return documents.mapInArrow(run, documents.select("*", F.lit(0.0).alias(score)).schema)


def score_documents(documents: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row per document: doc_id, held_out, score and predicted."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = classify(rows, train(documents, labels, sample_rows))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    return scored.select(
        "doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).cast("int").alias("predicted")
    )
