"""Line deduplication by a segment-partition edit join.

A line is removed when an earlier line of the corpus (smaller doc_id, or the
same document further up) is within ``max_edits`` edits of it; the input
decides, not what is left of it. Lines under ``min_chars`` characters, for which
so many edits would mean little, are removed when an earlier line equals them;
blank lines are kept. With at most t edits, one of t + 1 even segments of the
shorter line occurs unchanged in the longer one, at a place that the edits to
its left and right bound. So every distinct line indexes its t + 1 segments
under (length, segment number, text) and looks up the few substrings that can
match for each length from its own down to t less. What meets is verified with a
banded bit-parallel edit distance: the cells of the band that e edits reach
are the bits of one word per e, and one character moves all of them at once.

DataFrame functions only. Equal lines are combined before anything is joined,
so a line that a third of the documents share is one row, and keys are combined
before they are shuffled. A key of two lines is a pair at once. A key that more
lines share (a template) is not expanded into all pairs: first every line of it
is verified against the earliest one, which settles the copies of a template;
only lines that this leaves undecided meet the others, and only where the counts
of their letters are near enough. Texts are fetched once, for lines that share a key.

Defined results: NULL texts stay NULL, empty ones empty. A NULL doc_id counts
as the smallest. Rows with the same doc_id are one place: a line position that
one of them keeps, all keep. Extra columns are
carried along by ``remove_lines``.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import fresh, staged

MAX_EDITS = 2
MIN_CHARS = 20
#: Characters that are blank.
BLANK = " \t\n\x0b\x0c\r"
#: Bits of the map of ids (4 MB, whatever the input), and of one of its rows.
MAP_BITS, ROW_BITS = 1 << 25, 1 << 15
#: Classes of characters whose counts bound the edit distance from below.
CLASSES = ("e", "t", "a", "o", "i", "n", "s", "r", "hl", "dcu", "mfp", "gwyb", " ", "02468", "13579")
_FIRST_ID = -(1 << 63)


class Probe(NamedTuple):
    """A substring that a line looks up: segment ``number`` of lines ``less`` characters shorter, moved by ``shift``."""

    less: int
    number: int
    shift: int


def probes(t: int) -> list[Probe]:
    """All that can match with t edits; those with neither less nor shift are the line's own segments."""
    return [
        Probe(less, n, shift)
        for less in range(t + 1)
        for n in range(t + 1)
        for shift in range(max(-n, less - (t - n)), min(n, less + (t - n)) + 1)
    ]


def keyed(lines: DataFrame, t: int) -> DataFrame:
    """(id, key, own) of (id, line, length): one row per probe; ``own`` marks the segments that a line indexes.

    The probes are a constant array, so one small expression makes all keys.
    Keys of lengths that no line has meet nothing.
    """
    probe = F.array(*(F.struct(*(F.lit(v).alias(k) for k, v in p._asdict().items())) for p in probes(t)))
    rows = lines.select("id", "line", "length", F.inline(probe))
    other = F.col("length") - F.col("less")
    parts = t + 1
    base, longer = F.expr(f"int((length - less) div {parts})"), other % parts
    # an even partition; the last segments are the longer ones
    late = F.greatest(F.lit(0), F.col("number") - (F.lit(parts) - longer))
    size = base + (F.col("number") >= F.lit(parts) - longer).cast("int")
    at = base * F.col("number") + late + 1 + F.col("shift")
    key = F.xxhash64(other, "number", F.substring("line", at, size))
    return rows.where(other > t).select("id", key.alias("key"), F.expr("less = 0 AND shift = 0").alias("own"))


def within(a: Column, b: Column, t: int) -> Column:
    """Whether the edit distance of ``a`` and ``b`` is at most ``t``; banded and bit-parallel.

    Bit d of word e says: with e edits, the first j characters of ``b`` become
    the first j + d - t of ``a``.
    """
    n, m = F.char_length(a), F.char_length(b)
    start = F.array(*(F.lit(((1 << (e + 1)) - 1) << t).cast("long") for e in range(t + 1)))

    def matches(x: Column, c: Column, j: Column) -> Column:
        bits = F.lit(0).cast("long")
        for d in range(2 * t + 1):
            same = F.when(j + (d - t) >= 0, F.get(x, j + (d - t)) == c)
            bits = bits + F.when(F.coalesce(same, F.lit(False)), F.lit(1 << d)).otherwise(F.lit(0))
        return bits

    def step(state: Column, match: Column) -> Column:
        words: list[Column] = []
        for e in range(t + 1):
            new = F.get(state, F.lit(e)).bitwiseAND(match)
            if e:
                before = F.get(state, F.lit(e - 1))
                new = new.bitwiseOR(before).bitwiseOR(F.shiftright(before, 1)).bitwiseOR(F.shiftleft(words[-1], 1))
            words.append(new.bitwiseAND(F.lit((1 << (2 * t + 1)) - 1)))
        return F.array(*words)

    def reached(pair: Column) -> Column:
        """The last word of the band; ``pair`` holds the characters, split once for all steps."""
        masks = F.transform(pair["y"], lambda c, j: matches(pair["x"], c, j))
        return F.get(F.aggregate(masks, start, step), F.lit(t))

    none = F.array().cast("array<string>")
    pair = F.struct(F.split(a, "").alias("x"), F.when(m > 0, F.split(b, "")).otherwise(none).alias("y"))
    end = F.get(F.transform(F.array(pair), reached), F.lit(0))
    last = F.get(F.array(*(F.lit(1 << d).cast("long") for d in range(2 * t + 1))), n - m + t)
    return F.when(F.abs(n - m) <= t, end.bitwiseAND(last) != 0).otherwise(F.lit(False))


class Places(NamedTuple):
    """How (doc_id, position) is one number that orders lines: slot of the document times ``width`` plus position."""

    first: int
    width: int
    wide: bool

    @classmethod
    def of(cls, documents: DataFrame) -> Places:
        """Numbers of 64 bits where the ids and lengths of ``documents`` allow it, else decimals."""
        doc = F.col("doc_id").cast("long")
        longest = F.max(F.octet_length(F.col("text").cast("string")))
        low, high, size = documents.select(doc.alias("doc_id"), "text").agg(F.min("doc_id"), F.max("doc_id"), longest).first()
        low, high, width = low or 0, high or 0, (size or 0) + 1
        if (high - low + 2) * width < 1 << 63:
            return cls(low, width, False)
        return cls(_FIRST_ID, 1 << 31, True)

    def slot(self) -> Column:
        """Of a document; that of a NULL doc_id comes first."""
        doc = F.col("doc_id").cast("long")
        if self.wide:
            return F.coalesce(doc, F.lit(_FIRST_ID).cast("long"))
        return F.coalesce(doc - F.lit(self.first).cast("long") + 1, F.lit(0).cast("long"))

    def number(self, slot: str, pos: str) -> Column:
        if self.wide:
            return (F.col(slot).cast("decimal(20,0)") * F.lit(self.width).cast("decimal(10,0)") + F.col(pos)).cast("decimal(31,0)")
        return F.col(slot) * F.lit(self.width).cast("long") + F.col(pos)

    def split(self, number: str) -> tuple[Column, Column]:
        """Slot and position of a number."""
        width = F.lit(self.width).cast("decimal(10,0)" if self.wide else "long")
        pos = F.pmod(number, width)
        if self.wide:
            return ((F.col(number) - pos) / width).cast("decimal(20,0)").cast("long"), pos.cast("int")
        return F.expr(f"{number} div {self.width}L"), pos.cast("int")


def blank(line: Column) -> Column:
    return F.trim(line, F.lit(BLANK)) == ""


def distinct_lines(documents: DataFrame, places: Places) -> DataFrame:
    """Each different line that is not blank once, with the number of its first place."""
    slot = places.slot().alias("slot")
    lines = documents.select(slot, F.posexplode(F.split(F.col("text").cast("string"), "\n")).alias("pos", "line"))
    lines = lines.where(~blank(F.col("line"))).select("line", places.number("slot", "pos").alias("place"))
    first = lines.groupBy("line").agg(F.min("place").alias("id"))
    return staged(first.select("line", F.char_length("line").alias("length"), "id"), "lines")


def among(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The ``rows`` whose id is in ``ids``, which holds each id once.

    A broadcast map of hashed ids, of the same size for every input, holds most
    other rows back from the shuffle of the exact join that follows.
    """
    place = F.pmod(F.xxhash64("id"), F.lit(MAP_BITS))
    places = ids.select(place.alias("place")).distinct()
    bits = places.groupBy(F.expr(f"place div {ROW_BITS}").alias("row")).agg(
        F.bitmap_construct_agg(F.col("place") % ROW_BITS).alias("bits")
    )
    byte = F.conv(F.hex(F.substring("bits", F.expr(f"int(place % {ROW_BITS} div 8 + 1)"), F.lit(1))), 16, 10).cast("int")
    found = rows.withColumn("place", place).withColumn("row", F.expr(f"place div {ROW_BITS}")).join(F.broadcast(bits), "row")
    found = found.where(byte.bitwiseAND(F.expr("shiftleft(1, int(place % 8))")) != 0)
    # a semi join would be moved below the map; ids are distinct, so an inner one gives the same rows
    return found.select(*rows.columns).join(ids, "id")


def _with_counts(lines: DataFrame) -> DataFrame:
    n = F.col("length")
    counts = (n - F.char_length(F.translate("line", c, "")) for c in CLASSES)
    return lines.select("id", "line", F.struct(*(c.alias(f"c{i}") for i, c in enumerate(counts))).alias("counts"))


def _near_counts(a: str, b: str, t: int) -> Column:
    """False only for lines that more than t edits part: one edit moves two counts by one each at most."""
    apart = F.lit(0)
    for i in range(len(CLASSES)):
        apart = apart + F.abs(F.col(f"{a}.c{i}") - F.col(f"{b}.c{i}"))
    return apart <= 2 * t


def _verified(pairs: DataFrame, texts: DataFrame, t: int) -> DataFrame:
    """Ids of the late lines of (late, early) candidates that are within ``t`` edits of the early one."""
    late = texts.select(F.col("id").alias("late"), F.col("line").alias("a"), F.col("counts").alias("a_counts"))
    early = texts.select(F.col("id").alias("early"), F.col("line").alias("b"), F.col("counts").alias("b_counts"))
    met = pairs.join(late, "late").join(early, "early").where(_near_counts("a_counts", "b_counts", t))
    return met.where(within(F.col("a"), F.col("b"), t)).select(F.col("late").alias("id")).distinct()


def repeated_lines(lines: DataFrame, t: int) -> DataFrame:
    """Ids of the distinct lines that have an earlier line within ``t`` edits."""
    rows = keyed(lines, t)
    # a key matters if two lines have it and one of them indexes it
    shared = rows.groupBy("key").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("id").alias("pivot"),
        F.max("id").alias("high"),
        F.min(F.when(F.col("own"), F.col("id"))).alias("indexed"),
    )
    shared = staged(shared.where("pivot < high AND indexed IS NOT NULL"), "line-keys")
    twos = shared.where("n = 2").select(F.col("high").alias("late"), F.col("pivot").alias("early"))
    crowded = shared.where("n > 2").select("key", "pivot", F.expr("indexed = pivot").alias("pivot_indexed"))
    members = staged(rows.join(staged(crowded, "line-crowded"), "key").where("id > pivot"), "line-members")
    star = members.where("own OR pivot_indexed").select(F.col("id").alias("late"), F.col("pivot").alias("early"))
    first = staged(twos.unionByName(star).distinct(), "line-pairs")
    ids = members.select("id").unionByName(first.select(F.explode(F.array("late", "early")).alias("id")))
    texts = staged(_with_counts(among(lines, staged(ids.distinct(), "line-ids"))), "line-texts")
    settled = staged(_verified(first, texts, t), "line-settled")
    # what this leaves undecided meets the other earlier lines of its keys
    counted = members.select("key", "id", "own").join(texts.select("id", "counts"), "id")
    late = counted.join(settled, "id", "left_anti")
    late = late.select("key", F.col("id").alias("late"), F.col("own").alias("late_own"), F.col("counts").alias("a_counts"))
    early = counted.select("key", F.col("id").alias("early"), F.col("own").alias("early_own"), F.col("counts").alias("b_counts"))
    rest = late.join(early, "key").where("early < late AND (late_own OR early_own)").where(_near_counts("a_counts", "b_counts", t))
    rest = staged(rest.select("late", "early").distinct(), "line-rest")
    return settled.unionByName(_verified(rest, texts, t)).distinct()


def kept_positions(documents: DataFrame, places: Places, max_edits: int = MAX_EDITS, min_chars: int = MIN_CHARS) -> DataFrame:
    """For each document the sorted positions of the lines that are not blank and stay: (slot, kept)."""
    if max_edits >= min_chars:
        raise ValueError("lines must be longer than the edits that are allowed")
    lines = distinct_lines(documents, places)
    stay = lines.select("id")
    if max_edits:
        stay = stay.join(staged(repeated_lines(lines.where(F.col("length") >= min_chars), max_edits), "line-repeats"), "id", "left_anti")
    slot, pos = places.split("id")
    return stay.select(slot.alias("slot"), pos.alias("pos")).groupBy("slot").agg(F.sort_array(F.collect_list("pos")).alias("kept"))


def _with_lines(documents: DataFrame, max_edits: int, min_chars: int, names: list[str]) -> DataFrame:
    """``documents`` with the array of its lines and the array of those that stay."""
    key, lines, stay, kept = names
    places = Places.of(documents)
    decided = kept_positions(documents, places, max_edits, min_chars).select(F.col("slot").alias(key), F.col("kept").alias(kept))
    both = documents.join(decided, places.slot() == F.col(key), "left").withColumn(lines, F.split(F.col("text").cast("string"), "\n"))
    # one flag per line, from the gaps between kept positions, so that the look-up below is by index
    gaps = F.transform(
        F.col(kept),
        lambda p, i: F.concat(
            F.repeat(F.lit("0"), p - F.coalesce(F.get(F.col(kept), i - 1), F.lit(-1)) - 1), F.lit("1")
        ),
    )
    flags = F.split(F.concat(F.lit("0"), F.array_join(gaps, "")), "")  # first flag: position -1

    def those_that_stay(pair: Column) -> Column:
        """``pair`` holds lines and flags, made once for all lines."""
        return F.filter(
            pair["lines"],
            lambda line, i: (F.coalesce(F.get(pair["flags"], i + 1), F.lit("0")) == "1") | blank(line),
        )

    pair = F.struct(F.col(lines).alias("lines"), flags.alias("flags"))
    stays = F.when(F.col(lines).isNotNull(), F.get(F.transform(F.array(pair), those_that_stay), F.lit(0)))
    return both.withColumn(stay, stays)


def _names(documents: DataFrame) -> list[str]:
    return fresh(documents, "line_key", "all_lines", "stay_lines", "kept_lines")


def remove_lines(documents: DataFrame, max_edits: int = MAX_EDITS, min_chars: int = MIN_CHARS, drop_emptied: bool = True) -> DataFrame:
    """``documents`` without repeated lines, same columns; ``n_chars`` follows the text if it is there.

    With ``drop_emptied`` a document that had words and keeps none goes.
    """
    names = _names(documents)
    lines, stay = names[1], names[2]
    out = _with_lines(documents, max_edits, min_chars, names)
    changed = F.size(stay) < F.size(lines)
    text = F.when(changed, F.array_join(stay, "\n")).otherwise(F.col("text"))
    if drop_emptied:
        out = out.where(~F.coalesce(changed, F.lit(False)) | F.exists(stay, lambda line: line.rlike(r"[^\x20\x09-\x0D]")))
    columns = []
    for c in documents.columns:
        kind = documents.schema[c].dataType
        if c == "text":
            columns.append(text.cast(kind).alias(c))
        elif c == "n_chars":
            columns.append(F.when(changed, F.char_length(text)).otherwise(F.col(c)).cast(kind).alias(c))
        else:
            columns.append(F.col(c))
    return out.select(*columns)


def report(documents: DataFrame, max_edits: int = MAX_EDITS, min_chars: int = MIN_CHARS) -> DataFrame:
    """One row per document: doc_id, n_lines, n_removed and the SHA-256 of what is kept."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    names = _names(docs)
    out = _with_lines(docs, max_edits, min_chars, names)
    lines, stay = names[1], names[2]
    n = F.when(F.coalesce(F.col("text"), F.lit("")) == "", 0).otherwise(F.size(lines))
    return out.select(
        "doc_id",
        n.cast("long").alias("n_lines"),
        F.coalesce(F.size(lines) - F.size(stay), F.lit(0)).cast("long").alias("n_removed"),
        F.sha2(F.coalesce(F.array_join(stay, "\n"), F.lit("")), 256).alias("kept_sha256"),
    )
