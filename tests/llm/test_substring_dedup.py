import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cohortlens.llm import anchors, substring_dedup, suffix_dedup
from cohortlens.llm.substring_dedup import SuffixAutomaton

from .conftest import by_id, text_of


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("ab", max_size=12), max_size=4), st.text("abc", max_size=15))
def test_matching_statistics(texts, query):
    automaton = SuffixAutomaton()
    for t in texts:
        automaton.add(t)
    for end, size in enumerate(automaton.matching(query), 1):
        want = max(k for k in range(end + 1) if k == 0 or any(query[end - k : end] in t for t in texts))
        assert size == want


def brute_words(rows, window):
    seen, out = {}, {}
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        w = (text or "").encode().split()
        gone = set()
        for i in range(len(w) - window + 1):
            g = tuple(w[i : i + window])
            if g in seen:
                gone.update(range(i, i + window))
            seen.setdefault(g, (doc, i))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out[doc] = (len(w), len(gone), hashlib.sha256(kept).hexdigest())
    return out


def brute_bytes(rows, window):
    count, out = {}, {}
    data = [(d, (t or "").encode()) for d, t in rows]
    for _, b in data:
        for i in range(len(b) - window + 1):
            g = b[i : i + window]
            count[g] = count.get(g, 0) + 1
    for doc, b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - window + 1):
            if count[b[i : i + window]] > 1:
                gone[i : i + window] = b"\x01" * window
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out[doc] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def cases(seed):
    rng = random.Random(seed)
    few = ["a", "b", "çé"]
    passage, other = text_of(rng, 12), text_of(rng, 9)
    rows = [(i, text_of(rng, rng.randint(0, 30), few if i % 3 else ("x", "yy", "z", "w w"))) for i in range(25)]
    rows += [(100 + i, f"{text_of(rng, rng.randint(0, 6))} {passage} {text_of(rng, 3)}") for i in range(30)]
    rows += [(200 + i, f"{other}\t{text_of(rng, i % 4)}\n{other}") for i in range(8)]
    copy = text_of(rng, 25)
    rows += [(300 + i, copy) for i in range(12)]
    rows += [(400, None), (401, ""), (402, " \n"), (403, "same " * 40), (None, copy), (404, "x" * 3000), (405, copy.replace("a", "A"))]
    return rows


@pytest.mark.parametrize("group", [anchors.GROUP, 3])
def test_words_match_brute_force(make, monkeypatch, group):
    kept = anchors.kept_windows
    monkeypatch.setattr(substring_dedup, "kept_windows", lambda *a: kept(*a, group=group))
    rows = cases(1)
    got = by_id(substring_dedup.repeats(make(rows), window=6, anchor=3))
    assert {d: tuple(r)[1:] for d, r in got.items()} == brute_words(rows, 6)


@pytest.mark.parametrize("group", [anchors.GROUP, 3])
def test_bytes_match_brute_force(make, monkeypatch, group):
    kept = anchors.kept_windows
    monkeypatch.setattr(suffix_dedup, "kept_windows", lambda *a: kept(*a, group=group))
    rows = cases(2)
    got = by_id(suffix_dedup.repeats(make(rows), window=24, anchor=8))
    assert {d: tuple(r)[1:] for d, r in got.items()} == brute_bytes(rows, 24)


def test_large_and_negative_ids(make):
    rows = [(-5, "a b c d e f g"), (2**62, "a b c d e f g"), (7, "x a b c d e f g y"), (-(2**62), "q r s t u v a b c d e f")]
    got = by_id(substring_dedup.repeats(make(rows), window=6, anchor=3))
    assert {d: tuple(r)[1:] for d, r in got.items()} == brute_words(rows, 6)


def test_production_windows(make):
    rng = random.Random(9)
    passage = text_of(rng, 60)
    rows = [(i, f"{text_of(rng, 40)} {passage} {text_of(rng, 40)}") for i in range(6)] + [(9, text_of(rng, 2000))]
    got = by_id(substring_dedup.repeats(make(rows)))
    assert {d: tuple(r)[1:] for d, r in got.items()} == brute_words(rows, 20)
    got = by_id(suffix_dedup.repeats(make(rows)))
    assert {d: tuple(r)[1:] for d, r in got.items()} == brute_bytes(rows, 200)


def test_repeated_rows_extra_columns_and_empty(make):
    rows = [(1, "a b c d e f g"), (1, "a b c d e f g"), (2, "a b c d e f g")]
    docs = make(rows).withColumn("doc", F.lit("x")).withColumn("whole", F.lit(1)).withColumn("n", F.lit(2))
    got = substring_dedup.repeats(docs, window=6, anchor=3).collect()
    assert sorted((r.doc_id, r.n_removed) for r in got) == [(1, 0), (1, 0), (2, 7)]
    got = suffix_dedup.repeats(docs, window=8, anchor=4, with_bytes=True).collect()
    assert [bytes(r.kept) for r in got] == [b""] * 3
    assert substring_dedup.repeats(make([])).count() == 0 and suffix_dedup.repeats(make([])).count() == 0
    text = by_id(substring_dedup.remove_repeats(docs.where("doc_id = 2"), window=6, anchor=3))
    assert text[2]["text"] == "a b c d e f g"


def test_reference_spans(spark, make):
    rng = random.Random(4)
    passage = text_of(rng, 30)
    reference = spark.createDataFrame([(text_of(rng, 50) + " " + passage,), (None,), ("",), (text_of(rng, 300),)], "text string")
    docs = make([(1, "begin " + passage + " end"), (2, "unrelated words only"), (3, None), (4, "")]).withColumn("x", F.lit(1))
    for shard in (20, 10_000):
        got = by_id(substring_dedup.remove_reference_spans(docs, reference, 12, shard))
        assert got[1]["text"] == "begin end" and got[2]["text"] == "unrelated words only"
        assert got[3]["text"] is None and got[4]["text"] == "" and got[1]["x"] == 1
    assert substring_dedup.remove_reference_spans(docs, reference.limit(0)).count() == 4
