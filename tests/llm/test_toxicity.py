import zlib

import numpy as np
import pytest

from cohortlens.llm import toxicity as T

from .conftest import text_of

SF = "/root/testdata/sf0.1"
INSULTS = ["grumbold", "snarkle", "vexwort"]


def labelled(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, toxic int")


def corpus(rng, n=240):
    rows, labels = [], []
    for i in range(n):
        words = text_of(rng, 40).split()
        if i % 3 == 0:
            for w in rng.sample(INSULTS, 2):
                words.insert(rng.randrange(len(words)), w)
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 3 == 0)))
    return rows, labels


@pytest.mark.parametrize(
    "text, want",
    [
        ("Idiot!", " idiot "),
        ("1d10t", " idiot "),
        ("ｉｄｉｏｔ", " idiot "),
        ("іdіоt", " idiot "),  # Cyrillic letters
        ("i​d­iot", " idiot "),
        ("ÏDÏÖT's", " idiot s "),
        ("𝐢𝐝𝐢𝐨𝐭", " idiot "),
        ("$tupid lo$er", " stupid ioser "),
        ("Stop! 100 105", " stop "),
        (None, "  "),
        (" \n\t", "  "),
        ("жук 日本", " жyк 日本 ".replace("к", "k")),
    ],
)
def test_folding(text, want):
    assert T.folded(text) == want


def naive(lexicon, text):
    """Weight of a folded text by looking at every place for every word."""
    found = {}
    for word, weight in lexicon.weights.items():
        for at in range(len(text)):
            if text.startswith(word, at):
                found[at] = max(found.get(at, 0), weight)
    shields = [(at, at + len(p)) for p in lexicon.exceptions for at in range(len(text)) if text.startswith(p, at)]
    ends = {at: max(at + len(w) for w in lexicon.weights if text.startswith(w, at)) for at in found}
    # what starts inside a phrase, before its last blank, is harmless
    return sum(w for at, w in found.items() if not any(a <= at and at < b - 1 and min(ends[at], at + 2) <= b for a, b in shields))


def test_matching_equals_brute_force(rng):
    lexicon = T.Lexicon({" idiot ": 5.0, " id": 2.0, " trash ": 4.0, " scu": 3.0}, (" trash can ", " a scum "))
    automaton = lexicon.automaton()
    words = ["idiot", "idle", "trash", "can", "a", "scum", "scuba", "other", "1d10t"]
    for _ in range(200):
        text = " ".join(rng.choice(words) for _ in range(rng.randrange(12)))
        total, n = T.weighed(automaton, text)
        assert total == pytest.approx(naive(lexicon, T.folded(text))) and n == len(T.folded(text).split())


def test_exception_phrases():
    lexicon = T.Lexicon({" trash ": 4.0}, (" trash can ",))
    a = lexicon.automaton()
    assert T.weighed(a, "the trash can")[0] == 0
    assert T.weighed(a, "you are trash, can you go")[0] == 0  # punctuation is folded away
    assert T.weighed(a, "trash cannot")[0] == 4 and T.weighed(a, "can trash")[0] == 4


def test_learned_words_and_beginnings(spark, make, rng):
    rows, labels = corpus(rng)
    # an insult with many endings is learned as its beginning
    for i in range(300, 420):
        rows.append((i, text_of(rng, 30) + (f" zorbl{rng.choice('aeiou')}{rng.choice('bcdfgklmnprst')}{rng.choice('aeiou')}" if i % 2 else "")))
        labels.append((i, i % 2))
    lexicon = T.train(make(rows), labelled(spark, labels), exceptions=())
    assert {T.folded(w) for w in INSULTS} <= set(lexicon.weights)
    assert any(w in (" zorbi", " zorbia", " zorbi"[:5]) or w.startswith(" zor") for w in lexicon.weights)
    assert not any(w.strip() in "alpha beta gamma delta".split() for w in lexicon.weights)


def test_exceptions_are_learned(spark, make, rng):
    rows, labels = corpus(rng, 600)
    # clean documents name a flower with the word of an insult
    for i in range(1000, 1060):
        rows.append((i, text_of(rng, 20) + (" yellow vexwort " if i % 2 else " ") + text_of(rng, 10)))
        labels.append((i, 0))
    lexicon = T.train(make(rows), labelled(spark, labels))
    assert any("yellow" in p or "yeiiow" in p for p in lexicon.exceptions)
    a = lexicon.automaton()
    assert T.weighed(a, "a yellow vexwort")[0] == 0 and T.weighed(a, "snarkle")[0] > 0


def test_copies_count_once(spark, make, rng):
    rows, labels = corpus(rng)
    same = text_of(rng, 40) + " qwertzuiop lorem"
    rows += [(1000 + i, same + (" x" if i % 2 else "")) for i in range(60)]
    labels += [(1000 + i, 1) for i in range(60)]
    lexicon = T.train(make(rows), labelled(spark, labels))
    assert not any("qwert" in w for w in lexicon.weights)


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = T.score_documents(docs, labels).toPandas().merge(labels.toPandas(), on="doc_id")
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in got.doc_id]).all()
    held = got[got.held_out]
    bad, good = held[held.toxic == 1].score.to_numpy(), held[held.toxic == 0].score.to_numpy()
    assert (bad[:, None] > good[None, :]).mean() > 0.9
    assert held[held.toxic == 0].predicted.mean() < 0.005 and held[held.toxic == 1].predicted.mean() > 0.85


def test_held_out_labels_and_other_columns_do_not_matter(spark, make, rng):
    rows, labels = corpus(rng)
    flipped = [(i, 1 - t if zlib.crc32(str(i).encode()) % 3 == 1 else t) for i, t in labels]
    docs = make(rows)
    want = sorted(T.score_documents(docs, labelled(spark, labels)).collect())
    assert sorted(T.score_documents(docs, labelled(spark, flipped)).collect()) == want
    other = docs.selectExpr("doc_id", "text", "'xx' AS lang", "'yy' AS source", "1 AS y", "2 AS score", "3 AS m0", "4 AS words")
    assert sorted(T.score_documents(other, labelled(spark, labels)).collect()) == want


def test_edge_cases(spark, make, rng):
    rows, labels = corpus(rng)
    rows += [(900, None), (901, ""), (902, "\n"), (None, "snarkle grumbold"), (3, rows[3][1]), (903, "w" * 2_500_000 + " snarkle vexwort"), (904, "SNARKLE! grumb0ld")]
    labels = labels + [(None, 1), (1, 1), (5, None), (4, 7)]
    docs = make(rows).selectExpr("*", "1 AS score", "2 AS y")
    got = T.score_documents(docs, labelled(spark, labels)).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    of = {r.doc_id: r for r in got}
    assert of[None].predicted == 1 and not of[None].held_out and of[904].predicted == 1
    assert {of[i].predicted for i in (900, 901, 902)} == {0}
    assert T.score_documents(make([]), labelled(spark, labels)).count() == 0
    assert {r.score for r in T.score_documents(docs, labelled(spark, [])).collect()} == {0.5}
    one = T.score_documents(docs, labelled(spark, [r for r in labels if r[1] == 1])).collect()
    assert all(r.predicted == 1 for r in one)


def test_sample_is_bounded(spark, make, rng):
    rows, labels = corpus(rng, 600)
    got = T.score_documents(make(rows), labelled(spark, labels), sample_rows=60).toPandas()
    assert (got.predicted == (got.doc_id % 3 == 0)).mean() > 0.9
