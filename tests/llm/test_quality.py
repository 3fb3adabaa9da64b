import zlib

import numpy as np
import pytest

from cohortlens.llm import quality
from cohortlens.llm.quality import Machine, Vectors

from .conftest import text_of

SF = "/root/testdata/sf0.01"


def test_sum_of_squares_is_all_pairs():
    rng = np.random.default_rng(1)
    m = Machine(0.3, rng.normal(size=(1 << quality.BUCKET_BITS) + 300), rng.normal(size=((1 << quality.BUCKET_BITS) + 300, 3)), np.zeros((len(quality.STATISTICS), quality.BINS - 1)))
    x = Vectors(np.array([0, 3, 3, 7]), np.array([5, 9, 30, 1, 5, 7, 9]), rng.normal(size=7), rng.normal(size=(3, len(quality.STATISTICS))))
    bins = m.binned(x.stats)
    for d, margin in enumerate(m.margins(x)):
        items = [(i, v) for i, v in zip(x.index[x.at[d] : x.at[d + 1]], x.value[x.at[d] : x.at[d + 1]])] + [(i, 1.0) for i in bins[d]]
        want = m.bias + sum(m.linear[i] * v for i, v in items)
        want += sum(items[a][1] * items[b][1] * (m.factors[items[a][0]] @ m.factors[items[b][0]]) for a in range(len(items)) for b in range(a))
        assert margin == pytest.approx(want)


def test_interactions_are_learned():
    # label 1 where exactly one of two words occurs: no linear model can tell
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 2, 3000), rng.integers(0, 2, 3000)
    index = [np.array([10] * x + [20] * y, dtype=np.int64) for x, y in zip(a, b)]
    at = np.concatenate([[0], np.cumsum([len(i) for i in index])])
    x = Vectors(at, np.concatenate(index), np.ones(at[-1], dtype=np.float32), np.zeros((3000, len(quality.STATISTICS))))
    m = quality.fit(x, (a != b).astype(float), epochs=40)
    assert ((m.scores(x) >= 0.5) == (a != b)).mean() > 0.95


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = quality.score_documents(docs, labels).toPandas().merge(labels.toPandas(), on="doc_id")
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in got.doc_id]).all()
    held = got[got.held_out]
    good, bad = held[held.quality == 1].score.to_numpy(), held[held.quality == 0].score.to_numpy()
    assert (good[:, None] > bad[None, :]).mean() > 0.97
    assert (held.predicted == held.quality).mean() > 0.95


def test_held_out_labels_do_not_matter(spark, make, rng):
    docs = make([(i, text_of(rng, 30) if i % 2 else "*** !!! " * 20) for i in range(120)])
    rows = [(i, i % 2) for i in range(120)]
    flipped = [(i, 1 - q if zlib.crc32(str(i).encode()) % 3 == 1 else q) for i, q in rows]
    a, b = (quality.score_documents(docs, spark.createDataFrame(r, "doc_id long, quality int")) for r in (rows, flipped))
    assert sorted(a.collect()) == sorted(b.collect())
    # source and language do not matter either
    other = quality.score_documents(docs.selectExpr("doc_id", "text", "'xx' AS lang", "'yy' AS source", "n_chars"), spark.createDataFrame(rows, "doc_id long, quality int"))
    assert sorted(a.collect()) == sorted(other.collect())


def test_edge_cases(spark, make, rng):
    rows = [(i, text_of(rng, 30) if i % 2 else "*** !!! " * 20) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "\n"), (None, "words"), (3, rows[3][1]), (103, "w" * 2_500_000)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(None, 1), (1, 0), (5, None), (3, 1)], "doc_id long, quality int")
    docs = make(rows).selectExpr("*", "1 AS score", "2 AS y", "3 AS quality")
    got = quality.score_documents(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert [r.held_out for r in got if r.doc_id is None] == [False]
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert {i for i in range(60) if i % 2 and i != 1} <= ids and not ids & {i for i in range(60) if i % 2 == 0}
    assert quality.score_documents(make([]), labels).count() == 0
    none = quality.score_documents(docs, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5}
    one = quality.score_documents(docs, labels.where("quality = 1 AND doc_id <> 1")).collect()
    assert all(r.predicted == 1 for r in one)


def test_sample_is_bounded(spark, make, rng):
    docs = make([(i, text_of(rng, 30) if i % 2 else "*** !!! " * 20) for i in range(120)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(120)], "doc_id long, quality int")
    got = quality.score_documents(docs, labels, sample_rows=40).toPandas()
    assert (got.predicted == got.doc_id % 2).mean() > 0.9


def test_text_of_a_repeated_id_does_not_depend_on_the_order(spark, make, rng):
    rows = [(i % 60, text_of(rng, 30) if i % 2 else "*** !!! " * (i + 1)) for i in range(240)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    a, b = (quality.score_documents(make(r).repartition(n), labels) for r, n in ((rows, 1), (rows[::-1], 7)))
    assert sorted(a.collect()) == sorted(b.collect())
