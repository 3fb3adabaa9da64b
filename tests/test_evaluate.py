import math

import numpy as np
import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator

from cohortlens.operators import evaluate as V


def scored(spark, rows):
    return spark.createDataFrame([(i, int(y), float(s)) for i, (y, s) in enumerate(rows)], "id long, y int, score double")


@pytest.fixture(scope="module")
def published(spark):
    """Rows with the published confusion matrix."""
    counts = [(0, 0.1, 3366), (0, 0.9, 550), (1, 0.1, 722), (1, 0.9, 2295)]
    return spark.createDataFrame([(y, s, n) for y, s, n in counts], "y int, score double, n int").selectExpr(
        "y", "score", "explode(sequence(1, n)) AS id"
    )


def test_published_figures(spark, published):
    assert tuple(V.confusion(published).first()) == (3366, 550, 722, 2295)
    m = V.binary_metrics(published).first()
    assert [round(v, 4) for v in m] == [0.8165, 0.8067, 0.7607, 0.7830]
    report = {r.label: r for r in V.classification_report(published).collect()}
    assert [round(report["Not Successful"][c], 2) for c in ("precision", "recall", "f1_score")] == [0.82, 0.86, 0.84]
    assert [round(report["Successful"][c], 2) for c in ("precision", "recall", "f1_score")] == [0.81, 0.76, 0.78]
    assert report["weighted avg"].support == 6933 and report["accuracy"].precision is None
    row = V.threshold_table(published, [0.5, 0.95]).orderBy("threshold").collect()
    assert (row[0].flagged, round(row[0].pct_of_set, 2), round(row[0].precision, 4)) == (2845, 41.04, 0.8067)
    assert tuple(row[1])[1:] == (0, 0.0, 0.0, 0.0)
    assert round(V.average_precision(published).first().prevalence, 4) == 0.4352


def test_auc_equals_the_evaluator_and_pairs(spark):
    rng = np.random.default_rng(3)
    y = rng.integers(0, 2, 3000)
    s = np.round(np.clip(rng.normal(0.4 + 0.15 * y, 0.2), 0, 1), 2)
    df = scored(spark, zip(y, s))
    auc = V.roc_auc(df).first()[0]
    pos, neg = s[y == 1], s[y == 0]
    pairs = (pos[:, None] > neg).mean() + 0.5 * (pos[:, None] == neg).mean()
    assert auc == pytest.approx(pairs, abs=1e-12)
    evaluator = BinaryClassificationEvaluator(labelCol="y", rawPredictionCol="score", numBins=0)
    assert auc == pytest.approx(evaluator.evaluate(df), abs=1e-9)
    flipped = V.roc_auc(df.selectExpr("y", "-score AS score")).first()[0]
    assert flipped == pytest.approx(1 - auc, abs=1e-12)


def test_curves(spark):
    df = scored(spark, [(0, 0.1), (0, 0.4), (1, 0.35), (1, 0.8)])
    roc = sorted((r.threshold or math.inf, r.fpr, r.tpr) for r in V.roc_curve(df).collect())
    assert roc == [(0.1, 1.0, 1.0), (0.35, 0.5, 1.0), (0.4, 0.5, 0.5), (0.8, 0.0, 0.5), (math.inf, 0.0, 0.0)]
    pr = sorted((r.threshold or math.inf, r.precision, r.recall) for r in V.pr_curve(df).collect())
    assert pr == [(0.1, 0.5, 1.0), (0.35, pytest.approx(2 / 3), 1.0), (0.4, 0.5, 0.5), (0.8, 1.0, 0.5), (math.inf, 1.0, 0.0)]
    assert V.average_precision(df).first()[0] == pytest.approx(0.5 * 1 + 0.5 * 2 / 3)


@pytest.mark.parametrize(
    "rows, auc",
    [
        ([(1, 0.5), (0, 0.5), (1, 0.5)], 0.5),
        ([(0, 0.1), (0, 0.2), (1, 0.3)], 1.0),
        ([(1, 0.2), (1, 0.9)], None),
        ([(0, 0.2), (0, 0.9)], None),
    ],
)
def test_auc_edges(spark, rows, auc):
    assert V.roc_auc(scored(spark, rows)).first()[0] == auc
    assert V.confusion(scored(spark, rows)).count() == 1


def test_score_histogram(spark):
    df = scored(spark, [(0, 0.0), (0, 1.0), (0, 0.019), (1, 0.3), (1, 0.3)])
    got = {(r.y, r.bin): r.n for r in V.score_histogram(df).collect()}
    assert got == {(0, 0): 2, (0, 49): 1, (1, 25): 2}
