"""Evaluation of scored rows (class ``y`` in {0, 1} and ``score``)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from cohortlens.operators.profile import CLASS_NAMES, histogram
from cohortlens.operators.ranks import running_totals
from cohortlens.storage import stage

# Thresholds of the published report.
THRESHOLDS = (0.3, 0.4, 0.5, 0.6, 0.7, 0.8)


def confusion(scored: DataFrame, threshold: float = 0.5, predicted: str | None = None) -> DataFrame:
    """tn, fp, fn, tp of column ``predicted``, or of scores from ``threshold`` on."""
    positive = f"{predicted} = 1" if predicted else f"score >= {threshold}D"
    cells = {
        "tn": f"y = 0 AND NOT ({positive})",
        "fp": f"y = 0 AND ({positive})",
        "fn": f"y = 1 AND NOT ({positive})",
        "tp": f"y = 1 AND ({positive})",
    }
    return scored.agg(*[F.expr(f"count_if({test})").alias(name) for name, test in cells.items()])


def _safe(numerator: str, denominator: str) -> str:
    """Quotient, 0 where it is undefined."""
    return f"coalesce(({numerator}) / CAST(nullif({denominator}, 0) AS DOUBLE), 0D)"


def metrics_of(cells: DataFrame) -> DataFrame:
    """Accuracy, precision, recall and F1 from a confusion row."""
    return cells.select(
        F.expr(_safe("tp + tn", "tp + tn + fp + fn")).alias("accuracy"),
        F.expr(_safe("tp", "tp + fp")).alias("precision"),
        F.expr(_safe("tp", "tp + fn")).alias("recall"),
        F.expr(_safe("2 * tp", "2 * tp + fp + fn")).alias("f1"),
    )


def binary_metrics(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    return metrics_of(confusion(scored, threshold))


def report_of(cells: DataFrame) -> DataFrame:
    """Per-class, accuracy, macro and weighted rows from a confusion row."""
    parts = cells.select(
        F.expr(_safe("tn", "tn + fn")).alias("p0"),
        F.expr(_safe("tn", "tn + fp")).alias("r0"),
        F.expr(_safe("2 * tn", "2 * tn + fn + fp")).alias("f0"),
        F.expr("tn + fp").alias("n0"),
        F.expr(_safe("tp", "tp + fp")).alias("p1"),
        F.expr(_safe("tp", "tp + fn")).alias("r1"),
        F.expr(_safe("2 * tp", "2 * tp + fp + fn")).alias("f1"),
        F.expr("tp + fn").alias("n1"),
        F.expr(_safe("tp + tn", "tp + tn + fp + fn")).alias("acc"),
    )
    macro = ", ".join(f"({m}0 + {m}1) / 2" for m in "prf")
    weighted = ", ".join(_safe(f"{m}0 * n0 + {m}1 * n1", "n0 + n1") for m in "prf")
    return parts.select(
        F.expr(
            f"stack(5, '{CLASS_NAMES[0]}', p0, r0, f0, n0, '{CLASS_NAMES[1]}', p1, r1, f1, n1, "
            f"'accuracy', NULL, NULL, acc, n0 + n1, 'macro avg', {macro}, n0 + n1, "
            f"'weighted avg', {weighted}, n0 + n1) AS (label, precision, recall, f1_score, support)"
        )
    )


def classification_report(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    return report_of(confusion(scored, threshold))


def score_totals(scored: DataFrame) -> DataFrame:
    """Per distinct score: pos, neg, prefix sums from the lowest score on, and totals.

    The rows are combined per score before anything is sorted, so tied scores are
    one row; that table is staged and serves all curves.
    """
    counts = scored.groupBy("score").agg(
        F.count_if(F.col("y") == 1).alias("pos"), F.count_if(F.col("y") == 0).alias("neg")
    )
    return running_totals(stage(counts, "scores"), "score", ["pos", "neg"])


def roc_auc(scored: DataFrame, totals: DataFrame | None = None) -> DataFrame:
    """Exact area under the ROC curve; ties count half; NULL without both classes.

    This and the curves take ready ``score_totals`` so that several share them.
    """
    below = "(neg_to - neg + neg / 2D)"
    totals = score_totals(scored) if totals is None else totals
    return totals.agg(
        F.expr(f"sum(pos * {below}) / nullif(CAST(max(pos_all) AS DOUBLE) * max(neg_all), 0D)").alias("roc_auc")
    )


def roc_curve(scored: DataFrame, totals: DataFrame | None = None) -> DataFrame:
    """False and true positive rate per threshold, and the start point (threshold NULL)."""
    totals = score_totals(scored) if totals is None else totals
    points = totals.select(
        F.col("score").alias("threshold"),
        F.expr("(neg_all - neg_to + neg) / CAST(nullif(neg_all, 0) AS DOUBLE)").alias("fpr"),
        F.expr("(pos_all - pos_to + pos) / CAST(nullif(pos_all, 0) AS DOUBLE)").alias("tpr"),
    )
    start = scored.sparkSession.range(1).selectExpr(
        "CAST(NULL AS DOUBLE) AS threshold", "0D AS fpr", "0D AS tpr"
    )
    return points.unionByName(start)


def pr_curve(scored: DataFrame, totals: DataFrame | None = None) -> DataFrame:
    """Precision and recall per threshold, and the end point (threshold NULL)."""
    flagged = "(pos_all - pos_to + pos + neg_all - neg_to + neg)"
    totals = score_totals(scored) if totals is None else totals
    points = totals.select(
        F.col("score").alias("threshold"),
        F.expr(f"(pos_all - pos_to + pos) / CAST({flagged} AS DOUBLE)").alias("precision"),
        F.expr("(pos_all - pos_to + pos) / CAST(nullif(pos_all, 0) AS DOUBLE)").alias("recall"),
    )
    end = scored.sparkSession.range(1).selectExpr(
        "CAST(NULL AS DOUBLE) AS threshold", "1D AS precision", "0D AS recall"
    )
    return points.unionByName(end)


def average_precision(scored: DataFrame, totals: DataFrame | None = None) -> DataFrame:
    """Average precision (recall-weighted, no interpolation) and prevalence."""
    precision = (
        "(pos_all - pos_to + pos) / CAST(pos_all - pos_to + pos + neg_all - neg_to + neg AS DOUBLE)"
    )
    totals = score_totals(scored) if totals is None else totals
    return totals.agg(
        F.expr(f"sum(pos * {precision}) / nullif(CAST(max(pos_all) AS DOUBLE), 0D)").alias("average_precision"),
        F.expr("max(pos_all) / CAST(nullif(max(pos_all) + max(neg_all), 0) AS DOUBLE)").alias("prevalence"),
    )


def score_histogram(scored: DataFrame, bins: int = 50) -> DataFrame:
    """Histogram of the scores per true class, each over its own range."""
    return histogram(scored.select("y", "score"), ["score"], bins, by=["y"]).drop("feature")


def threshold_table(scored: DataFrame, thresholds: Sequence[float] = THRESHOLDS) -> DataFrame:
    """Flagged rows, their share, precision and recall per threshold, in one pass."""
    counts = [F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("y") == 1).alias("positives")]
    for i, t in enumerate(thresholds):
        counts.append(F.expr(f"count_if(score >= {t}D)").alias(f"flagged{i}"))
        counts.append(F.expr(f"count_if(score >= {t}D AND y = 1)").alias(f"hits{i}"))
    rows = ", ".join(f"{t}D, flagged{i}, hits{i}" for i, t in enumerate(thresholds))
    stacked = scored.agg(*counts).select(
        "n_rows", "positives", F.expr(f"stack({len(thresholds)}, {rows}) AS (threshold, flagged, hits)")
    )
    return stacked.select(
        "threshold",
        "flagged",
        F.expr(_safe("flagged * 100D", "n_rows")).alias("pct_of_set"),
        F.expr(_safe("hits", "flagged")).alias("precision"),
        F.expr(_safe("hits", "positives")).alias("recall"),
    )
