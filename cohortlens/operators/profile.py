"""Profiling tables of a wide dataset."""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import Column, DataFrame, functions as F, types as T

from cohortlens.functions import map_values, percent
from cohortlens.operators.ranks import value_quantiles
from cohortlens.sources.dataset import EARLY_COLUMNS, LABEL_COLUMNS, OUTCOME_COLUMNS
from cohortlens.storage import stage

# the functions below travel with the task, so executors need not have the package
register_pickle_by_value(sys.modules[__name__])

TARGET = "is_successful_project"

QUARTILES = {"q25": 0.25, "q50": 0.5, "q75": 0.75}

# Columns left out of the correlation with the target.
CORRELATION_EXCLUDES = (
    "repo_id",
    "creator_id",
    *[c for c in LABEL_COLUMNS if c != TARGET],
    *OUTCOME_COLUMNS,
)
# Columns of the correlation matrix.
MATRIX_COLUMNS = tuple(
    c for c in EARLY_COLUMNS if c not in ("issues_closed_30d", "prs_closed_30d", "total_events_30d")
) + (TARGET,)
# Columns of the histograms and of the box plots.
HISTOGRAM_COLUMNS = (
    "push_events_30d",
    "total_commits_30d",
    "stars_30d",
    "forks_30d",
    "unique_contributors_30d",
    "issues_opened_30d",
    "prs_opened_30d",
)
BOX_COLUMNS = (
    "stars_30d",
    "forks_30d",
    "unique_contributors_30d",
    "total_commits_30d",
    "issues_opened_30d",
    "prs_opened_30d",
)
WEEK_COLUMNS = ("events_week_1", "events_week_2", "events_week_3", "events_week_4")
CLASS_NAMES = {0: "Not Successful", 1: "Successful"}


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [
        f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in exclude
    ]


def by_class(df: DataFrame, value: int, y: str = TARGET) -> DataFrame:
    return df.filter(F.col(y) == value)


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """Count and percentage of the non-null values of a column."""
    known = df.filter(F.col(col).isNotNull())
    counts = known.groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    whole = known.agg(F.count(F.lit(1)).alias("n_all")).scalar()
    return counts.select(F.col(col).alias("value"), "n", percent(F.col("n"), whole).alias("pct"))


def class_ratio(df: DataFrame, y: str = TARGET) -> DataFrame:
    """Negatives, positives and negatives per positive."""
    return df.agg(
        F.count_if(F.col(y) == 0).alias("negatives"), F.count_if(F.col(y) == 1).alias("positives")
    ).withColumn("ratio", F.col("negatives") / F.nullif(F.col("positives"), F.lit(0)))


def top_k(df: DataFrame, col: str, k: int) -> DataFrame:
    """The k most frequent non-null values; equal counts by value."""
    counts = df.filter(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), F.asc(col)).limit(k)


def semi_join_top_k(df: DataFrame, col: str, k: int) -> DataFrame:
    """Rows whose value is among the k most frequent (k rows are broadcast)."""
    return df.join(F.broadcast(top_k(df, col, k).select(col)), col, "left_semi")


def rate_by(df: DataFrame, key: str, y: str = TARGET) -> DataFrame:
    """Rows, positives and success rate in percent per non-null key, best first."""
    grouped = df.filter(F.col(key).isNotNull()).groupBy(key)
    counts = grouped.agg(F.count(F.lit(1)).alias("total_repos"), F.sum(y).cast("bigint").alias("successful"))
    rate = percent(F.col("successful"), F.col("total_repos"), 2)
    return counts.withColumn("success_rate", rate).orderBy(F.desc("success_rate"), F.asc(key))


def class_means(df: DataFrame, columns: Sequence[str], y: str = TARGET) -> DataFrame:
    """Mean of each column per class and their difference, one row per column."""
    means = [
        F.expr(f"avg(CASE WHEN {y} = {value} THEN {c} END)").alias(f"{c}__{value}")
        for c in columns
        for value in (1, 0)
    ]
    rows = ", ".join(f"'{c}', {c}__1, {c}__0" for c in columns)
    stacked = df.agg(*means).select(
        F.expr(f"stack({len(columns)}, {rows}) AS (feature, successful_mean, unsuccessful_mean)")
    )
    return stacked.withColumn("difference", F.expr("successful_mean - unsuccessful_mean"))


def weekly_trend(df: DataFrame, columns: Sequence[str] = WEEK_COLUMNS, y: str = TARGET) -> DataFrame:
    """Mean activity per week and class, with class names."""
    means = df.groupBy(y).agg(*[F.avg(c).alias(c) for c in columns])
    long = means.unpivot([y], list(columns), "week", "mean_events")
    return long.select(map_values(F.col(y), CLASS_NAMES).alias("class"), "week", "mean_events")


def group_insights(df: DataFrame, key: str, min_rows: int = 100, k: int = 10, y: str = TARGET) -> DataFrame:
    """Success rate and mean early activity of the best large groups."""
    grouped = df.groupBy(key).agg(
        F.count(y).alias("total_projects"),
        F.round(F.avg(y), 3).alias("success_rate"),
        F.round(F.avg("stars_30d"), 3).alias("avg_stars_30d"),
        F.round(F.avg("unique_contributors_30d"), 3).alias("avg_contributors_30d"),
        F.round(F.avg("total_commits_30d"), 3).alias("avg_commits_30d"),
    )
    large = grouped.filter(F.col("total_projects") >= min_rows)
    return large.orderBy(F.desc("success_rate"), F.asc(key)).limit(k)


def missing_report(df: DataFrame) -> DataFrame:
    """Missing count and percentage of the columns that miss anything."""
    nulls = [F.expr(f"count_if(`{c}` IS NULL)").alias(f"n{i}") for i, c in enumerate(df.columns)]
    totals = df.agg(F.count(F.lit(1)).alias("n_rows"), *nulls)
    rows = ", ".join(f"'{c}', n{i}" for i, c in enumerate(df.columns))
    stacked = totals.select("n_rows", F.expr(f"stack({len(df.columns)}, {rows}) AS (column_name, missing)"))
    missing_pct = percent(F.col("missing"), F.col("n_rows"), 2).alias("missing_pct")
    return (
        stacked.filter("missing > 0")
        .select("column_name", "missing", missing_pct)
        .orderBy(F.desc("missing"), F.asc("column_name"))
    )


def coverage(df: DataFrame, columns: Sequence[str] = ("primary_language", "description")) -> DataFrame:
    """Known values per column: count and percentage."""
    totals = df.agg(F.count(F.lit(1)).alias("n_rows"), *[F.count(c).alias(c) for c in columns])
    rows = ", ".join(f"'{c}', {c}" for c in columns)
    stacked = totals.select("n_rows", F.expr(f"stack({len(columns)}, {rows}) AS (column_name, known)"))
    return stacked.withColumn("known_pct", percent(F.col("known"), F.col("n_rows"), 2))


def has_any(df: DataFrame, col: str) -> bool:
    """Is any value known? Chooses between the language and the activity-level report."""
    return not df.filter(F.col(col).isNotNull()).isEmpty()


def describe_numeric(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, mean, sample std, min, exact quartiles and max per column."""
    moments = [
        F.expr(f"{f}({c})").cast("double").alias(f"{c}__{name}")
        for c in columns
        for name, f in (("count", "count"), ("mean", "avg"), ("std", "stddev_samp"), ("min", "min"), ("max", "max"))
    ]
    rows = ", ".join(f"'{c}', {c}__count, {c}__mean, {c}__std, {c}__min, {c}__max" for c in columns)
    stacked = df.agg(*moments).select(
        F.expr(f"stack({len(columns)}, {rows}) AS (feature, n, mean, std, min, max)")
    )
    quartiles = value_quantiles(df, columns, QUARTILES)
    # both sides have one row per column
    joined = stacked.join(F.broadcast(quartiles), "feature", "left")
    return joined.select(
        "feature", F.col("n").cast("bigint").alias("n"), "mean", "std", "min", "q25", "q50", "q75", "max"
    )


def _pair_sums(df: DataFrame, columns: Sequence[str], centres: Sequence[float]) -> DataFrame:
    """Sums over the rows where both columns of a pair are known: (i, j, n, sx, sy, sxx, syy, sxy), one row per pair.

    Each task adds up matrices over its rows, so a pair costs one product however
    many pairs there are. Values are taken relative to ``centres``, which keeps the sums small.
    """
    p = len(columns)
    i, j = np.tril_indices(p)

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, sx, sxx, sxy = (np.zeros((p, p)) for _ in range(4))
        for batch in batches:
            x = batch.to_numpy(dtype=np.float64) - np.asarray(centres)
            known = (~np.isnan(x)).astype(np.float64)
            x = np.where(known > 0, x, 0.0)
            n += known.T @ known
            sx += x.T @ known
            sxx += (x * x).T @ known
            sxy += x.T @ x
        yield pd.DataFrame(
            {"i": i, "j": j, "n": n[i, j], "sx": sx[i, j], "sy": sx[j, i], "sxx": sxx[i, j], "syy": sxx[j, i], "sxy": sxy[i, j]}
        )

    sums = ("n", "sx", "sy", "sxx", "syy", "sxy")
    parts = df.select(*[F.col(c).cast("double") for c in columns]).mapInPandas(
        add, "i int, j int, " + ", ".join(f"{s} double" for s in sums)
    )
    return parts.groupBy("i", "j").agg(*[F.sum(s).alias(s) for s in sums])


def _correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(i, j, correlation) for j <= i; NULL if a side is constant over the common rows."""
    columns = list(columns)
    means = df.agg(*[F.coalesce(F.avg(c), F.lit(0.0)).alias(f"m{k}") for k, c in enumerate(columns)]).first()
    pairs = _pair_sums(df, columns, [float(m) for m in means])
    spread = "(sxx - sx * sx / n) * (syy - sy * sy / n)"
    # what rounding leaves of a constant column is not a deviation
    flat = "sxx - sx * sx / n <= 1e-12 * sxx OR syy - sy * sy / n <= 1e-12 * syy"
    value = f"CASE WHEN n > 0 AND NOT ({flat}) THEN (sxy - sx * sy / n) / sqrt({spread}) END"
    return pairs.select("i", "j", F.expr(value).alias("correlation"))


def _name(columns: Sequence[str], at: str) -> Column:
    return F.get(F.array(*[F.lit(c) for c in columns]), F.col(at))


def corr_with(df: DataFrame, columns: Sequence[str], y: str = TARGET, include_target: bool = True) -> DataFrame:
    """Correlation of each column with the target, highest first, in one pass; pairs with a NULL are left out."""
    with_itself = include_target and y in columns
    columns = [c for c in columns if c != y]
    found = _correlations(df, [*columns, y]).where(F.col("i") == len(columns))
    if not with_itself:
        found = found.where(F.col("j") < len(columns))
    rows = found.select(_name([*columns, y], "j").alias("feature"), "correlation")
    return rows.orderBy(F.desc_nulls_last("correlation"), F.asc("feature"))


def corr_matrix(df: DataFrame, columns: Sequence[str] = MATRIX_COLUMNS) -> DataFrame:
    """Lower triangle of the correlation matrix with its diagonal, in long form, in one pass."""
    return _correlations(df, columns).select(
        _name(columns, "i").alias("feature_a"), _name(columns, "j").alias("feature_b"), "correlation"
    )


def histogram(
    df: DataFrame,
    columns: Sequence[str],
    bins: int = 50,
    zero_as: float | None = None,
    by: Sequence[str] = (),
) -> DataFrame:
    """Equal-width histogram per column (and ``by`` group) between its own min and max.

    Bins are left-closed, the last one is closed; empty bins, NULLs, values that are not
    finite and rows with a NULL group are left out. A constant column gets the range value +- 0.5.
    One pass finds the ranges; in a second one each task counts into arrays of
    bins, one per column and group, and only filled bins are shuffled. The groups are few.
    """
    by, columns = list(by), list(columns)
    # NaN is greater than infinity
    value = "CASE WHEN abs(CAST(`{0}` AS DOUBLE)) < CAST('Infinity' AS DOUBLE) THEN CAST(`{0}` AS DOUBLE) END"
    if zero_as is not None:
        value = f"CASE WHEN `{{0}}` = 0 THEN {zero_as}D ELSE {value} END"
    rows = df.select(*by, *[F.expr(value.format(c)).alias(f"v{i}") for i, c in enumerate(columns)]).dropna(subset=by)
    ends = [F.expr(f"{f}(v{i})").alias(f"{f}{i}") for i in range(len(columns)) for f in ("min", "max")]
    # one row per group
    ranges = {tuple(r[c] for c in by): r for r in (rows.groupBy(*by) if by else rows).agg(*ends).collect()}
    keys = ", ".join(f"`{c}` {dict(df.dtypes)[c]}, " for c in by)

    def bounds(group: tuple, i: int) -> tuple[float, float]:
        lo, hi = ranges[group][f"min{i}"], ranges[group][f"max{i}"]
        return (lo - 0.5, hi + 0.5) if lo == hi else (lo, hi)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict[tuple, np.ndarray] = {}
        for batch in batches:
            for group, part in batch.groupby(by, sort=False) if by else [((), batch)]:
                for i in range(len(columns)):
                    values = part[f"v{i}"].to_numpy(dtype=np.float64)
                    values = values[~np.isnan(values)]
                    if len(values):
                        at = found.setdefault((group, i), np.zeros(bins, dtype=np.int64))
                        at += np.bincount(bin_of(values, *bounds(group, i), bins), minlength=bins)
        cells = [(*group, columns[i], b, n) for (group, i), at in found.items() for b, n in enumerate(at) if n]
        yield pd.DataFrame(cells, columns=[*by, "feature", "bin", "n"])

    counted = rows.mapInPandas(count, f"{keys}feature string, bin int, n bigint")
    summed = counted.groupBy(*by, "feature", "bin").agg(F.sum("n").alias("n"))
    edges = [(*group, c, *bounds(group, i)) for group in ranges for i, c in enumerate(columns) if ranges[group][f"min{i}"] is not None]
    edges = df.sparkSession.createDataFrame(edges, f"{keys}feature string, lo double, hi double")
    # one row per column and group
    placed = summed.join(F.broadcast(edges), [*by, "feature"]).withColumn("width", F.expr(f"(hi - lo) / {bins}"))
    ends = [F.expr("lo + bin * width").alias("bin_from"), F.expr("lo + (bin + 1) * width").alias("bin_to")]
    return placed.select(*by, "feature", "bin", *ends, "n")


def bin_of(values: np.ndarray, lo: float, hi: float, bins: int) -> np.ndarray:
    """Bin of each value; division may land on the wrong side of an edge by rounding, so edges decide."""
    width = (hi - lo) / bins
    guess = np.minimum(np.floor((values - lo) / (hi - lo) * bins), bins - 1).astype(np.int64)
    below = values < lo + guess * width
    above = (guess < bins - 1) & (values >= lo + (guess + 1) * width)
    return guess - below + (above & ~below)


def box_stats(df: DataFrame, columns: Sequence[str] = BOX_COLUMNS, y: str = TARGET) -> DataFrame:
    """Quartiles, 1.5 IQR whiskers (extreme values inside the fences) and outliers per class."""
    values = [F.col(c).cast("double").alias(c) for c in columns]
    rows = stage(df.select(map_values(F.col(y), CLASS_NAMES).alias("class"), *values), "boxes")
    quartiles = value_quantiles(rows, columns, QUARTILES, ["class"])
    by_class = quartiles.groupBy("class").agg(
        F.map_from_entries(F.collect_list(F.struct("feature", F.struct(*QUARTILES)))).alias("q")
    )
    # one row per class
    fenced = rows.join(F.broadcast(by_class), "class")
    found = []
    for c in columns:
        low, high = f"q['{c}'].q25", f"q['{c}'].q75"
        inside = f"`{c}` BETWEEN {low} - 1.5D * ({high} - {low}) AND {high} + 1.5D * ({high} - {low})"
        found += [
            F.expr(f"min(CASE WHEN {inside} THEN `{c}` END)").alias(f"{c}__low"),
            F.expr(f"max(CASE WHEN {inside} THEN `{c}` END)").alias(f"{c}__high"),
            F.expr(f"count_if(`{c}` IS NOT NULL AND NOT ({inside}))").alias(f"{c}__outliers"),
            F.count(c).alias(f"{c}__n"),
        ]
    rows_of = ", ".join(f"'{c}', `{c}__low`, `{c}__high`, `{c}__outliers`, `{c}__n`" for c in columns)
    stacked = fenced.groupBy("class").agg(*found).select(
        "class", F.expr(f"stack({len(columns)}, {rows_of}) AS (feature, whisker_low, whisker_high, outliers, n)")
    )
    joined = stacked.join(F.broadcast(quartiles), ["class", "feature"])
    return joined.select("class", "feature", *QUARTILES, "whisker_low", "whisker_high", "outliers", "n")


def category_counts(df: DataFrame, col: str, rare_below: int) -> DataFrame:
    """Categories after grouping the rare ones, and how many were rare."""
    sizes = df.filter(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    rare = F.count_if(F.col("n") < rare_below)
    return sizes.agg(
        (F.count_if(F.col("n") >= rare_below) + F.when(rare > 0, 1).otherwise(0)).alias("categories"),
        rare.alias("rare_categories"),
    )
