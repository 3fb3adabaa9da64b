"""Feature engineering: cleaning, categories, ratios and scaling.

Everything that is learned from data (kept categories, means, deviations) is
learned once by a ``fit_*`` function and then fixed in plain SQL expressions, so
that new rows get the same columns.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.ml import Model, PipelineModel
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StringIndexerModel, VectorAssembler
from pyspark.sql import DataFrame, SparkSession, functions as F

from cohortlens.sources.dataset import EARLY_COLUMNS

OTHER = "Other"
UNKNOWN = "Unknown"


def _ratio(numerator: str, denominator: str, fallback: str = "0") -> str:
    return (
        f"CASE WHEN {denominator} > 0 THEN ({numerator}) / CAST({denominator} AS DOUBLE) "
        f"ELSE CAST({fallback} AS DOUBLE) END"
    )


def _flag(test: str) -> str:
    return f"CASE WHEN {test} THEN 1 ELSE 0 END"


# The engineered features. The names of the two weekly ratios are
# those of the published feature list; the later week is the numerator.
ENGINEERED = {
    "commits_per_push": _ratio("total_commits_30d", "push_events_30d"),
    "events_per_contributor": _ratio("total_events_30d", "unique_contributors_30d"),
    "issue_close_rate": _ratio("issues_closed_30d", "issues_opened_30d"),
    "pr_close_rate": _ratio("prs_closed_30d", "prs_opened_30d"),
    "has_external_interest": _flag("stars_30d > 0 OR forks_30d > 0"),
    "has_issues": _flag("issues_opened_30d > 0"),
    "has_prs": _flag("prs_opened_30d > 0"),
    "has_multiple_contributors": _flag("unique_contributors_30d > 1"),
    "week1_to_week2_ratio": _ratio("events_week_2", "events_week_1"),
    "week3_to_week4_ratio": _ratio("events_week_4", "events_week_3"),
    "activity_sustainability": _ratio(
        "events_week_3 + events_week_4", "(events_week_1 + events_week_2)"
    ),
    "committer_ratio": _ratio("unique_committers_30d", "unique_contributors_30d"),
    "comments_per_issue": _ratio("issue_comments_30d", "issue_events_30d"),
    "star_fork_ratio": _ratio("stars_30d", "forks_30d", fallback="stars_30d"),
}
BINARY = (
    "has_description",
    "has_external_interest",
    "has_issues",
    "has_prs",
    "has_multiple_contributors",
)


@dataclass(frozen=True)
class FeatureLists:
    early: tuple[str, ...]
    metadata: tuple[str, ...]
    language: tuple[str, ...]
    engineered: tuple[str, ...]

    @property
    def initial(self) -> tuple[str, ...]:
        return self.early + self.metadata + self.language

    @property
    def all(self) -> tuple[str, ...]:
        return self.initial + self.engineered

    @property
    def scaled(self) -> tuple[str, ...]:
        """Features that are not 0/1."""
        fixed = {*BINARY, *self.language}
        return tuple(c for c in self.all if c not in fixed)


def feature_lists(columns: Iterable[str]) -> FeatureLists:
    """The feature sets, with the ``lang_`` names among ``columns``."""
    return FeatureLists(
        early=EARLY_COLUMNS,
        metadata=("has_description",),
        language=tuple(c for c in columns if c.startswith("lang_")),
        engineered=tuple(ENGINEERED),
    )


def clean_metadata(df: DataFrame) -> DataFrame:
    """Missing language becomes "Unknown"; ``has_description`` tells if there is one."""
    return df.withColumns(
        {
            "primary_language": F.expr(f"coalesce(primary_language, '{UNKNOWN}')"),
            "has_description": F.expr(_flag("description IS NOT NULL")),
        }
    )


def fit_categories(df: DataFrame, col: str, rare_below: int = 100) -> list[str]:
    """Sorted categories left after grouping those with fewer than ``rare_below`` rows: at most rows / rare_below.

    They become places of one sparse vector, not columns.
    """
    sizes = df.filter(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    kept = [r[0] for r in sizes.filter(F.col("n") >= rare_below).select(col).collect()]
    if not sizes.filter(F.col("n") < rare_below).isEmpty():
        kept.append(OTHER)
    return sorted(set(kept))


def _text(value: str) -> str:
    escaped = value.replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"


def grouped_sql(col: str, categories: Sequence[str]) -> str:
    """Category itself if it was kept, else "Other"."""
    listed = ", ".join(_text(c) for c in categories if c != OTHER)
    return f"CASE WHEN {col} IN ({listed}) THEN {col} ELSE '{OTHER}' END" if listed else f"'{OTHER}'"


def group_rare(df: DataFrame, col: str, categories: Sequence[str], name: str = "language_grouped") -> DataFrame:
    return df.withColumn(name, F.expr(grouped_sql(col, categories)))


def one_hot_names(categories: Sequence[str], prefix: str = "lang_") -> list[str]:
    """Names of the places of the one-hot vector: the kept categories, then "Other" if there is one."""
    return [prefix + c for c in (*(c for c in categories if c != OTHER), *([OTHER] if OTHER in categories else []))]


def one_hot_stages(spark: SparkSession, col: str, categories: Sequence[str], out: str) -> list[Model]:
    """Saveable stages that turn a category into one sparse vector; any text may be a category.

    A text that was not kept takes the place of "Other", or none if there is no such place.
    """
    kept = [c for c in categories if c != OTHER]
    if not kept:
        # a single place: everything is "Other"
        place = SQLTransformer(statement=f"SELECT *, CAST({int(OTHER in categories)} AS DOUBLE) AS `{out}_index` FROM __THIS__")
        return [place, VectorAssembler(inputCols=[f"{out}_index"], outputCol=out)]
    # labels must not be empty, texts may
    marked = SQLTransformer(statement=f"SELECT *, concat('=', `{col}`) AS `{out}_text` FROM __THIS__")
    indexer = StringIndexerModel.from_labels(
        [f"={c}" for c in kept], inputCol=f"{out}_text", outputCol=f"{out}_index", handleInvalid="keep"
    )
    # the number of places comes with the index column, so no row is needed to fit
    encoder = OneHotEncoder(inputCol=f"{out}_index", outputCol=out, dropLast=OTHER not in categories)
    none = indexer.transform(spark.createDataFrame([], f"`{out}_text` STRING"))
    return [marked, indexer, encoder.fit(none)]


def one_hot(df: DataFrame, col: str, categories: Sequence[str], out: str = "language_vector") -> DataFrame:
    """``df`` with the one-hot vector of ``col``; its places are named by ``one_hot_names``."""
    return PipelineModel(stages=one_hot_stages(df.sparkSession, col, categories, out)).transform(df)


def engineer_features(df: DataFrame) -> DataFrame:
    """The 14 ratios and flags, always finite."""
    return df.select("*", *[F.expr(finite_sql(sql)).alias(name) for name, sql in ENGINEERED.items()])


def finite_sql(sql: str) -> str:
    """NULL, NaN and infinities become 0; whole numbers keep their type."""
    if sql.endswith("THEN 1 ELSE 0 END"):
        return sql
    value = f"({sql})"
    return (
        f"CASE WHEN {value} IS NULL OR isnan({value}) OR abs({value}) = double('inf') "
        f"THEN 0D ELSE {value} END"
    )


def _filled(column: str) -> str:
    """A missing number counts as 0."""
    return f"coalesce(CAST(`{column}` AS DOUBLE), 0D)"


@dataclass(frozen=True)
class Scaler:
    """Means and population deviations per column; a constant column is divided by 1."""

    means: dict[str, float]
    deviations: dict[str, float]

    def sql(self, column: str) -> str:
        return f"({_filled(column)} - {self.means[column]!r}D) / {self.deviations[column]!r}D"

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: F.expr(self.sql(c)) for c in self.means})


def fit_scaler(train: DataFrame, columns: Sequence[str]) -> Scaler:
    """Learn means and population deviations in one aggregation."""
    aggregates = [
        F.expr(f"{f}({_filled(c)})") for c in columns for f in ("avg", "stddev_pop")
    ]
    row = train.agg(*aggregates).first()
    means, deviations = {}, {}
    for i, c in enumerate(columns):
        mean, deviation = row[2 * i], row[2 * i + 1]
        if mean is None:
            raise ValueError("cannot fit a scaler on no rows")
        means[c] = float(mean)
        deviations[c] = float(deviation) if deviation else 1.0
    return Scaler(means, deviations)
