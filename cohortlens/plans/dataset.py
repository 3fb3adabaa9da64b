"""The combined dataset: one 40-column row of features, outcomes and labels per entity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cohortlens.config import CohortConfig
from cohortlens.operators.cohort import FULL_ATTRIBUTES, attach_counted, cohort
from cohortlens.operators.metrics import (
    early_features,
    entity_metrics,
    min_activity,
    outcomes,
    with_measures,
)
from cohortlens.sources.dataset import EARLY_COLUMNS, OUTCOME_COLUMNS
from cohortlens.storage import stage


def label_columns(cfg: CohortConfig) -> dict[str, Column]:
    """The four success labels from the outcome metrics."""
    tests = {
        "is_starred_project": f"total_stars_6m >= {cfg.starred_min}",
        "has_community": f"total_contributors_6m >= {cfg.community_min}",
        "is_actively_maintained": "pushes_months_4_to_6 > 0",
        "is_successful_project": f"total_stars_6m >= {cfg.success_stars} OR "
        f"(total_contributors_6m >= {cfg.success_contributors} AND pushes_months_4_to_6 > 0)",
    }
    return {name: F.expr(f"CASE WHEN {test} THEN 1 ELSE 0 END") for name, test in tests.items()}


def combine(cohort_rows: DataFrame, metrics: DataFrame) -> DataFrame:
    """Cohort rows with their metrics, missing metrics as 0."""
    joined = cohort_rows.join(metrics, "entity_id", "left")
    return joined.selectExpr(
        "entity_id AS repo_id",
        "entity_name AS repo_name",
        "language AS primary_language",
        "description",
        "created_at AS repo_created_at",
        "actor_id AS creator_id",
        "actor_login AS creator_login",
        *[f"coalesce({c}, 0L) AS {c}" for c in EARLY_COLUMNS + OUTCOME_COLUMNS],
    )


def order_by_stars(df: DataFrame) -> DataFrame:
    """Most starred first; equal totals by id."""
    return df.orderBy(F.desc_nulls_last("total_stars_6m"), F.asc("repo_id"))


def combined_dataset(
    events: DataFrame,
    cfg: CohortConfig,
    cohort_rows: DataFrame | None = None,
    strategy: str = "auto",
    ordered: bool = True,
) -> DataFrame:
    """Cohort, early features, outcomes and labels for entities above the floor.

    Features and outcomes come from one aggregation over one scan of the events.
    ``cohort_rows`` (entity_id, the attributes, created_at) is by default taken
    from the events. It is staged: it is used twice and its size decides the join.
    """
    if cohort_rows is None:
        cohort_rows = cohort(events, cfg, FULL_ATTRIBUTES)
    cohort_rows = stage(cohort_rows, "cohort")
    metrics = early_features(cfg) + outcomes(cfg)
    attached, events_dealt = attach_counted(
        with_measures(events, metrics),
        cohort_rows.select("entity_id", "created_at"),
        0,
        cfg.horizon_days,
        cfg,
        strategy,
    )
    per_entity = entity_metrics(attached, ["entity_id"], metrics, cfg.null_size, events_dealt)
    rows = min_activity(combine(cohort_rows, per_entity), cfg.min_events)
    labelled = rows.withColumns(label_columns(cfg))
    return order_by_stars(labelled) if ordered else labelled
