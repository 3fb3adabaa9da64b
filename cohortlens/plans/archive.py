"""The five published reports over an event archive, with their own dates and thresholds.

``events`` are canonical events (see ``sources.events``); pass another
configuration for other periods, windows or floors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from cohortlens.config import ARCHIVE, ARCHIVE_EARLY, ARCHIVE_SUSTAINED, CohortConfig
from cohortlens.operators import metrics as M
from cohortlens.operators.cohort import cohort, new_entities
from cohortlens.plans import dataset
from cohortlens.storage import stage


def new_repositories(events: DataFrame, cfg: CohortConfig = ARCHIVE) -> DataFrame:
    """Creation records of the quarter with their attributes, without forks."""
    return new_entities(events, cfg)


def _named_cohort(events: DataFrame, cfg: CohortConfig) -> DataFrame:
    """First-seen time per id and name; staged, as its size decides the join."""
    return stage(cohort(events, cfg.but(unique=False), ["entity_name"]), "cohort")


def early_activity(events: DataFrame, cfg: CohortConfig = ARCHIVE_EARLY) -> DataFrame:
    """First 30 days of activity of entities with at least 5 events."""
    return M.early_metrics(events, _named_cohort(events, cfg), cfg)


def sustained_activity(events: DataFrame, cfg: CohortConfig = ARCHIVE_SUSTAINED) -> DataFrame:
    """Activity in months 4 to 6."""
    return M.sustained_metrics(events, _named_cohort(events, cfg), cfg)


def cumulative_totals(events: DataFrame, cfg: CohortConfig = ARCHIVE) -> DataFrame:
    """Six-month totals of every entity of the quarter."""
    return M.cohort_totals(events, _named_cohort(events, cfg), cfg)


def combined_dataset(events: DataFrame, cfg: CohortConfig = ARCHIVE, faithful: bool = False) -> DataFrame:
    """The 40-column dataset.

    ``faithful`` keeps one row per creation record, as the published SQL does: an
    entity created twice under different attributes then has two rows and its
    event counts double. The default has one row per entity.
    """
    return dataset.combined_dataset(events, cfg.but(unique=False) if faithful else cfg)
