"""Event-cohort features, success labels and success scoring on Spark DataFrames."""

from cohortlens.config import CohortConfig, TrainConfig

__all__ = ["CohortConfig", "TrainConfig"]
