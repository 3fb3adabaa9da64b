"""Parameters of the cohort query and of training.

The defaults are the published values of the six-month success study: a
cohort created in the first quarter of 2024, features from days 0-30, outcomes
from days 0-180, "months 4 to 6" from day 91.
"""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class CohortConfig:
    """Windows are whole days since creation; both ends belong to the window."""

    # which events create an entity
    created: str = "create_event"  # or "first_event": an entity starts with its first event
    create_type: str = "CreateEvent"
    create_ref_type: str = "repository"
    exclude_forks: bool = False
    # one cohort row per entity; False keeps one row per attribute combination,
    # and then every event counts once per row (COUNT) but actors once (DISTINCT)
    unique: bool = True

    # event_date bounds (ISO dates, inclusive) of the two scans; None = unbounded
    cohort_dates: tuple[str, str] | None = None
    event_dates: tuple[str, str] | None = None

    # windows
    early_days: int = 30
    horizon_days: int = 180
    sustain_from: int = 91
    week_bins: tuple[tuple[int, int], ...] = ((0, 7), (8, 14), (15, 21), (22, 30))

    # floors and NULL handling
    min_events: int = 3
    null_size: str = "zero"  # or "skip": NULL sizes stay NULL in the sum

    # labels
    starred_min: int = 100
    community_min: int = 5
    success_stars: int = 50
    success_contributors: int = 3

    # the cohort is broadcast to the events up to this many (id, timestamp) rows,
    # which is at most about 64 MB; beyond it the join shuffles
    broadcast_rows: int = 1_000_000
    # an entity with more than this share of the joined events, and so many of them, is salted
    heavy_share: float = 0.001
    heavy_min_rows: int = 100_000

    def __post_init__(self):
        if self.created not in ("create_event", "first_event"):
            raise ValueError(f"created: {self.created!r}")
        if self.null_size not in ("zero", "skip"):
            raise ValueError(f"null_size: {self.null_size!r}")

    def but(self, **changes) -> "CohortConfig":
        return replace(self, **changes)


# The published scans: cohort January-March, events up to the end of the window.
COHORT_QUARTER = ("2024-01-01", "2024-03-31")
ARCHIVE = CohortConfig(
    cohort_dates=COHORT_QUARTER, event_dates=("2024-01-01", "2024-09-30")
)
# early metrics alone: shorter scan, higher floor, NULL sizes are not zero
ARCHIVE_EARLY = ARCHIVE.but(
    event_dates=("2024-01-01", "2024-04-30"), min_events=5, null_size="skip"
)
# months 4-6 alone: this report starts at day 90, the combined dataset at day 91
ARCHIVE_SUSTAINED = ARCHIVE.but(
    event_dates=("2024-04-01", "2024-09-30"), sustain_from=90, null_size="skip"
)


@dataclass(frozen=True)
class TrainConfig:
    """Training parameters; the defaults are the published settings."""

    target: str = "is_successful_project"
    key: str = "repo_id"
    rare_below: int = 100
    test_share: float = 0.2
    folds: int = 5
    seed: int = 42

    # oversampling: only when majority/minority exceeds the gate
    resample_gate: float = 1.5
    resample_ratio: float = 1.0
    neighbours: int = 5
    # True resamples once before cross-validation (folds then share synthetic rows)
    leaky_folds: bool = False

    models: tuple[str, ...] = (
        "Logistic Regression",
        "Decision Tree",
        "Random Forest",
        "Gradient Boosting",
        "Gradient Boosting (positive weight)",
        "Gradient Boosting (balanced)",
    )
    max_iter: int = 1000
    trees: int = 100
    parallelism: int = 8

    def but(self, **changes) -> "TrainConfig":
        return replace(self, **changes)
