from cohortlens.sources.dataset import (
    DATASET_SCHEMA,
    NA_VALUES,
    profile_schema,
    read_dataset_csv,
    write_dataset,
)
from cohortlens.sources.events import RAW_EVENT_SCHEMA, canonical_events, read_events

__all__ = [
    "DATASET_SCHEMA",
    "NA_VALUES",
    "RAW_EVENT_SCHEMA",
    "canonical_events",
    "profile_schema",
    "read_dataset_csv",
    "read_events",
    "write_dataset",
]
