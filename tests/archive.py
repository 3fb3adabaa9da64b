"""Hand-made archive events."""

import json
from datetime import datetime, timedelta

from cohortlens.sources.events import RAW_EVENT_SCHEMA, canonical_events

BORN = datetime(2024, 1, 10, 12, 0, 0)
DAY = timedelta(days=1)


def event(repo, kind, at, actor=1, name=None, **payload):
    """One raw event; ``at`` is a timedelta after BORN."""
    text = payload.pop("text", None) or json.dumps(payload)
    time = BORN + at
    login = None if actor is None else f"actor{actor}"
    return ((repo, name or f"repo{repo}"), (actor, login), kind, time, text, time.date())


def creation(repo, at=timedelta(0), actor=1, name=None, ref_type="repository", **repository):
    return event(repo, "CreateEvent", at, actor, name, ref_type=ref_type, repository=repository)


def canonical(spark, rows):
    return canonical_events(spark.createDataFrame(rows, RAW_EVENT_SCHEMA))


def rows_by(df, *keys):
    return {tuple(r[k] for k in keys) if len(keys) > 1 else r[keys[0]]: r for r in df.collect()}
