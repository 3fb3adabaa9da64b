"""Event sources: the date-partitioned archive and its canonical form.

Canonical event: entity_id, entity_name, event_type, actor_id, actor_login,
event_time and either ``payload`` (JSON text) or the columns that would be
extracted from it (action, size and the creation attributes).
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

RAW_EVENT_SCHEMA = (
    "repo STRUCT<id: BIGINT, name: STRING>, actor STRUCT<id: BIGINT, login: STRING>, "
    "type STRING, created_at TIMESTAMP, payload STRING, event_date DATE"
)

# Canonical column -> path in a raw archive event.
ARCHIVE_MAPPING = {
    "entity_id": "repo.id",
    "entity_name": "repo.name",
    "event_type": "type",
    "actor_id": "actor.id",
    "actor_login": "actor.login",
    "event_time": "created_at",
    "payload": "payload",
}


def read_events(
    spark: SparkSession,
    path: str,
    start: str | None = None,
    end: str | None = None,
    fmt: str = "json",
) -> DataFrame:
    """Archive events of the day shards ``start`` to ``end`` (both included).

    ``path`` holds one ``event_date=YYYY-MM-DD`` folder per day; the bounds prune folders.
    """
    events = spark.read.schema(RAW_EVENT_SCHEMA).format(fmt).load(path)
    return between_dates(events, start, end)


def write_events(events: DataFrame, path: str, files: int = 8, max_records_per_file: int = 1_000_000) -> None:
    """Raw archive events as Parquet, one ``event_date=YYYY-MM-DD`` folder per day.

    Each day is dealt over up to ``files`` tasks, so that a busy day is not one task.
    """
    dated = events.withColumn("event_date", F.to_date("created_at"))
    part = F.pmod(F.xxhash64("repo.id", "actor.id", "created_at"), F.lit(files))
    writer = dated.repartition("event_date", part).write.partitionBy("event_date")
    writer.option("maxRecordsPerFile", max_records_per_file).parquet(path)


def between_dates(
    events: DataFrame,
    start: str | None,
    end: str | None,
    day: str = "event_date",
    time: str | None = None,
) -> DataFrame:
    """Rows of a range of days: partition column ``day`` if present, else ``time``."""
    if day in events.columns:
        if start is not None:
            events = events.filter(F.col(day) >= F.lit(start).cast("date"))
        if end is not None:
            events = events.filter(F.col(day) <= F.lit(end).cast("date"))
    elif time is not None:
        if start is not None:
            events = events.filter(F.col(time) >= F.lit(start).cast("timestamp"))
        if end is not None:
            after = F.date_add(F.lit(end).cast("date"), 1).cast("timestamp")
            events = events.filter(F.col(time) < after)
    return events


def canonical_events(df: DataFrame, mapping: Mapping[str, str | Column] = ARCHIVE_MAPPING) -> DataFrame:
    """Rename and flatten source columns to the canonical event.

    A time column without zone is read in the session time zone (use UTC).
    The day partition column passes through so that later date bounds still prune.
    """
    columns = [
        (F.col(source) if isinstance(source, str) else source).alias(name)
        for name, source in mapping.items()
    ]
    if "event_date" in df.columns and "event_date" not in mapping:
        columns.append(F.col("event_date"))
    events = df.select(*columns)
    if dict(events.dtypes)["event_time"] != "timestamp":
        events = events.withColumn("event_time", F.col("event_time").cast("timestamp"))
    return events
