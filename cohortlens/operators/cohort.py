"""Cohorts of newly created entities and the join to their own later events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from cohortlens.config import CohortConfig
from cohortlens.functions import day_diff, in_window, json_scalar
from cohortlens.sources.events import between_dates
from cohortlens.storage import deal, stage

# Attributes of a creation event and where its payload holds them.
PAYLOAD_ATTRIBUTES = {
    "language": ("$.repository.language", "string"),
    "description": ("$.repository.description", "string"),
    "license": ("$.repository.license.key", "string"),
    "is_fork": ("$.repository.fork", "boolean"),
}
FULL_ATTRIBUTES = ("entity_name", "language", "description", "actor_id", "actor_login")


def payload_attribute(events: DataFrame, name: str) -> Column:
    """A creation attribute: a column of its own or an extract of the payload."""
    if name in PAYLOAD_ATTRIBUTES and name not in events.columns:
        path, dtype = PAYLOAD_ATTRIBUTES[name]
        return json_scalar(F.col("payload"), path, dtype)
    return F.col(name)


def creation_events(events: DataFrame, cfg: CohortConfig) -> DataFrame:
    """Events that create an entity, within the cohort dates.

    The type is tested before the payload: the former reaches the scan.
    """
    events = between_dates(events, *(cfg.cohort_dates or (None, None)), time="event_time")
    if cfg.created == "create_event":
        events = events.filter(F.col("event_type") == cfg.create_type)
        if cfg.create_ref_type is not None:
            ref_type = F.get_json_object("payload", "$.ref_type")
            events = events.filter(ref_type == cfg.create_ref_type)
    if cfg.exclude_forks:
        events = exclude_forks(events)
    return events


def exclude_forks(events: DataFrame) -> DataFrame:
    """Drop known forks; an absent or unreadable flag counts as original."""
    return events.filter(~F.coalesce(payload_attribute(events, "is_fork"), F.lit(False)))


def new_entities(events: DataFrame, cfg: CohortConfig) -> DataFrame:
    """Distinct creation records with all attributes, forks excluded."""
    created = creation_events(events, cfg.but(exclude_forks=True))
    return created.select(
        F.col("entity_id").alias("repo_id"),
        F.col("entity_name").alias("repo_name"),
        payload_attribute(created, "language").alias("primary_language"),
        payload_attribute(created, "description").alias("description"),
        payload_attribute(created, "license").alias("license"),
        payload_attribute(created, "is_fork").alias("is_fork"),
        F.col("event_time").alias("repo_created_at"),
        F.col("actor_id").alias("creator_id"),
        F.col("actor_login").alias("creator_login"),
    ).distinct()


def cohort(
    events: DataFrame, cfg: CohortConfig, attributes: Sequence[str] = (), rows: int = 0, heavy: Sequence = ()
) -> DataFrame:
    """First-seen time per entity as ``created_at``.

    ``cfg.unique``: one row per entity with the attributes of its earliest
    creation (ties: smallest attributes). Otherwise one row per combination of
    id and attributes, each with its own earliest time.

    The attributes of the earliest creation are found by sorting. Where most events create, as with
    "first_event", give their number as ``rows`` (0: not known): they are dealt by entity over tasks of a
    bounded number, only those of the entities ``heavy`` are combined in each task before they travel.
    """
    created = creation_events(events, cfg)
    picked = created.select(
        "entity_id", "event_time", *[payload_attribute(created, a).alias(a) for a in attributes]
    )
    if not cfg.unique or not attributes:
        return picked.groupBy("entity_id", *attributes).agg(F.min("event_time").alias("created_at"))
    # a NULL id may be heavy too
    is_heavy = F.when(F.col("entity_id").isNull(), F.lit(None in heavy)).otherwise(
        F.col("entity_id").isin([e for e in heavy if e is not None])
    )
    first = _earliest(deal(picked.filter(~is_heavy) if heavy else picked, rows, "entity_id"), attributes)
    if heavy:
        first = first.unionByName(_earliest(picked.filter(is_heavy), attributes))
    return first.select(
        "entity_id",
        *[F.col(f"first.{a}").alias(a) for a in attributes],
        F.col("first.event_time").alias("created_at"),
    )


def _earliest(picked: DataFrame, attributes: Sequence[str]) -> DataFrame:
    return picked.groupBy("entity_id").agg(F.min(F.struct("event_time", *attributes)).alias("first"))


def entity_counts(events: DataFrame) -> DataFrame:
    """Staged number of events per entity: counted in each task first, so a number per id and task travels."""
    return stage(events.groupBy("entity_id").count(), "entity-counts")


def heavy_entities(events: DataFrame, cfg: CohortConfig, rows: int = 0) -> list:
    """Ids of entities holding a large share of the events (``rows``, 0: not known): at most 1/share many."""
    return _heavy(events.groupBy("entity_id").count() if rows else entity_counts(events), cfg, rows)


def _heavy(counts: DataFrame, cfg: CohortConfig, rows: int = 0) -> list:
    floor = max(cfg.heavy_min_rows, cfg.heavy_share * (rows or counts.agg(F.sum("count")).first()[0] or 0))
    top = counts.filter(F.col("count") > floor).orderBy(F.desc("count"), "entity_id").limit(int(1 / cfg.heavy_share))
    return [r["entity_id"] for r in top.collect()]


def window_dates(cohort_times: DataFrame, lo: int, hi: int) -> tuple[str | None, str | None]:
    """First and last day that can lie in the window of any entity of a staged cohort."""
    # whole days are cut towards zero, so day 0 begins a day before the creation
    start, end = F.date_add(F.min("created_at"), lo - 1), F.date_add(F.max("created_at"), hi + 1)
    row = cohort_times.agg(start.cast("string").alias("start"), end.cast("string").alias("end")).first()
    return row["start"], row["end"]


def attach_events(
    events: DataFrame,
    cohort_times: DataFrame,
    lo: int,
    hi: int,
    cfg: CohortConfig,
    strategy: str = "auto",
) -> DataFrame:
    """Each event with the creation time of its entity and ``day`` in ``[lo, hi]``.

    ``cohort_times`` has entity_id and created_at only, so that nothing wide
    travels with the events; give a staged table, since "auto" counts it:

    * "broadcast" - up to ``cfg.broadcast_rows`` rows; the events do not shuffle.
    * "shuffle" - beyond that; heavy entities are spread over all partitions by
      a salt, and only their cohort rows are repeated.
    """
    return attach_counted(events, cohort_times, lo, hi, cfg, strategy)[0]


def attach_counted(
    events: DataFrame,
    cohort_times: DataFrame,
    lo: int,
    hi: int,
    cfg: CohortConfig,
    strategy: str = "auto",
) -> tuple[DataFrame, int]:
    """As ``attach_events``, and the events that a join by shuffle dealt by entity; 0 with a broadcast or salts."""
    rows = 0
    events = between_dates(events, *(cfg.event_dates or window_dates(cohort_times, lo, hi)), time="event_time")
    if strategy == "auto":
        # of a staged table this reads file footers only
        strategy = "broadcast" if cohort_times.count() <= cfg.broadcast_rows else "shuffle"
    if strategy == "broadcast":
        joined = events.join(F.broadcast(cohort_times), "entity_id")
    elif strategy == "shuffle":
        counts = entity_counts(events)
        # only entities of the cohort can be heavy
        known = counts.join(cohort_times.select("entity_id").distinct(), "entity_id", "left_semi")
        moved = counts.agg(F.sum("count")).first()[0] or 0
        heavy = _heavy(known, cfg)
        joined, rows = _salted_join(events, cohort_times, heavy, moved), 0 if heavy else moved
    else:
        raise ValueError(f"strategy: {strategy!r}")
    day = day_diff(F.col("event_time"), F.col("created_at"))
    return joined.withColumn("day", day).filter(in_window(F.col("day"), lo, hi)), rows


def _salted_join(events: DataFrame, cohort_times: DataFrame, heavy: list, rows: int = 0) -> DataFrame:
    """Events with their cohort rows; ``rows`` (0: not known) events are dealt over tasks of a bounded number."""
    if not heavy:
        return _dealt_join(events, cohort_times, rows, "entity_id")
    salts = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    is_heavy = F.col("entity_id").isin(heavy)
    # hashed from the row, not random: a recomputed task sends the same rows
    spread = F.pmod(F.xxhash64("event_time", "actor_id", "event_type"), F.lit(salts)).cast("int")
    salted = events.withColumn("salt", F.when(is_heavy, spread).otherwise(0))
    all_salts = F.sequence(F.lit(0), F.lit(salts - 1))
    repeated = cohort_times.withColumn(
        "salt", F.explode(F.when(is_heavy, all_salts).otherwise(F.array(F.lit(0))))
    )
    return _dealt_join(salted, repeated, rows, "entity_id", "salt").drop("salt")


def _dealt_join(events: DataFrame, cohort_times: DataFrame, rows: int, *by: str) -> DataFrame:
    return deal(events, rows, *by).join(deal(cohort_times, rows, *by).hint("merge"), list(by))
