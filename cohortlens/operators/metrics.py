"""Windowed metrics per entity in one pass over the attached events.

A bundle is a list of ``Metric``s. Every event falls into one *cell*: a kind of
event (type, and action where some metric asks for it) within one of the day
bands that the metric windows cut. The events are first combined per (entity,
actor, cell) into a count and a size sum - narrow rows, combined before the
shuffle, so that neither a busy entity nor a busy (entity, actor) pair ends up in
one task. From these the entity row is built: counts from the cells, distinct
actors from one bit set per (entity, actor). Distinct counts are exact and no row
is copied per metric, as several COUNT(DISTINCT ..) would do.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from cohortlens.config import CohortConfig
from cohortlens.operators.cohort import attach_counted
from cohortlens.storage import deal, stage

PUSH = "PushEvent"
ISSUES = "IssuesEvent"
ISSUE_COMMENT = "IssueCommentEvent"
PULL_REQUEST = "PullRequestEvent"
REVIEW = "PullRequestReviewEvent"
REVIEW_COMMENT = "PullRequestReviewCommentEvent"
STAR = "WatchEvent"
FORK = "ForkEvent"
RELEASE = "ReleaseEvent"


@dataclass(frozen=True)
class Metric:
    """``kind`` over events of ``types`` (None: all), ``action`` and day window."""

    name: str
    kind: str  # "count", "size" (sum of payload sizes), "actors" (distinct)
    types: tuple[str, ...] | None = None
    action: str | None = None
    window: tuple[int | None, int | None] | None = None

    def covers_kind(self, kind: tuple[str | None, str | None]) -> bool:
        event_type, action = kind
        return (self.types is None or event_type in self.types) and self.action in (None, action)

    def covers_band(self, band: tuple[int | None, int | None]) -> bool:
        lo, hi = self.window or (None, None)
        return (lo is None or (band[0] is not None and band[0] >= lo)) and (
            hi is None or (band[1] is not None and band[1] <= hi)
        )


def count_of(name, *types, action=None, window=None):
    return Metric(name, "count", types or None, action, window)


def size_of(name, *types, window=None):
    return Metric(name, "size", types, None, window)


def actors_of(name, *types, window=None):
    return Metric(name, "actors", types or None, None, window)


def early_report(cfg: CohortConfig) -> list[Metric]:
    """Stand-alone report on the early window (attached with days 0..early)."""
    weeks = ("events_first_week", "events_second_week", "events_third_week", "events_fourth_week")
    return [
        count_of("push_events_30d", PUSH),
        size_of("total_commits_30d", PUSH),
        count_of("issue_events_30d", ISSUES),
        count_of("issues_opened_30d", ISSUES, action="opened"),
        count_of("issues_closed_30d", ISSUES, action="closed"),
        count_of("issue_comments_30d", ISSUE_COMMENT),
        count_of("pr_events_30d", PULL_REQUEST),
        count_of("prs_opened_30d", PULL_REQUEST, action="opened"),
        count_of("prs_closed_30d", PULL_REQUEST, action="closed"),
        count_of("pr_reviews_30d", REVIEW),
        count_of("pr_review_comments_30d", REVIEW_COMMENT),
        count_of("stars_30d", STAR),
        count_of("forks_30d", FORK),
        actors_of("unique_contributors_30d"),
        actors_of("unique_committers_30d", PUSH),
        actors_of("unique_issue_participants_30d", ISSUES, ISSUE_COMMENT),
        count_of("total_events_30d"),
        *[count_of(name, window=bounds) for name, bounds in zip(weeks, cfg.week_bins)],
    ]


def sustained_report(cfg: CohortConfig) -> list[Metric]:
    """Stand-alone report on months 4-6 (attached with days sustain_from..horizon)."""
    return [
        count_of("stars_months_4_to_6", STAR),
        count_of("forks_months_4_to_6", FORK),
        count_of("push_events_months_4_to_6", PUSH),
        size_of("commits_months_4_to_6", PUSH),
        count_of("issue_events_months_4_to_6", ISSUES),
        count_of("pr_events_months_4_to_6", PULL_REQUEST),
        count_of("external_prs_months_4_to_6", PULL_REQUEST, action="opened"),
        actors_of("unique_contributors_months_4_to_6"),
        actors_of("unique_committers_months_4_to_6", PUSH),
        count_of("total_events_months_4_to_6"),
        count_of("releases_months_4_to_6", RELEASE),
    ]


def cumulative_report(cfg: CohortConfig) -> list[Metric]:
    """Totals over the whole horizon."""
    return [
        count_of("total_stars_6_months", STAR),
        count_of("total_forks_6_months", FORK),
        actors_of("total_unique_committers_6_months", PUSH),
        actors_of("total_unique_contributors_6_months"),
    ]


def early_features(cfg: CohortConfig) -> list[Metric]:
    """Early features of the combined dataset (attached with days 0..horizon)."""
    early = (None, cfg.early_days)
    weeks = ("events_week_1", "events_week_2", "events_week_3", "events_week_4")
    return [
        count_of("push_events_30d", PUSH, window=early),
        size_of("total_commits_30d", PUSH, window=early),
        count_of("issue_events_30d", ISSUES, window=early),
        count_of("issues_opened_30d", ISSUES, action="opened", window=early),
        count_of("issues_closed_30d", ISSUES, action="closed", window=early),
        count_of("issue_comments_30d", ISSUE_COMMENT, window=early),
        count_of("pr_events_30d", PULL_REQUEST, window=early),
        count_of("prs_opened_30d", PULL_REQUEST, action="opened", window=early),
        count_of("prs_closed_30d", PULL_REQUEST, action="closed", window=early),
        count_of("pr_reviews_30d", REVIEW, window=early),
        count_of("stars_30d", STAR, window=early),
        count_of("forks_30d", FORK, window=early),
        actors_of("unique_contributors_30d", window=early),
        actors_of("unique_committers_30d", PUSH, window=early),
        *[count_of(name, window=bounds) for name, bounds in zip(weeks, cfg.week_bins)],
        count_of("total_events_30d", window=early),
    ]


def outcomes(cfg: CohortConfig) -> list[Metric]:
    """Outcome metrics of the combined dataset (attached with days 0..horizon)."""
    late = (cfg.sustain_from, None)
    return [
        count_of("total_stars_6m", STAR),
        count_of("total_forks_6m", FORK),
        actors_of("total_contributors_6m"),
        actors_of("total_committers_6m", PUSH),
        count_of("pushes_months_4_to_6", PUSH, window=late),
        count_of("issues_months_4_to_6", ISSUES, window=late),
        count_of("prs_months_4_to_6", PULL_REQUEST, window=late),
        actors_of("contributors_months_4_to_6", window=late),
        count_of("total_releases_6m", RELEASE),
        count_of("total_events_6m"),
    ]


def with_measures(events: DataFrame, metrics: Sequence[Metric], strict: bool = False) -> DataFrame:
    """Add ``action`` and ``size`` from the payload where the metrics need them.

    Each is read once per event and only for the event types that use it; the
    payload itself is then no longer needed and is pruned before any shuffle.
    """
    if "payload" not in events.columns:
        return events
    wanted = {
        "action": {t for m in metrics if m.action is not None for t in m.types},
        "size": {t for m in metrics if m.kind == "size" for t in m.types},
    }
    for column, types in wanted.items():
        if not types or column in events.columns:
            continue
        value = F.get_json_object("payload", f"$.{column}")
        if column == "size":
            value = value.cast("bigint") if strict else value.try_cast("bigint")
        is_used = F.col("event_type").isin(*sorted(types))
        events = events.withColumn(column, F.when(is_used, value))
    return events.drop("payload")


class Cells:
    """The cells cut by a bundle of metrics, numbered band by band."""

    def __init__(self, metrics: Sequence[Metric]):
        actions: dict[str, set[str]] = {}
        cuts = set()
        for m in metrics:
            for event_type in m.types or ():
                actions.setdefault(event_type, set()).update({m.action} - {None})
            if m.window is not None:
                lo, hi = m.window
                cuts.update({lo} - {None})
                cuts.update({hi + 1} if hi is not None else ())
        # a kind is (type, action); None is "any other"
        self.kinds = [(t, a) for t in sorted(actions) for a in [*sorted(actions[t]), None]]
        self.kinds.append((None, None))
        # band i holds the days from starts[i] on, up to the next start
        starts = [None, *sorted(cuts)]
        ends = [cut - 1 for cut in sorted(cuts)] + [None]
        self.bands = list(zip(starts, ends))

    def column(self) -> Column:
        """Cell number of an event."""
        kinds = []
        for i, (event_type, action) in enumerate(self.kinds[:-1]):
            action_test = f" AND action = '{action}'" if action is not None else ""
            kinds.append(f"WHEN event_type = '{event_type}'{action_test} THEN {i}")
        bands = [f"WHEN day <= {end} THEN {i}" for i, (_, end) in enumerate(self.bands[:-1])]
        kind, band = _case(kinds, len(self.kinds) - 1), _case(bands, len(self.bands) - 1)
        return F.expr(f"{band} * {len(self.kinds)} + {kind}")

    def decoded(self, df: DataFrame) -> DataFrame:
        """Replace ``cell`` by the numbers of its kind and band."""
        n = len(self.kinds)
        kind, band = F.expr(f"cell % {n}"), F.expr(f"CAST(cell DIV {n} AS INT)")
        return df.withColumns({"kind": kind, "band": band}).drop("cell")

    def test(self, metric: Metric) -> str:
        """SQL test of a metric on kind and band."""
        tests = []
        kinds = [i for i, kind in enumerate(self.kinds) if metric.covers_kind(kind)]
        if len(kinds) < len(self.kinds):
            tests.append(f"kind IN ({', '.join(map(str, kinds))})")
        bands = [i for i, band in enumerate(self.bands) if metric.covers_band(band)]
        if bands[0] > 0:
            tests.append(f"band >= {bands[0]}")
        if bands[-1] < len(self.bands) - 1:
            tests.append(f"band <= {bands[-1]}")
        return " AND ".join(tests or ["kind IS NOT NULL"])


def _case(branches: Sequence[str], otherwise: int) -> str:
    return f"CASE {' '.join(branches)} ELSE {otherwise} END" if branches else str(otherwise)


def entity_metrics(
    attached: DataFrame, keys: Sequence[str], metrics: Sequence[Metric], null_size: str = "zero", rows: int = 0
) -> DataFrame:
    """Aggregate attached events per ``keys`` (see the module text).

    ``rows`` is the number of events that a join dealt by the first key (see ``attach_counted``).
    """
    cells = Cells(metrics)
    actor_metrics = [m for m in metrics if m.kind == "actors"]

    tallies = {"events": "count(1)"}
    if any(m.kind == "size" for m in metrics):
        size = "coalesce(size, 0)" if null_size == "zero" else "size"
        tallies["sizes"] = f"sum(CAST({size} AS BIGINT))"
    by_cell = (
        attached.withColumn("cell", cells.column())
        .groupBy(*keys, "actor_id", "cell")
        .agg(*[F.expr(tally).alias(name) for name, tally in tallies.items()])
    )
    by_cell = cells.decoded(by_cell)
    if rows:
        # such a join needs no further shuffle: without this one, join and both branches below would be one task
        by_cell = deal(by_cell, rows // 2, keys[0])

    bits = [f"CASE WHEN {cells.test(m)} THEN {1 << i} ELSE 0 END" for i, m in enumerate(actor_metrics)]
    # A NULL actor has events but is no actor. The tests on the tallies hold for
    # every row; they keep the columns, and so the shuffle, of both branches equal.
    tallied = " OR ".join(f"{name} > 0" for name in tallies)
    counted = f"actor_id IS NOT NULL AND ({tallied})"
    by_actor = by_cell.groupBy(*keys, "actor_id").agg(
        F.expr(f"bit_or(CASE WHEN {counted} THEN {' + '.join(bits or ['0'])} ELSE 0 END)").alias("actor_bits")
    )
    cell_rows = by_cell.select(*keys, "kind", "band", *tallies, F.lit(0).alias("actor_bits")).unionByName(
        by_actor.select(*keys, "actor_bits"), allowMissingColumns=True
    )

    results = []
    for m in metrics:
        # rows of by_actor have no kind: they count nowhere and add no 0 to a NULL sum
        if m.kind == "count":
            total = f"sum(CASE WHEN {cells.test(m)} THEN events ELSE 0 END)"
        elif m.kind == "size":
            total = f"sum(CASE WHEN {cells.test(m)} THEN sizes WHEN kind IS NOT NULL THEN 0 END)"
        elif m.kind == "actors":
            total = f"count_if((actor_bits & {1 << actor_metrics.index(m)}) > 0)"
        else:
            raise ValueError(f"kind: {m.kind!r}")
        results.append(f"'{m.name}', {total}")
    # one struct, flattened at once: a single expression to hand over instead of dozens
    metrics_row = F.expr(f"named_struct({', '.join(results)})").alias("metrics")
    return cell_rows.groupBy(*keys).agg(metrics_row).select(*keys, "metrics.*")


def early_metrics(events: DataFrame, cohort_rows: DataFrame, cfg: CohortConfig, strategy: str = "auto") -> DataFrame:
    """Early report per entity, event name and creation time, with the activity floor.

    A renamed entity has one row per name of its events.
    """
    metrics = early_report(cfg)
    attached, rows = attach_counted(
        with_measures(events, metrics),
        cohort_rows.select("entity_id", "created_at"),
        0,
        cfg.early_days,
        cfg,
        strategy,
    )
    keys = ["entity_id", "entity_name", "created_at"]
    result = entity_metrics(attached, keys, metrics, cfg.null_size, rows)
    return min_activity(_named(result), cfg.min_events)


def sustained_metrics(events: DataFrame, cohort_rows: DataFrame, cfg: CohortConfig, strategy: str = "auto") -> DataFrame:
    """Months 4-6 report per entity, event name and creation time."""
    metrics = sustained_report(cfg)
    attached, rows = attach_counted(
        with_measures(events, metrics),
        cohort_rows.select("entity_id", "created_at"),
        cfg.sustain_from,
        cfg.horizon_days,
        cfg,
        strategy,
    )
    keys = ["entity_id", "entity_name", "created_at"]
    return _named(entity_metrics(attached, keys, metrics, cfg.null_size, rows))


def cohort_totals(events: DataFrame, cohort_rows: DataFrame, cfg: CohortConfig, strategy: str = "auto") -> DataFrame:
    """Cumulative totals for every cohort row, 0 for entities without events.

    Aggregates first and joins the totals to the cohort, which equals the outer
    join of cohort and events on id and window, without outer-joining raw events.
    """
    metrics = cumulative_report(cfg)
    attached, rows = attach_counted(
        with_measures(events, metrics),
        stage(cohort_rows.select("entity_id", "created_at").distinct(), "cohort-times"),
        0,
        cfg.horizon_days,
        cfg,
        strategy,
    )
    keys = ["entity_id", "created_at"]
    totals = entity_metrics(attached, keys, metrics, rows=rows)
    names = [m.name for m in metrics]
    return _named(cohort_rows.join(totals, keys, "left").fillna(0, subset=names))


def min_activity(df: DataFrame, floor: int, column: str = "total_events_30d") -> DataFrame:
    """Rows with at least ``floor`` events; a missing count is 0."""
    return df.filter(F.coalesce(F.col(column), F.lit(0)) >= floor)


def _named(df: DataFrame) -> DataFrame:
    names = {"entity_id": "repo_id", "entity_name": "repo_name", "created_at": "repo_created_at"}
    return df.withColumnsRenamed(names)
