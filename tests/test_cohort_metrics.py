from datetime import timedelta

import pytest
from archive import BORN, DAY, canonical, creation, event, rows_by
from pyspark.sql import functions as F

from cohortlens.config import ARCHIVE, CohortConfig
from cohortlens.operators import cohort as C
from cohortlens.operators import metrics as M
from cohortlens.plans import archive
from cohortlens.plans.dataset import combined_dataset
from cohortlens.sources import tables
from cohortlens.sources.events import RAW_EVENT_SCHEMA
from cohortlens.sources.dataset import EARLY_COLUMNS, OUTCOME_COLUMNS

CFG = CohortConfig(min_events=0)
HOUR = timedelta(hours=1)
SECOND = timedelta(seconds=1)


def combined(spark, rows, cfg=CFG, **options):
    return rows_by(combined_dataset(canonical(spark, rows), cfg, **options), "repo_id")


def test_events_before_creation(spark):
    row = combined(spark, [creation(1), event(1, "PushEvent", -23 * HOUR), event(1, "PushEvent", -25 * HOUR)])[1]
    assert (row.push_events_30d, row.events_week_1, row.total_events_30d) == (1, 2, 2)


def test_window_edges(spark):
    last = DAY - SECOND
    days = [30 * DAY + last, 31 * DAY, 90 * DAY, 91 * DAY, 180 * DAY + last, 181 * DAY]
    row = combined(spark, [creation(1), *[event(1, "PushEvent", d) for d in days]])[1]
    assert row.push_events_30d == 1
    assert row.pushes_months_4_to_6 == 2  # days 91 and 180
    assert row.total_events_6m == 6  # the creation and days 30, 31, 90, 91, 180


def test_stand_alone_sustained_report_starts_at_day_90(spark):
    rows = [creation(1), *[event(1, "PushEvent", d * DAY, size=2) for d in (89, 90, 91, 180, 181)]]
    events = canonical(spark, rows)
    cfg = CFG.but(sustain_from=90, unique=False)
    got = M.sustained_metrics(events, C.cohort(events, cfg, ["entity_name"]), cfg).collect()
    assert [(r.push_events_months_4_to_6, r.commits_months_4_to_6) for r in got] == [(3, 6)]


def test_week_edges(spark):
    rows = [creation(1), *[event(1, "PushEvent", d * DAY) for d in (7, 8, 14, 15, 21, 22, 30)]]
    row = combined(spark, rows)[1]
    weeks = [row[f"events_week_{i}"] for i in (1, 2, 3, 4)]
    assert weeks == [2, 2, 2, 2] and sum(weeks) == row.total_events_30d


def test_activity_floor(spark):
    rows = [creation(repo) for repo in (2, 3, 4, 5)]
    rows += [event(repo, "PushEvent", DAY) for repo in (2, 3, 4, 5) for _ in range(repo - 1)]
    assert set(combined(spark, rows, CohortConfig())) == {3, 4, 5}
    events = canonical(spark, rows)
    cfg = CohortConfig(min_events=5, unique=False)
    early = M.early_metrics(events, C.cohort(events, cfg, ["entity_name"]), cfg)
    assert set(rows_by(early, "repo_id")) == {5}


def test_null_sizes(spark):
    rows = [
        creation(1, name="old"),
        event(1, "PushEvent", DAY, name="old", size=4),
        event(1, "PushEvent", DAY, name="old"),
        event(1, "PushEvent", DAY, name="only", actor=2),
        event(1, "PushEvent", DAY, name="only", actor=3, size="3.0"),
        event(1, "PushEvent", DAY, name="mixed", actor=4),
        event(1, "WatchEvent", DAY, name="mixed", actor=5),
    ]
    events = canonical(spark, rows)
    for policy, want in (("skip", {"old": 4, "only": None, "mixed": 0}), ("zero", {"old": 4, "only": 0, "mixed": 0})):
        cfg = CFG.but(unique=False, null_size=policy)
        early = M.early_metrics(events, C.cohort(events, cfg, ["entity_name"]), cfg)
        assert {r.repo_name: r.total_commits_30d for r in early.collect()} == want


def test_totals_keep_entities_without_events(spark):
    created = canonical(spark, [creation(1), creation(2)])
    events = canonical(spark, [event(2, "WatchEvent", DAY), event(2, "ForkEvent", 200 * DAY)])
    cfg = CFG.but(unique=False)
    got = rows_by(M.cohort_totals(events, C.cohort(created, cfg, ["entity_name"]), cfg), "repo_id")
    assert tuple(got[1])[3:] == (0, 0, 0, 0) and tuple(got[2])[3:] == (1, 0, 0, 1)


def test_rename_splits_reports_but_not_the_dataset(spark):
    rows = [
        creation(1, name="old"),
        creation(1, at=2 * DAY, name="new"),
        event(1, "PushEvent", DAY, name="old", actor=7),
        event(1, "PushEvent", 3 * DAY, name="new", actor=7),
    ]
    events = canonical(spark, rows)
    pairs = CFG.but(unique=False)
    early = M.early_metrics(events, C.cohort(events, pairs, ["entity_name"]), pairs)
    got = rows_by(early, "repo_name", "repo_created_at")
    assert set(got) == {(n, BORN + d) for n in ("old", "new") for d in (timedelta(0), 2 * DAY)} - {
        ("old", BORN + 2 * DAY)
    }
    assert got["old", BORN].push_events_30d == 1 and got["new", BORN].push_events_30d == 1
    one = combined(spark, rows)[1]
    assert (one.repo_name, one.push_events_30d, one.unique_contributors_30d) == ("old", 2, 2)
    # one row per creation, counts doubled where both windows see the event, actors not
    both = combined_dataset(events, pairs).collect()
    assert len(both) == 2 and {r.push_events_30d for r in both} == {3}
    assert {r.unique_committers_30d for r in both} == {1}


def test_forks_are_excluded_only_in_the_extract(spark):
    rows = [creation(1, fork=True), creation(2, fork=False), creation(3), creation(4, ref_type="branch")]
    events = canonical(spark, rows)
    assert set(rows_by(C.new_entities(events, CFG), "repo_id")) == {2, 3}
    assert set(rows_by(C.cohort(events, CFG), "entity_id")) == {1, 2, 3}


def test_attributes_come_from_the_first_creation(spark):
    license = {"key": "mit"}
    rows = [
        creation(1, at=DAY, language="Go", description="late"),
        creation(1, language="C", description="{odd", license=license, actor=9),
        creation(2, language={"not": "scalar"}),
    ]
    got = rows_by(C.cohort(canonical(spark, rows), CFG, C.FULL_ATTRIBUTES), "entity_id")
    assert (got[1].language, got[1].description, got[1].actor_id) == ("C", "{odd", 9)
    assert got[2].language is None and got[1].created_at == BORN
    extract = rows_by(C.new_entities(canonical(spark, rows), CFG), "repo_id", "license")
    assert (1, "mit") in extract


def test_actors(spark):
    rows = [
        creation(1, actor=1),
        event(1, "PushEvent", DAY, actor=1),
        event(1, "IssueCommentEvent", DAY, actor=1),
        event(1, "IssueCommentEvent", DAY, actor=2),
        event(1, "IssuesEvent", DAY, actor=3, action="opened"),
        event(1, "PushEvent", DAY, actor=None),
    ]
    events = canonical(spark, rows)
    cfg = CFG.but(unique=False)
    early = M.early_metrics(events, C.cohort(events, cfg, ["entity_name"]), cfg).first()
    assert early.unique_contributors_30d == 3 and early.unique_committers_30d == 1
    assert early.unique_issue_participants_30d == 3 and early.total_events_30d == 6
    assert early.issues_opened_30d == 1 and early.issues_closed_30d == 0


def test_labels(spark):
    def stars(repo, n):
        return [event(repo, "WatchEvent", 40 * DAY, actor=100) for _ in range(n)]

    rows = [creation(r) for r in (1, 2, 3, 4)] + stars(1, 100) + stars(2, 50) + stars(3, 49)
    rows += [event(4, "PushEvent", 100 * DAY, actor=a) for a in (1, 2, 3, 4, 5)]
    rows += [event(3, "PushEvent", 100 * DAY, actor=1)]
    got = combined(spark, rows)
    labels = {r: tuple(got[r])[-4:] for r in got}
    assert labels == {1: (1, 0, 0, 1), 2: (0, 0, 0, 1), 3: (0, 0, 1, 0), 4: (0, 1, 1, 1)}


def test_order_and_columns(spark):
    rows = [creation(r) for r in (3, 1, 2)] + [event(2, "WatchEvent", DAY)]
    df = combined_dataset(canonical(spark, rows), CFG)
    assert [r.repo_id for r in df.collect()] == [2, 1, 3]
    assert len(df.columns) == 40 and tuple(df.columns[7:36]) == EARLY_COLUMNS + OUTCOME_COLUMNS


def test_cohort_and_event_dates(spark):
    rows = [creation(1), creation(2, at=100 * DAY), event(1, "WatchEvent", 30 * DAY), event(1, "WatchEvent", 300 * DAY)]
    got = combined(spark, rows, ARCHIVE.but(min_events=0))
    assert set(got) == {1} and got[1].total_stars_6m == 1


def busy_events(spark):
    """One entity has most events, one of its actors most of those."""
    df = spark.range(6000).selectExpr(
        "CASE WHEN id % 10 < 7 THEN 1 ELSE id % 37 END AS entity_id",
        "'n' AS entity_name",
        "element_at(array('CreateEvent','PushEvent','WatchEvent','IssuesEvent','ForkEvent'), "
        "CAST(pmod(hash(id), 5) + 1 AS INT)) AS event_type",
        "CASE WHEN id % 2 = 0 THEN 5 WHEN id % 97 = 0 THEN NULL ELSE id % 41 END AS actor_id",
        "'x' AS actor_login",
        "timestamp_seconds(1700000000 + pmod(hash(id, 1), 86400 * 200)) AS event_time",
        "to_json(named_struct('ref_type', 'repository', 'size', id % 5, "
        "'action', IF(id % 3 = 0, 'opened', 'closed'))) AS payload",
    )
    return df


def naive(attached, metrics):
    """Every metric as its own aggregate, distinct actors by COUNT(DISTINCT ..)."""
    results = []
    for m in metrics:
        lo, hi = m.window or (None, None)
        test = F.lit(True)
        if m.types:
            test &= F.col("event_type").isin(*m.types)
        if m.action:
            test &= F.coalesce(F.col("action") == m.action, F.lit(False))
        if lo is not None:
            test &= F.col("day") >= lo
        if hi is not None:
            test &= F.col("day") <= hi
        kinds = {
            "count": lambda: F.count_if(test),
            "size": lambda: F.sum(F.when(test, F.coalesce("size", F.lit(0))).otherwise(0)),
            "actors": lambda: F.count_distinct(F.when(test, F.col("actor_id"))),
        }
        results.append(kinds[m.kind]().alias(m.name))
    return attached.groupBy("entity_id").agg(*results)


def test_cells_equal_naive_aggregates(spark):
    events = busy_events(spark)
    metrics = M.early_features(CFG) + M.outcomes(CFG)
    cohort_rows = C.cohort(events, CFG)
    attached = C.attach_events(M.with_measures(events, metrics), cohort_rows, 0, 180, CFG, "broadcast")
    got = {tuple(r) for r in M.entity_metrics(attached, ["entity_id"], metrics).collect()}
    assert got == {tuple(r) for r in naive(attached, metrics).collect()} and len(got) == 37


def test_one_scan_serves_both_branches(spark):
    events = busy_events(spark)
    metrics = M.early_features(CFG) + M.outcomes(CFG)
    attached = C.attach_events(M.with_measures(events, metrics), C.cohort(events, CFG), 0, 180, CFG, "broadcast")
    cached = M.entity_metrics(attached, ["entity_id"], metrics).persist()
    cached.count()
    plan = cached._jdf.queryExecution().executedPlan().toString()
    cached.unpersist()
    assert "ReusedExchange" in plan.split("Initial Plan")[0]
    assert "Expand" not in plan


@pytest.mark.parametrize("strategy", ["shuffle", "broadcast"])
def test_join_strategies_agree(spark, strategy):
    cfg = CFG.but(heavy_share=0.05, heavy_min_rows=10)
    events = busy_events(spark)
    assert C.heavy_entities(events, cfg) == [1]
    want = combined_dataset(events, cfg, strategy="auto").collect()
    assert combined_dataset(events, cfg, strategy=strategy).collect() == want


def test_heavy_entity_is_spread(spark):
    events = busy_events(spark).select("entity_id", "event_type", "actor_id", "event_time")
    cohort_rows = C.cohort(busy_events(spark), CFG)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = C._salted_join(events, cohort_rows, [1])
        sizes = joined.filter("entity_id = 1").groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(sizes) >= 4 and joined.count() == 6000


def test_published_reports(spark):
    """Their scans have fixed ends, which cut windows that reach beyond them."""
    end_of_march = timedelta(days=81)  # 2024-03-31
    rows = [creation(1), creation(2, at=end_of_march, fork=True)]
    rows += [event(1, "PushEvent", d * DAY, size=1) for d in (1, 2, 3, 4, 89, 90, 180)]
    rows += [event(2, "PushEvent", end_of_march + d * DAY, size=1) for d in (1, 2, 3, 29)]
    # day 30 of the second entity, but already on the first of May
    rows += [event(2, "PushEvent", end_of_march + 30 * DAY + 13 * HOUR, size=1) for _ in range(2)]
    events = canonical(spark, rows)
    assert set(rows_by(archive.new_repositories(events), "repo_id")) == {1}
    early = rows_by(archive.early_activity(events), "repo_id")
    assert early[1].push_events_30d == 4 and early[2].total_events_30d == 5  # May is not scanned
    assert rows_by(archive.sustained_activity(events), "repo_id")[1].push_events_months_4_to_6 == 2
    assert set(rows_by(archive.cumulative_totals(events), "repo_id")) == {1, 2}
    combined = rows_by(archive.combined_dataset(events), "repo_id")
    assert combined[1].pushes_months_4_to_6 == 1 and combined[2].total_events_30d == 7
    assert archive.combined_dataset(events, faithful=True).count() == 2


def test_command_line_builds_the_dataset(spark, tmp_path):
    from cohortlens.__main__ import main

    raw = spark.createDataFrame([creation(1), *[event(1, "WatchEvent", d * DAY, actor=d) for d in (1, 2, 40)]], RAW_EVENT_SCHEMA)
    raw.write.partitionBy("event_date").parquet(str(tmp_path / "archive"))
    main(["dataset", "--events", str(tmp_path / "archive"), "--events-format", "parquet", "-o", str(tmp_path / "out")])
    row = spark.read.parquet(str(tmp_path / "out")).first()
    assert (row.repo_id, row.stars_30d, row.total_stars_6m, row.total_events_30d) == (1, 2, 3, 3)


def test_tasks_of_a_shuffled_join_hold_a_bounded_number_of_events(spark, monkeypatch):
    events = busy_events(spark)
    want = sorted(combined_dataset(events, CFG, strategy="broadcast").collect())
    n = events.count()
    monkeypatch.setattr("cohortlens.storage.TASK_ROWS", n // 40)
    times = C.cohort(events, CFG).select("entity_id", "created_at")
    attached, rows = C.attach_counted(events, times, 0, 180, CFG, "shuffle")
    assert rows == n and attached.rdd.getNumPartitions() >= 40
    per_entity = M.entity_metrics(attached, ["entity_id"], M.outcomes(CFG), rows=rows)
    assert per_entity.rdd.getNumPartitions() >= 20
    assert sorted(combined_dataset(events, CFG, strategy="shuffle").collect()) == want


def test_first_events_of_heavy_entities_are_combined_before_they_travel(spark):
    events = busy_events(spark).select(F.expr("nullif(entity_id, 2)").alias("entity_id"), "event_time", "actor_id")
    cfg = CFG.but(created="first_event")
    want = sorted(C.cohort(events, cfg, ["actor_id"]).collect(), key=str)
    for heavy in ([], [1], [None], [1, None, 3]):
        assert sorted(C.cohort(events, cfg, ["actor_id"], 10**9, heavy).collect(), key=str) == want, heavy


def test_tasks_of_the_part_cohort_hold_a_bounded_number_of_lines(spark, monkeypatch, tmp_path):
    n = 2000  # half of the lines are of one part, some of no part, two of each order
    made = {
        "lineitem": spark.range(n).selectExpr(
            "id div 2 AS l_orderkey", "CASE WHEN id % 2 = 0 THEN 1L WHEN id % 49 > 0 THEN id % 97 END AS l_partkey",
            "id AS l_suppkey", "CAST(id % 2 + 1 AS INT) AS l_linenumber", "1D AS l_quantity", "1D AS l_extendedprice",
            "0D AS l_discount", "0D AS l_tax", "'N' AS l_returnflag", "'O' AS l_linestatus",
            "TIMESTAMP_NTZ '1995-01-01' + make_dt_interval(CAST(id % 31 AS INT)) AS l_shipdate",
        ),
        "orders": spark.range(n // 2).selectExpr(
            "id AS o_orderkey", "id % 13 AS o_custkey", "'O' AS o_orderstatus", "1D AS o_totalprice",
            "TIMESTAMP_NTZ '1995-01-01' AS o_orderdate", "'1' AS o_orderpriority",
        ),
        "part": spark.range(97).selectExpr(
            "id AS p_partkey", "'n' AS p_name", "'b' AS p_brand", "'t' AS p_type", "1 AS p_size", "1D AS p_retailprice"
        ),
    }
    for name, rows in made.items():
        rows.write.parquet(f"{tmp_path}/{name}.parquet")
    want = sorted(tables.part_cohort(spark, str(tmp_path)).collect())
    assert len(want) == 97
    monkeypatch.setattr("cohortlens.storage.TASK_ROWS", n // 50)
    assert tables.part_cohort(spark, str(tmp_path)).rdd.getNumPartitions() >= 50
    assert sorted(tables.part_cohort(spark, str(tmp_path)).collect()) == want
    monkeypatch.setattr(tables, "PART_CONFIG", tables.PART_CONFIG.but(heavy_min_rows=100, heavy_share=0.1))
    spread = tables.part_cohort(spark, str(tmp_path))
    assert "Union" in spread._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(spread.collect()) == want
