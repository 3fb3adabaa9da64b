"""Every query with an SQL counterpart agrees with it at the smallest scale."""

import pytest
from check import connect, difference
from pyspark.sql import functions as F

from __spark_entry__ import entry, oracle_sql, queries
from cohortlens.operators.cohort import cohort
from cohortlens.operators.metrics import early_metrics
from cohortlens.sources.tables import USER_CONFIG, half_year_events, user_events
from cohortlens.storage import stage

SF_DIR = "/root/testdata/sf0.001"
# these train all models at full size; test_models trains smaller ones
TRAINED = {"comparison_recomputed", "run_checked", "score_new_checked", "shapley_additive", "shapley_rows"}


@pytest.fixture(scope="module")
def db():
    return connect(SF_DIR)


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())


def test_entry(spark):
    df = entry(spark)
    assert df.count() == 168 and len(df.columns) == 40


@pytest.mark.parametrize("name", sorted(set(oracle_sql()) - TRAINED))
def test_query_equals_sql(spark, db, name):
    rows, problem = difference(queries()[name](spark, SF_DIR), oracle_sql()[name], db)
    assert problem is None


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_day_shards_prune_folders(spark):
    plan = _plan(queries()["day_shards"](spark, SF_DIR))
    filters = next(line for line in plan.splitlines() if "PartitionFilters" in line).split("PartitionFilters")[1]
    assert "event_date" in filters.split("PushedFilters")[0] and ">=" in filters and "<=" in filters


def test_salted_join_has_the_salt_in_its_keys(spark):
    salted, plain = (_plan(queries()[name](spark, "/root/testdata/sf0.01")) for name in ("cumulative_totals_salted", "cumulative_totals_shuffled"))
    joins = [line for line in salted.splitlines() if "SortMergeJoin" in line]
    assert any("salt" in line for line in joins) and "salt#" not in plain


@pytest.mark.parametrize("name", ["early_metrics", "sustained_metrics", "early_metrics_q5", "archive_early_metrics", "archive_sustained_metrics"])
def test_no_metric_is_constant(db, name):
    rows = db.execute(oracle_sql()[name]).df()
    numbers = rows.drop(columns="repo_id").select_dtypes("number")
    assert len(numbers.columns) >= 11 and (numbers.nunique() > 1).all()


def test_sizes_are_missing_and_count_nothing(spark):
    events, totals = user_events(spark, "/root/testdata/sf0.01"), {}
    assert events.where("event_type = 'PushEvent' AND get_json_object(payload, '$.size') IS NULL").count() > 100
    for policy in ("zero", "skip"):
        cfg = USER_CONFIG.but(unique=False, null_size=policy, min_events=1)
        cohort_rows = stage(cohort(events, cfg, ["entity_name"]), "cohort")
        rows = early_metrics(events.where("event_type IN ('CreateEvent', 'PushEvent')"), cohort_rows, cfg)
        totals[policy] = rows.agg(F.sum("total_commits_30d"), F.count("total_commits_30d")).first()
    assert totals["zero"][0] == totals["skip"][0] > 0


def test_published_dates_cut_rows(spark):
    events = half_year_events(spark, "/root/testdata/sf0.01")
    days = events.agg(F.countDistinct(F.to_date("event_time")), F.max(F.to_date("event_time")).cast("string")).first()
    assert days[0] > 150 and days[1] > "2024-06-15"
    created = events.where("event_type = 'CreateEvent'")
    assert 0 < created.where("event_time < '2024-04-01'").count() < created.count()
