import json
from datetime import date, timedelta

import pytest
from archive import BORN, DAY, canonical, creation, event
from pyspark.sql import functions as F

from cohortlens.sources import (
    DATASET_SCHEMA,
    canonical_events,
    profile_schema,
    read_dataset_csv,
    read_events,
    write_dataset,
)
from cohortlens.sources.dataset import refused_values


def test_read_events_prunes_day_folders(spark, tmp_path):
    for day in ("2024-01-01", "2024-01-02", "2024-01-03"):
        folder = tmp_path / f"event_date={day}"
        folder.mkdir()
        raw = {
            "repo": {"id": 5, "name": "a/b"},
            "actor": {"id": 6, "login": "x"},
            "type": "PushEvent",
            "created_at": f"{day}T10:00:00Z",
            "payload": {"size": 3, "nested": {"k": [1, 2]}},
            "unused": 1,
        }
        (folder / "part.json").write_text(json.dumps(raw) + "\n")
    events = read_events(spark, str(tmp_path), "2024-01-02", "2024-01-03")
    assert len(events.inputFiles()) == 3  # before pruning
    plan = events._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_date" in plan
    rows = canonical_events(events).orderBy("event_time").collect()
    assert [r.event_date for r in rows] == [date(2024, 1, 2), date(2024, 1, 3)]
    assert json.loads(rows[0].payload) == {"size": 3, "nested": {"k": [1, 2]}}
    assert (rows[0].entity_id, rows[0].entity_name, rows[0].actor_login) == (5, "a/b", "x")


def test_canonical_events(spark):
    rows = canonical(spark, [creation(1), event(1, "PushEvent", DAY, size=2)]).orderBy("event_time").collect()
    assert rows[0].event_type == "CreateEvent" and rows[0].event_time == BORN
    assert rows[1].event_time == BORN + timedelta(days=1) and rows[1].actor_id == 1


def test_dataset_csv_missing_values_and_quotes(spark, tmp_path):
    zeros = [0] * 19 + [0] * 10 + [1, 0, 0, 1]
    texts = ['line one\nline "two", with comma', "None", "NA", "null", "", " None "]
    rows = [
        (i, f"r{i}", "Python" if i else None, text, BORN, 7, "x", *zeros) for i, text in enumerate(texts)
    ]
    df = spark.createDataFrame(rows, DATASET_SCHEMA)
    write_dataset(df, str(tmp_path / "csv"), "csv")
    back = read_dataset_csv(spark, str(tmp_path / "csv"))
    assert back.schema == DATASET_SCHEMA
    got = {r.repo_id: r for r in back.collect()}
    assert [got[i].description for i in range(6)] == [texts[0], None, None, None, None, " None "]
    assert got[0].primary_language is None and got[1].primary_language == "Python"
    assert got[0].repo_created_at == BORN and got[0].is_starred_project == 1


def test_write_dataset_bounds_files(spark, tmp_path):
    write_dataset(spark.range(100).coalesce(1), str(tmp_path / "p"), max_records_per_file=30)
    back = spark.read.parquet(str(tmp_path / "p"))
    assert back.count() == 100 and len(back.inputFiles()) == 4


def test_profile_schema(spark):
    df = spark.sql("SELECT * FROM VALUES (1L, 'a'), (2L, NULL) AS v(id, name)")
    got = [tuple(r) for r in profile_schema(df).orderBy("position").collect()]
    assert got == [(1, "id", "bigint", 2, 2, 2), (2, "name", "string", 1, 2, 2)]
    assert df.filter(F.col("name").isNull()).count() == 1


def test_whole_numbers_with_a_fraction_part(spark, tmp_path):
    text = ",".join(f.name for f in DATASET_SCHEMA) + "\n"
    row = {f.name: "" for f in DATASET_SCHEMA}
    good = {"repo_id": "9007199254740993", "stars_30d": "123.0", "forks_30d": "1.2e1", "pr_events_30d": "-4", "has_community": "1.0"}
    (tmp_path / "good.csv").write_text(text + ",".join((row | good).values()) + "\n")
    got = read_dataset_csv(spark, str(tmp_path / "good.csv")).first()
    assert (got.repo_id, got.stars_30d, got.forks_30d, got.pr_events_30d, got.has_community) == (9007199254740993, 123, 12, -4, 1)
    assert got.issue_events_30d is None
    for bad in ("1.5", "many", "99999999999999999999"):
        (tmp_path / "bad.csv").write_text(text + ",".join((row | {"stars_30d": bad}).values()) + "\n")
        with pytest.raises(Exception, match="column stars_30d: no whole number of type bigint: " + bad):
            read_dataset_csv(spark, str(tmp_path / "bad.csv")).collect()


def test_refused_values_are_counted(spark, tmp_path):
    text = 'a,b,t\n1,x,2024-01-01 00:00:00\n2.0,NA,\nNA,"q\n""r""",soon\n1.5,,soon\nabc,y,2024-02-30\nabc,z,NULL\n'
    (tmp_path / "in.csv").write_text(text)
    schema = spark.createDataFrame([], "a BIGINT, b STRING, t TIMESTAMP").schema
    got = refused_values(spark, str(tmp_path / "in.csv"), schema)
    assert {(r.column_name, r.value): r.n for r in got.collect()} == {
        ("a", "1.5"): 1,
        ("a", "abc"): 2,
        ("t", "soon"): 2,
        ("t", "2024-02-30"): 1,
    }
