import math

import pytest
from pyspark.ml.stat import Summarizer
from pyspark.sql import functions as F

from cohortlens.operators import features as E
from cohortlens.operators.sampling import assign_folds, bounded_sample, stratified_split
from cohortlens.sources.dataset import EARLY_COLUMNS
from cohortlens.storage import stage


def early_row(spark, **values):
    columns = ", ".join(f"CAST({values.get(c, 0)} AS BIGINT) AS {c}" for c in EARLY_COLUMNS)
    return spark.sql(f"SELECT {columns}")


def test_engineered_features(spark):
    row = E.engineer_features(
        early_row(
            spark, push_events_30d=2, total_commits_30d=5, total_events_30d=9, unique_contributors_30d=3,
            unique_committers_30d=2, issues_opened_30d=4, issues_closed_30d=1, prs_opened_30d=0,
            prs_closed_30d=3, stars_30d=7, forks_30d=0, events_week_1=4, events_week_2=2,
            events_week_3=0, events_week_4=3, issue_events_30d=5, issue_comments_30d=10,
        )
    ).first()
    assert row.commits_per_push == 2.5 and row.events_per_contributor == 3.0
    assert row.issue_close_rate == 0.25 and row.pr_close_rate == 0.0
    assert (row.has_external_interest, row.has_issues, row.has_prs, row.has_multiple_contributors) == (1, 1, 0, 1)
    assert row.week1_to_week2_ratio == 0.5 and row.week3_to_week4_ratio == 0.0
    assert row.activity_sustainability == 0.5 and row.committer_ratio == pytest.approx(2 / 3)
    assert row.comments_per_issue == 2.0 and row.star_fork_ratio == 7.0
    assert len(E.ENGINEERED) == 14


def test_missing_values_become_zero(spark):
    df = early_row(spark).withColumn("stars_30d", F.lit(None).cast("bigint"))
    assert E.engineer_features(df).first().star_fork_ratio == 0.0


def test_clean_group_and_encode(spark):
    rows = [("Go", "d")] * 3 + [("C++", None)] * 2 + [("it's", "x")] + [(None, None)] * 2
    df = E.clean_metadata(spark.createDataFrame(rows, "primary_language string, description string"))
    assert df.agg(F.sum("has_description")).first()[0] == 4
    categories = E.fit_categories(df, "primary_language", 2)
    assert categories == ["C++", "Go", "Other", "Unknown"]
    names = E.one_hot_names(categories)
    assert names == ["lang_C++", "lang_Go", "lang_Unknown", "lang_Other"]
    hot = E.one_hot(E.group_rare(df, "primary_language", categories), "language_grouped", categories)
    sums = hot.agg(Summarizer.sum(F.col("language_vector"))).first()[0]
    assert list(sums) == [2, 3, 2, 1]
    assert E.feature_lists(names).language == tuple(names)
    # new rows: unknown categories join the rare ones
    new = E.group_rare(spark.sql("SELECT 'Zig' AS primary_language"), "primary_language", categories)
    assert new.first().language_grouped == "Other"


@pytest.mark.parametrize("rare", [1, 3])
def test_any_text_may_be_a_category(spark, rare):
    texts = ["html", "HTML", "a`b", 'say "x"', "dot.net", "Other", "", "it's", "back\\slash"]
    df = spark.createDataFrame([(t,) for t in texts for _ in range(2 + (t == "html"))], "primary_language string")
    categories = E.fit_categories(df, "primary_language", rare)
    hot = E.one_hot(df, "primary_language", categories)
    rows = hot.groupBy("primary_language").agg(Summarizer.sum(F.col("language_vector")).alias("s"), F.count("*").alias("n")).collect()
    names = E.one_hot_names(categories)
    for r in rows:
        name = f"lang_{r.primary_language}" if f"lang_{r.primary_language}" in names else "lang_Other"
        assert list(r.s) == [r.n if n == name else 0 for n in names]


def test_many_categories(spark):
    df = spark.range(3000).selectExpr("CAST(id AS STRING) AS c")
    categories = E.fit_categories(df, "c", 1)
    assert len(categories) == 3000
    sums = E.one_hot(df, "c", categories).agg(Summarizer.sum(F.col("language_vector"))).first()[0]
    assert len(sums) == 3000 and set(sums) == {1.0}


def test_scaler(spark):
    df = spark.sql("SELECT CASE WHEN id > 0 THEN CAST(id AS DOUBLE) END AS a, 5 AS b FROM range(10)")
    scaled = E.fit_scaler(df, ["a", "b"]).transform(df)
    row = scaled.agg(F.avg("a"), F.stddev_pop("a"), F.max("b")).first()
    assert row[0] == pytest.approx(0, abs=1e-12) and row[1] == pytest.approx(1) and row[2] == 0


@pytest.fixture(scope="module")
def labelled(spark):
    return stage(spark.range(34664).selectExpr("id AS key", "CASE WHEN id % 10000 < 4352 THEN 1 ELSE 0 END AS y"))


def test_split_sizes(labelled):
    split = stratified_split(labelled, "key", "y")
    sizes = {(r.y, r.is_test): r["count"] for r in split.groupBy("y", "is_test").count().collect()}
    totals = {y: sizes[y, 0] + sizes[y, 1] for y in (0, 1)}
    assert sizes[0, 1] + sizes[1, 1] == 6933 == math.ceil(0.2 * 34664)
    assert all(abs(sizes[y, 1] - 0.2 * totals[y]) <= 1 for y in (0, 1))
    assert split.count() == 34664 and split.columns == ["key", "y", "is_test"]


def test_folds_are_balanced_and_repeatable(labelled):
    folds = assign_folds(labelled, "key", "y", 5)
    sizes = [r["count"] for r in folds.filter("y = 1").groupBy("fold").count().collect()]
    assert len(sizes) == 5 and max(sizes) - min(sizes) <= 1
    again = assign_folds(labelled.repartition(3), "key", "y", 5)
    assert folds.exceptAll(again).isEmpty()
    assert not folds.exceptAll(assign_folds(labelled, "key", "y", 5, seed=1)).isEmpty()


def test_bounded_sample(labelled):
    sample = bounded_sample(labelled, "key", 100)
    assert sample.count() == 100 and sample.exceptAll(bounded_sample(labelled.repartition(5), "key", 100)).isEmpty()
    assert bounded_sample(labelled.limit(7), "key", 100).count() == 7
