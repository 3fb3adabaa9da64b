from datetime import datetime

import pytest
from pyspark.sql import functions as F

from cohortlens.functions import (
    activity_level,
    day_diff,
    finite_or_zero,
    in_window,
    json_scalar,
    map_values,
    percent,
    ratio,
)


def values(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_day_diff_truncates_whole_days_in_every_zone(spark, zone):
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df = spark.sql(
            "SELECT timestamp_seconds(1710028800 + h * 3600) AS t, timestamp_seconds(1710028800) AS t0, h "
            "FROM VALUES (-25), (-24), (-23), (0), (23), (24), (743), (744) AS v(h)"
        )
        got = {r.h: r.d for r in df.select("h", day_diff(F.col("t"), F.col("t0")).alias("d")).collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert got == {-25: -1, -24: -1, -23: 0, 0: 0, 23: 0, 24: 1, 743: 30, 744: 31}


def test_in_window_keeps_both_ends(spark):
    df = spark.range(5).filter(in_window(F.col("id"), 1, 3))
    assert [r.id for r in df.collect()] == [1, 2, 3]


def test_json_scalar(spark):
    payload = (
        '{"a": {"b": 1}, "c": "[WIP] x", "d": [1], "n": "3.0", "i": 7, "t": true, "z": null, "s": "{curly"}'
    )
    df = spark.createDataFrame([(payload,), ("not json",), (None,)], "p string")
    p = F.col("p")
    first = df.select(
        json_scalar(p, "$.a").alias("object"),
        json_scalar(p, "$.a.b", "bigint").alias("nested"),
        json_scalar(p, "$.c").alias("bracket_text"),
        json_scalar(p, "$.s").alias("curly_text"),
        json_scalar(p, "$.d").alias("array"),
        json_scalar(p, "$.n", "bigint").alias("not_whole"),
        json_scalar(p, "$.i", "bigint").alias("whole"),
        json_scalar(p, "$.t", "boolean").alias("flag"),
        json_scalar(p, "$.z").alias("null"),
    ).collect()
    assert tuple(first[0]) == (None, 1, "[WIP] x", "{curly", None, None, 7, True, None)
    assert all(v is None for row in first[1:] for v in row)


def test_json_scalar_strict_raises(spark):
    df = spark.createDataFrame([('{"n": "3.0"}',)], "p string")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        df.select(json_scalar(F.col("p"), "$.n", "bigint", strict=True)).collect()


def test_ratio_guards_zero(spark):
    df = spark.sql("SELECT 6 AS n, 4 AS d, 0 AS z")
    got = values(
        df,
        ratio(F.col("n"), F.col("d")),
        ratio(F.col("n"), F.col("z")),
        ratio(F.col("n"), F.col("z"), F.col("n")),
    )
    assert got == [(1.5, 0.0, 6.0)]


def test_finite_or_zero(spark):
    df = spark.sql("SELECT * FROM VALUES (1.5D), (double('nan')), (double('inf')), (double('-inf')), (NULL) AS v(x)")
    assert [r[0] for r in df.select(finite_or_zero(F.col("x"))).collect()] == [1.5, 0, 0, 0, 0]


def test_activity_level_is_right_closed(spark):
    df = spark.sql("SELECT * FROM VALUES (0), (1), (10), (11), (500), (501), (NULL) AS v(x)")
    got = dict(values(df, "x", activity_level(F.col("x"))))
    assert got == {
        0: None,
        1: "Very Low (1-10)",
        10: "Very Low (1-10)",
        11: "Low (11-50)",
        500: "High (101-500)",
        501: "Very High (500+)",
        None: None,
    }


def test_map_values_and_percent(spark):
    df = spark.sql("SELECT 1 AS k, 9 AS u, 2345 AS a, 100000 AS b, 0 AS z")
    got = values(
        df,
        map_values(F.col("k"), {0: "no", 1: "yes"}),
        map_values(F.col("u"), {0: "no", 1: "yes"}),
        percent(F.col("a"), F.col("b"), 2),
        percent(F.col("a"), F.col("b"), 2, half_even=True),
        percent(F.col("a"), F.col("z")),
    )
    assert got[0][:2] == ("yes", None)
    assert got[0][2] == pytest.approx(2.35) and got[0][3] == pytest.approx(2.34) and got[0][4] is None
