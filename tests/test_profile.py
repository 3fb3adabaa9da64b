import numpy as np
import pandas as pd
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import Correlation
from pyspark.sql import functions as F

from cohortlens.operators import profile as P, ranks
from cohortlens.operators.ranks import running_totals
from cohortlens.storage import stage


@pytest.fixture(scope="module")
def table():
    rng = np.random.default_rng(5)
    n = 2000
    y = rng.integers(0, 2, n)
    return pd.DataFrame(
        {
            "y": y,
            "a": rng.poisson(3 + 2 * y),
            "b": np.round(rng.gamma(0.7, 40, n), 2),
            "c": np.zeros(n, dtype=int),
            "lang": rng.choice(["x", "y", "z"], n, p=[0.7, 0.2, 0.1]),
        }
    )


@pytest.fixture(scope="module")
def df(spark, table):
    return stage(spark.createDataFrame(table))


def test_running_totals(spark):
    rng = np.random.default_rng(1)
    values = np.unique(np.round(rng.gamma(0.3, 5, 3000), 3))
    weights = rng.integers(1, 9, len(values))
    counts = spark.createDataFrame(pd.DataFrame({"v": values, "n": weights}))
    got = running_totals(counts, "v", ["n"]).orderBy("v").toPandas()
    assert (got["n_to"].to_numpy() == weights.cumsum()).all() and (got["n_all"] == weights.sum()).all()


def test_describe_equals_pandas(df, table):
    got = P.describe_numeric(df, ["a", "b", "c"]).toPandas().set_index("feature")
    want = table[["a", "b", "c"]].describe().T
    for ours, theirs in zip(["n", "mean", "std", "min", "q25", "q50", "q75", "max"], want.columns):
        assert np.allclose(got[ours].loc[want.index].astype(float), want[theirs])


@pytest.mark.parametrize("rows", [1, 2, 7, 30_000])
def test_quantiles_equal_numpy_and_only_bracketed_values_travel(spark, monkeypatch, rows):
    rng = np.random.default_rng(rows)
    data = pd.DataFrame(
        {
            "g": rng.choice(["p", "q"], rows, p=[0.9, 0.1]),
            "a": rng.normal(size=rows),
            # a third of the rows have one value, on the bracket of a quantile
            "b": np.where(rng.random(rows) < 0.34, 0.0, rng.gamma(1, 9, rows)),
            "c": np.where(rng.random(rows) < 0.5, np.nan, np.arange(rows)),
        }
    )
    source = stage(spark.createDataFrame(data).withColumn("c", F.expr("nullif(c, double('NaN'))")).withColumn("none", F.lit(None).cast("double")))
    sent = []
    kept = ranks.stage
    monkeypatch.setattr(ranks, "stage", lambda df, name="stage": sent.append(kept(df, name)) or sent[-1])
    shares = {"low": 0.01, "q25": 0.25, "mid": 0.5, "top": 1.0}
    for by in ([], ["g"]):
        got = ranks.value_quantiles(source, ["a", "b", "c", "none"], shares, by).toPandas()
        groups = [((), data)] if not by else list(data.groupby(by))
        want = {(*g, c): part[c].dropna().quantile(list(shares.values())) for g, part in groups for c in "abc"}
        want = {k: v.to_numpy() for k, v in want.items() if not np.isnan(v).any()}
        ours = {tuple(r[: len(by) + 1]): np.array(r[len(by) + 1 :], dtype=float) for r in got.itertuples(index=False)}
        assert ours.keys() == want.keys() and all(np.allclose(ours[k], want[k], rtol=1e-12) for k in want)
    if rows > 10_000:
        assert sent[0].count() < 0.02 * 3 * rows


def test_quantiles_and_histogram_of_nothing(spark):
    none = stage(spark.createDataFrame([], "g string, a double"))
    assert ranks.value_quantiles(none, ["a"], {"q": 0.5}).isEmpty() and ranks.value_quantiles(none, ["a"], {"q": 0.5}, ["g"]).isEmpty()
    assert P.histogram(none, ["a"]).isEmpty() and P.histogram(none, ["a"], by=["g"]).isEmpty()
    assert P.describe_numeric(none, ["a"]).first().q50 is None


def test_histogram_skips_what_has_no_bin(spark):
    rows = [("p", 1.0), ("p", 3.0), ("p", float("nan")), ("p", float("inf")), ("q", 5.0), ("q", None), (None, 7.0)]
    df = spark.createDataFrame(rows, "g string, a double")
    got = {(r.g, r.bin): (r.bin_from, r.bin_to, r.n) for r in P.histogram(df, ["a"], 4, by=["g"]).collect()}
    assert got == {("p", 0): (1.0, 1.5, 1), ("p", 3): (2.5, 3.0, 1), ("q", 2): (5.0, 5.25, 1)}


def test_histograms_read_the_rows_twice_without_unpivot(df):
    plan = P.histogram(df, ["a", "b"], by=["lang"])._jdf.queryExecution().optimizedPlan().toString()
    assert "Expand" not in plan and "Generate" not in plan and plan.count("parquet") == 1


def test_histogram_equals_numpy(df, table):
    got = P.histogram(df, ["a", "b", "c"], 50, 0.1).toPandas()
    for column in ("a", "b", "c"):
        counts, edges = np.histogram(table[column].replace(0, 0.1), bins=50)
        ours = got[got["feature"] == column].set_index("bin")["n"].reindex(range(50), fill_value=0)
        assert (ours.to_numpy() == counts).all()


def test_correlations_equal_pandas_and_spark_ml(spark, df, table):
    got = {r.feature: r.correlation for r in P.corr_with(df, ["a", "b", "c", "y"], "y").collect()}
    assert got["a"] == pytest.approx(table["a"].corr(table["y"])) and got["c"] is None
    assert got["y"] == pytest.approx(1.0)
    assert "y" not in {r.feature for r in P.corr_with(df, ["a", "y"], "y", include_target=False).collect()}
    matrix = {(r.feature_a, r.feature_b): r.correlation for r in P.corr_matrix(df, ["a", "b", "y"]).collect()}
    assert set(matrix) == {("a", "a"), ("b", "a"), ("b", "b"), ("y", "a"), ("y", "b"), ("y", "y")}
    vectors = VectorAssembler(inputCols=["a", "b", "y"], outputCol="v").transform(df)
    ml = Correlation.corr(vectors, "v").first()[0].toArray()
    assert matrix["b", "a"] == pytest.approx(ml[0, 1]) and matrix["y", "b"] == pytest.approx(ml[1, 2])


def test_correlation_skips_missing_pairs(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 4.5), (None, 100.0), (3.0, 5.0), (9.0, None)], "a double, y double")
    want = pd.DataFrame({"a": [1, 2, 3], "y": [2, 4.5, 5]}).corr().iloc[0, 1]
    assert P.corr_with(df, ["a"], "y").first().correlation == pytest.approx(want)


def test_box_stats(df, table):
    got = {(r["class"], r.feature): r for r in P.box_stats(df, ["a", "b"], "y").collect()}
    for value, name in P.CLASS_NAMES.items():
        b = table.loc[table["y"] == value, "b"]
        q1, q3 = b.quantile(0.25), b.quantile(0.75)
        inside = b[(b >= q1 - 1.5 * (q3 - q1)) & (b <= q3 + 1.5 * (q3 - q1))]
        row = got[name, "b"]
        assert (row.q25, row.q75) == (pytest.approx(q1), pytest.approx(q3))
        assert (row.whisker_low, row.whisker_high) == (inside.min(), inside.max())
        assert (row.outliers, row.n) == (len(b) - len(inside), len(b))


def test_counts_and_rates(df, table):
    counts = {r.value: (r.n, r.pct) for r in P.value_counts(df, "lang").collect()}
    assert counts["x"][0] == (table["lang"] == "x").sum() and sum(p for _, p in counts.values()) == pytest.approx(100)
    assert [r.lang for r in P.top_k(df, "lang", 2).collect()] == ["x", "y"]
    assert P.semi_join_top_k(df, "lang", 2).count() == (table["lang"] != "z").sum()
    rate = {r.lang: r.success_rate for r in P.rate_by(df, "lang", "y").collect()}
    assert rate["z"] == pytest.approx(100 * table.loc[table["lang"] == "z", "y"].mean(), abs=0.006)
    means = P.class_means(df, ["a"], "y").first()
    assert means.successful_mean == pytest.approx(table.loc[table["y"] == 1, "a"].mean())
    assert means.difference == pytest.approx(means.successful_mean - means.unsuccessful_mean)


def test_missing_coverage_and_gate(spark):
    df = spark.sql("SELECT * FROM VALUES (1, NULL, 'd'), (2, NULL, NULL), (3, NULL, 'd') AS v(id, primary_language, description)")
    assert [tuple(r) for r in P.missing_report(df).collect()] == [
        ("primary_language", 3, 100.0),
        ("description", 1, 33.33),
    ]
    assert {r.column_name: (r.known, r.known_pct) for r in P.coverage(df).collect()} == {
        "primary_language": (0, 0.0),
        "description": (2, 66.67),
    }
    assert not P.has_any(df, "primary_language") and P.has_any(df, "description")
    assert P.numeric_columns(df, ["id"]) == []


def test_category_counts(df):
    row = P.category_counts(df, "lang", 300).first()
    assert tuple(row) == (3, 1)
    assert tuple(P.category_counts(df.filter(F.col("lang") != "z"), "lang", 300).first()) == (2, 0)
