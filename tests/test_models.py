from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from cohortlens.config import TrainConfig
from cohortlens.operators import evaluate as V
from cohortlens.operators import explain as X
from cohortlens.operators import models as D
from cohortlens.plans.queries import part_dataset
from cohortlens.plans.training_run import (
    load_run,
    feature_comparison,
    run_training,
    shapley_table,
    train_and_evaluate,
)
from cohortlens.sources.dataset import write_dataset
from cohortlens.storage import stage
from cohortlens.streaming import score_stream

CFG = TrainConfig(rare_below=78, trees=4, max_iter=30, folds=2)


@pytest.fixture(scope="module")
def dataset(spark):
    return stage(part_dataset(spark, "/root/testdata/sf0.01"))


@pytest.fixture(scope="module")
def run(dataset):
    return train_and_evaluate(dataset, CFG.but(models=("Logistic Regression", "Gradient Boosting")))


def test_comparison_beats_a_single_feature(run, dataset):
    results = run.trained.results.collect()
    assert [r.model for r in results][0] == run.trained.best and len(results) == 2
    one = V.roc_auc(dataset.selectExpr("is_successful_project AS y", "CAST(stars_30d AS DOUBLE) AS score")).first()[0]
    assert results[0].test_roc_auc > one > 0.5
    assert all(0 <= r.cv_roc_auc_std < 0.2 and 0.5 < r.cv_roc_auc_mean < 1 for r in results)
    summary = run.summary.first()
    assert summary.n_rows == 1763 and summary.best_model == run.trained.best
    assert summary.test_roc_auc == pytest.approx(results[0].test_roc_auc)
    assert run.test.count() == 353


def test_training_rows_are_scaled(run):
    x = np.array([r[0] for r in run.train.select(vector_to_array("features")).collect()])
    scaled = [run.fitted.features.index(c) for c in run.prepared.lists.scaled]
    assert np.allclose(x[:, scaled].mean(axis=0), 0, atol=1e-9)
    deviations = x[:, scaled].std(axis=0)
    assert all(np.isclose(d, 1) or np.isclose(d, 0) for d in deviations)


def test_same_seed_same_result(dataset, run):
    again = train_and_evaluate(dataset, CFG.but(models=("Logistic Regression",)))
    first = {r.model: r.test_roc_auc for r in run.trained.results.collect()}
    assert again.summary.first().test_roc_auc == pytest.approx(first["Logistic Regression"], abs=1e-6)


def test_cross_validator_paths(dataset):
    """Without oversampling, and with oversampling before the folds."""
    for cfg in (CFG.but(resample_gate=5.0), CFG.but(leaky_folds=True)):
        row = train_and_evaluate(dataset, cfg.but(models=("Decision Tree",))).trained.results.first()
        assert 0.5 < row.cv_roc_auc_mean < 1


def test_select_best_keeps_the_first_of_equals():
    assert D.select_best([("a", 0, 0, 0.7), ("b", 0, 0, 0.9), ("c", 0, 0, 0.9)]) == "b"


def test_save_load_score_and_stream(spark, dataset, run, tmp_path):
    D.save_model(run.fitted, str(tmp_path / "model"))
    loaded = D.load_model(str(tmp_path / "model"))
    assert loaded.features == run.fitted.features and loaded.name == run.fitted.name
    want = run.fitted.score(dataset).select("repo_id", "probability_of_success", "is_predicted")
    got = loaded.score(dataset).select("repo_id", "probability_of_success", "is_predicted")
    assert got.exceptAll(want).isEmpty() and got.count() == 1763
    # unseen language, missing description
    new = dataset.limit(5).withColumn("primary_language", F.lit("Nova")).withColumn("description", F.lit(None).cast("string"))
    assert loaded.score(new, threshold=0.0).agg(F.min("is_predicted")).first()[0] == 1
    write_dataset(dataset, str(tmp_path / "in"))
    stream = score_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"), loaded)
    stream.awaitTermination()
    streamed = spark.read.parquet(str(tmp_path / "out")).select("repo_id", "probability_of_success", "is_predicted")
    assert streamed.count() == 1763 and streamed.exceptAll(want).isEmpty()


def test_class_weights(spark):
    df = spark.sql("SELECT CASE WHEN id < 30 THEN 1 ELSE 0 END AS y FROM range(120)")
    assert {r["class"]: (r.n, r.weight) for r in D.class_weights(df, "y").collect()} == {
        1: (30, 2.0),
        0: (90, pytest.approx(2 / 3)),
    }


def test_importance_and_comparison(spark, dataset, run):
    model = run.trained.models["Gradient Boosting"]
    table = X.feature_importance(spark, model, run.fitted.features, 5).collect()
    assert len(table) == 5 and table[0].importance >= table[-1].importance
    with pytest.raises(ValueError):
        X.feature_importance(spark, run.trained.models["Logistic Regression"], run.fitted.features)
    boosted = D.bundle("Gradient Boosting", run.prepared, model)
    run.fitted, kept = boosted, run.fitted
    try:
        compared = feature_comparison(dataset, run, 10).collect()
        assert len(compared) == 10 and all(r.difference is not None for r in compared)
        shapley, base = shapley_table(run, 50)
        assert shapley.count() == 50 * len(boosted.features)
        summary = X.shapley_summary(shapley, 20).collect()
        assert len(summary) == 20 and summary[0].mean_abs_shapley >= summary[-1].mean_abs_shapley > -1
        assert X.shapley_rows(shapley, 3).count() == 150
    finally:
        run.fitted = kept


@pytest.mark.parametrize("estimator", ["gbt", "forest", "tree"])
def test_shapley_adds_up(spark, run, estimator):
    made = {
        "gbt": lambda: GBTClassifier(labelCol="y", maxIter=5, maxDepth=4, seed=1),
        "forest": lambda: RandomForestClassifier(labelCol="y", numTrees=4, maxDepth=9, seed=1),
        "tree": lambda: DecisionTreeClassifier(labelCol="y", maxDepth=6, seed=1),
    }[estimator]()
    model = made.fit(run.train)
    sample = run.test.limit(40)
    table, base = X.tree_shapley(sample, model, run.fitted.features)
    sums = {r.key: r.s + base for r in table.groupBy("key").agg(F.sum("phi").alias("s")).collect()}
    predictions = model.transform(sample)
    # boosted probability is 1 / (1 + exp(-2 margin))
    output = F.expr("log(p / (1 - p)) / 2") if estimator == "gbt" else F.col("p")
    want = predictions.select("key", vector_to_array("probability")[1].alias("p")).select("key", output.alias("m"))
    for row in want.collect():
        assert sums[row.key] == pytest.approx(row.m, abs=1e-6)


def test_shapley_equals_subset_enumeration():
    rng = np.random.default_rng(4)
    d, n_features = 4, 6
    leaves = []
    for _ in range(7):
        path = {
            int(f): (-1.0 if rng.random() < 0.5 else -np.inf, float(rng.random()), float(rng.uniform(0.1, 0.9)))
            for f in rng.choice(n_features, d, replace=False)
        }
        leaves.append((float(rng.normal()), path))
    leaves.append((0.5, {}))
    x = rng.normal(size=(5, n_features))
    got = X.shapley_matrix(x, X.stacked_leaves(leaves))

    def game(row, subset):
        total = 0.0
        for value, path in leaves:
            for f, (lo, hi, share) in path.items():
                value *= float(lo < row[f] <= hi) if f in subset else share
            total += value
        return total

    for i, row in enumerate(x):
        assert X.base_value(X.stacked_leaves(leaves)) == pytest.approx(game(row, set()))
        for f in range(n_features):
            others = [g for g in range(n_features) if g != f]
            phi = 0.0
            for size in range(n_features):
                weight = factorial(size) * factorial(n_features - 1 - size) / factorial(n_features)
                for subset in combinations(others, size):
                    phi += weight * (game(row, {*subset, f}) - game(row, set(subset)))
            assert got[i, f] == pytest.approx(phi, abs=1e-12)


def test_deep_forest_is_explained_by_blocks(spark, run, monkeypatch):
    """Depth 15, long paths, leaves in several blocks: sums still equal the probabilities."""
    model = RandomForestClassifier(labelCol="y", numTrees=6, maxDepth=15, seed=2).fit(run.train)
    sample = run.test.limit(60)
    one, base = X.tree_shapley(sample, model, run.fitted.features)
    want = {(r.key, r.feature): r.phi for r in one.collect()}
    monkeypatch.setattr(X, "BLOCK_LEAVES", 150)
    several, again = X.tree_shapley(sample, model, run.fitted.features)
    got = {(r.key, r.feature): r.phi for r in several.collect()}
    assert again == pytest.approx(base) and got == pytest.approx(want, abs=1e-12)
    sums = {}
    for (key, _), phi in got.items():
        sums[key] = sums.get(key, base) + phi
    for row in model.transform(sample).select("key", vector_to_array("probability")[1].alias("p")).collect():
        assert sums[row.key] == pytest.approx(row.p, abs=1e-9)


@pytest.mark.parametrize("rows, patterns", [(3, 256), (400, 256), (400, 1)])
def test_shapley_of_long_paths_equals_subset_enumeration(monkeypatch, rows, patterns):
    """Tables and single patterns give the same; checked by weights of all subsets of a path of 7."""
    monkeypatch.setattr(X, "TABLE_PATTERNS", patterns)
    rng = np.random.default_rng(7)
    d = 7
    leaves = [(float(rng.normal()), {f: (-0.5, float(rng.uniform(0, 1)), float(rng.uniform(0.2, 0.9))) for f in range(d)}) for _ in range(3)]
    x = rng.normal(size=(rows, d + 1))
    got = X.shapley_matrix(x, X.stacked_leaves(leaves))
    for i in rng.choice(rows, 3, replace=False):
        for f in range(d):
            phi = 0.0
            for value, path in leaves:
                hit = [float(path[g][0] < x[i, g] <= path[g][1]) for g in range(d)]
                rest = [g for g in range(d) if g != f]
                for size in range(d):
                    weight = factorial(size) * factorial(d - 1 - size) / factorial(d)
                    for subset in combinations(rest, size):
                        others = np.prod([hit[g] if g in subset else path[g][2] for g in rest])
                        phi += weight * value * others * (hit[f] - path[f][2])
            assert got[i, f] == pytest.approx(phi, abs=1e-12)
    assert (got[:, d] == 0).all()


def test_run_training_writes_model_and_reports(spark, dataset, tmp_path):
    source = tmp_path / "data.csv"
    write_dataset(dataset, str(source), "csv")
    cfg = CFG.but(models=("Random Forest",), trees=3, resample_gate=5.0)
    run = run_training(spark, str(source), str(tmp_path / "out"), cfg)
    assert run.summary.first().n_rows == 1763
    reports = {p.name for p in (tmp_path / "out" / "reports").iterdir()}
    assert {"summary", "model_comparison", "threshold_table", "shapley_summary", "feature_comparison"} <= reports
    assert D.load_model(str(tmp_path / "out" / "model")).name == "Random Forest"
    assert spark.read.parquet(str(tmp_path / "out" / "processed")).count() == 1763
    model, tables = load_run(spark, str(tmp_path / "out"))
    assert model.name == "Random Forest" and tables["summary"].first().n_rows == 1763 and set(tables) == reports
    # a run that ended early has no manifest
    (tmp_path / "out" / "manifest").rename(tmp_path / "elsewhere")
    with pytest.raises(ValueError, match="ended"):
        load_run(spark, str(tmp_path / "out"))


def test_folds_are_fitted_only_when_asked_for(dataset):
    run = train_and_evaluate(dataset, CFG.but(models=("Decision Tree",)), folds=False)
    row = run.trained.results.first()
    assert row.cv_roc_auc_mean is None and 0.5 < row.test_roc_auc < 1
    folds = D.fit_folds(run.train, CFG.but(models=("Decision Tree",)))
    run.trained.folds = folds
    assert run.trained.results.first().cv_roc_auc_mean == folds["Decision Tree"][0]


def test_a_table_of_shapley_values_that_is_read_twice_is_made_once(spark):
    rows = [(str(i), i % 3 // 2, Vectors.dense([i % 3, i % 5])) for i in range(30)]
    sample = spark.createDataFrame(rows, ["key", "y", "features"])
    model = DecisionTreeClassifier(labelCol="y", maxDepth=2).fit(sample)
    table, base = X.tree_shapley(sample, model, ["a", "b"])
    assert "InPandas" not in X.shapley_rows(table, 2)._jdf.queryExecution().toString()
    totals = {r.key: r.total for r in table.groupBy("key").agg((F.sum("phi") + base).alias("total")).collect()}
    assert totals == pytest.approx({key: float(y) for key, y, _ in rows})


def test_deep_trees_keep_the_node_of_a_row():
    models = D.make_models(TrainConfig(), 100)
    assert models["Random Forest"].getCacheNodeIds() and models["Decision Tree"].getCacheNodeIds()


def test_models_and_folds_are_fitted_on_all_rows(spark, monkeypatch):
    """More rows than fits once took; the number of rows at a root is that of the training rows."""
    n = 210_000
    rows = spark.range(n).selectExpr("CAST(id AS STRING) AS key", "CAST(id % 2 AS INT) AS y", "array(id % 7 + 3 * (id % 2), id % 5) AS x")
    train = stage(rows.select("key", "y", array_to_vector(F.transform("x", lambda v: v.cast("double"))).alias("features")), "train")
    cfg = TrainConfig(models=("Decision Tree",), folds=2)
    trained = D.fit_models(train, train.limit(50), cfg)
    root = X.tree_nodes(spark, trained.models["Decision Tree"]).filter("id = 0").first()
    assert root.cover == n
    counts = []
    compact = D.compact
    monkeypatch.setattr(D, "compact", lambda part, count: counts.append(count) or compact(part, count))
    D.fit_folds(train, cfg)
    assert sorted(counts) == [n // 2] * 4


@pytest.mark.parametrize("rows, least, subtrees", [(900, 1, (16, 4)), (900, 1, (4,)), (900, 10**9, ()), (1, 1, (16, 4)), (600, 512, (16, 4))])
def test_rows_that_walk_a_tree_together_get_the_values_of_its_leaves(monkeypatch, rows, least, subtrees):
    """Random trees whose paths split a feature again; groups of alike rows change nothing."""
    monkeypatch.setattr(X, "LEAST_ROWS", least)
    monkeypatch.setattr(X, "SUBTREES", subtrees)
    rng = np.random.default_rng(rows)
    for depth, n_features in ((0, 3), (1, 3), (8, 3), (11, 12)):
        # value, cover, children, feature, threshold
        nodes, pending = [[0.5, 1000.0, -1, -1, -1, -1.0]], [(0, 0)]
        while pending:
            at, level = pending.pop()
            if level < depth and (level < 2 or rng.random() < 0.8):
                share = rng.uniform(0.1, 0.9)
                nodes[at][2:] = len(nodes), len(nodes) + 1, int(rng.integers(n_features)), rng.normal()
                pending += [(len(nodes), level + 1), (len(nodes) + 1, level + 1)]
                nodes += [[rng.normal(), nodes[at][1] * part, -1, -1, -1, -1.0] for part in (share, 1 - share)]
        tree = {i: tuple(n) for i, n in enumerate(nodes)}
        arrays = tuple(np.array(c) for c in zip(*nodes))
        x = rng.normal(size=(rows, n_features)).round(1)
        phi = np.zeros((n_features, rows))
        X.TreeWalk(arrays, n_features).add(phi, np.ascontiguousarray(x.T))
        want = X.shapley_matrix(x, X.stacked_leaves(X.tree_leaves(tree)))
        assert np.allclose(phi.T, want, rtol=0, atol=1e-10)


def test_rows_of_a_repeated_key_in_any_number_of_blocks(spark, monkeypatch):
    """A large model adds up the values of a repeated key, whatever its blocks; a small one keeps the rows."""
    rows = [(str(i % 20), i % 3 // 2, Vectors.dense([i % 20 % 3, i % 20 % 5, i % 20 % 7])) for i in range(40)]
    sample = spark.createDataFrame(rows, ["key", "y", "features"])
    model = RandomForestClassifier(labelCol="y", numTrees=3, maxDepth=3, seed=1).fit(sample)
    found = {}
    large, many = X.MERGED_LEAVES, X.BLOCK_LEAVES
    for merged in (large, 0):
        for leaves in (many, 1):
            monkeypatch.setattr(X, "MERGED_LEAVES", merged)
            monkeypatch.setattr(X, "BLOCK_LEAVES", leaves)
            table, _ = X.tree_shapley(sample, model, ["a", "b", "c"])
            found[merged > 0, leaves > 1] = sorted((r.key, r.feature, r.value, round(r.phi, 9)) for r in table.collect())
    kept, one = found[True, True], found[False, True]
    assert found[True, False] == kept and found[False, False] == one and len(kept) == 120
    assert [r[:3] for r in one] == [r[:3] for r in kept[::2]]
    assert [r[3] for r in one] == pytest.approx([2 * r[3] for r in kept[::2]], abs=1e-8)


def test_trees_are_dealt_evenly_and_their_parts_add_up(spark, monkeypatch):
    """Parts of the trees and slices of the rows, in chunks of a few rows, give what one task gives."""
    assert X.dealt_trees({0: 5, 1: 9, 2: 4, 3: 1}, 2) == [[1, 3], [0, 2]]
    rows = [(str(i), i % 3 // 2, Vectors.dense([i % 3, i % 5, i % 7])) for i in range(50)]
    sample = spark.createDataFrame(rows, ["key", "y", "features"])
    model = RandomForestClassifier(labelCol="y", numTrees=5, maxDepth=4, seed=1).fit(sample)
    found = []
    for chunk in (X.CHUNK_ROWS, 3):
        monkeypatch.setattr(X, "CHUNK_ROWS", chunk)
        table, base = X.tree_shapley(sample, model, ["a", "b", "c"])
        found.append({(r.key, r.feature, r.value): r.phi for r in table.collect()})
    assert len(found[0]) == 150 and found[0] == pytest.approx(found[1], abs=1e-12)
    sums = {}
    for (key, _, _), phi in found[0].items():
        sums[key] = sums.get(key, base) + phi
    for row in model.transform(sample).select("key", vector_to_array("probability")[1].alias("p")).collect():
        assert sums[row.key] == pytest.approx(row.p, abs=1e-9)
