"""The end-to-end run: load, prepare, split, train, compare, explain, save."""

from __future__ import annotations

import posixpath
import uuid
from dataclasses import dataclass
from urllib.parse import urlparse

from pyspark.errors import AnalysisException
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F

from cohortlens.config import TrainConfig
from cohortlens.operators import evaluate as V
from cohortlens.operators import explain as X
from cohortlens.operators import models as D
from cohortlens.operators import profile as P
from cohortlens.operators.features import clean_metadata, group_rare
from cohortlens.operators.sampling import bounded_sample, stratified_split
from cohortlens.sources.dataset import read_dataset_csv, write_dataset
from cohortlens.storage import stage

@dataclass
class Run:
    """What a run leaves behind; tables are DataFrames."""

    trained: D.Trained
    fitted: D.SuccessModel
    prepared: D.Preparation
    train: DataFrame
    test: DataFrame
    scored: DataFrame
    summary: DataFrame
    dataset: DataFrame


def train_and_evaluate(dataset: DataFrame, cfg: TrainConfig, folds: bool = True) -> Run:
    """Run all stages on a wide dataset; without ``folds`` no model is cross-validated.

    Folds decide nothing: the best model is the one with the best test score.
    """
    dataset = stage(dataset, "dataset")
    categories = D.fit_categories(dataset, cfg)
    keys = dataset.select(cfg.key, cfg.target)
    parts = stage(stratified_split(keys, cfg.key, cfg.target, cfg.test_share, cfg.seed).select(cfg.key, "is_test"), "split")
    train_rows, test_rows = (
        dataset.join(parts.filter(F.col("is_test") == flag).select(cfg.key), cfg.key, "left_semi") for flag in (0, 1)
    )
    prepared = D.fit_preparation(categories, train_rows)
    train = stage(D.assemble(train_rows, prepared, cfg), "train")
    test = stage(D.assemble(test_rows, prepared, cfg), "test")
    trained = D.fit_models(train, test, cfg)
    if folds:
        trained.folds = D.fit_folds(train, cfg)
    best = trained.models[trained.best]
    fitted = D.bundle(trained.best, prepared, best)
    scored = trained.scores[trained.best]
    return Run(trained, fitted, prepared, train, test, scored, run_summary(dataset, fitted, scored), dataset)


def run_summary(dataset: DataFrame, fitted: D.SuccessModel, scored: DataFrame) -> DataFrame:
    """One row: rows, features, best model and its test metrics."""
    metrics = V.metrics_of(V.confusion(scored, predicted="predicted")).first()
    auc = D.exact_auc(scored)
    row = (dataset.count(), len(fitted.features), fitted.name, auc, metrics.f1, metrics.precision, metrics.recall)
    return dataset.sparkSession.createDataFrame(
        [row],
        "n_rows BIGINT, n_features INT, best_model STRING, test_roc_auc DOUBLE, test_f1 DOUBLE, "
        "test_precision DOUBLE, test_recall DOUBLE",
    )


def feature_comparison(dataset: DataFrame, run: Run, k: int = 10) -> DataFrame:
    """Class means of the k most important features that the dataset has."""
    model = run.trained.models[run.trained.best_tree()]
    top = X.feature_importance(dataset.sparkSession, model, run.fitted.features, k)
    prepared = run.fitted.preparation.transform(dataset)
    language = run.prepared.lists.language
    hot = vector_to_array(D.LANGUAGE) if language else None
    names = [r["feature"] for r in top.collect()]
    values = [hot[language.index(n)] if n in language else F.col(n) for n in names]
    safe = [f"m{i}" for i in range(len(names))]
    means = P.class_means(prepared.select(P.TARGET, *[v.alias(n) for v, n in zip(values, safe)]), safe)
    return means.replace(dict(zip(safe, names)), subset=["feature"])


def shapley_table(run: Run, rows: int | None = None, seed: int = 42) -> tuple[DataFrame, float]:
    """Shapley values of all test rows, or of ``rows`` of them (the published run took 1,000), for the best tree model."""
    sample = run.test if rows is None else bounded_sample(run.test, "key", rows, seed)
    return X.tree_shapley(sample, run.trained.models[run.trained.best_tree()], run.fitted.features)


def load_dataset(spark: SparkSession, path: str, fmt: str = "auto") -> DataFrame:
    """A dataset as Parquet or CSV; "auto" looks whether there are Parquet files below ``path``."""
    if fmt == "auto":
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
        parquet = files.select("path").where("path LIKE '%.parquet'")
        fmt = "csv" if parquet.isEmpty() else "parquet"
    if fmt == "parquet":
        return spark.read.parquet(path)
    if fmt != "csv":
        raise ValueError(f"fmt: {fmt!r}")
    return read_dataset_csv(spark, path)


def _parts(path: str) -> tuple[str, ...]:
    return tuple(p for p in posixpath.normpath(urlparse(path).path or path).split("/") if p)


def output_folder(input_path: str, output: str | None, written: tuple[str, ...]) -> str:
    """``output`` or a fresh folder beside the input; what is written there must not touch the input."""
    output = (output or f"{input_path.rstrip('/')}-run-{uuid.uuid4().hex[:8]}").rstrip("/")
    source = _parts(input_path)
    for name in written:
        target = _parts(f"{output}/{name}")
        shorter = min(len(source), len(target))
        if source[:shorter] == target[:shorter]:
            raise ValueError(f"{output}/{name} would replace or hold the input {input_path}")
    return output


def run_training(
    spark: SparkSession,
    input_path: str,
    output: str | None = None,
    cfg: TrainConfig = TrainConfig(),
    fmt: str = "auto",
    folds: bool = True,
) -> Run:
    """Train on a dataset file and write model and reports below ``output``.

    The manifest, one row per report with its number of rows, is written last: a run without
    it did not end (``load_run`` refuses it).

    The default output is a fresh folder beside the input, named after it. An output that
    would replace, hold or lie in the input is refused before anything is read.
    """
    output = output_folder(input_path, output, ("model", "processed", "reports", "manifest"))
    dataset = load_dataset(spark, input_path, fmt)
    run = train_and_evaluate(dataset, cfg, folds)
    dataset = run.dataset
    D.save_model(run.fitted, f"{output}/model")
    processed = group_rare(clean_metadata(dataset), "primary_language", run.prepared.categories)
    write_dataset(processed, f"{output}/processed")
    totals = V.score_totals(run.scored)
    reports = {
        "roc_curve": V.roc_curve(run.scored, totals),
        "pr_curve": V.pr_curve(run.scored, totals),
        "average_precision": V.average_precision(run.scored, totals),
        "score_histogram": V.score_histogram(run.scored),
        "summary": run.summary,
        "model_comparison": run.trained.results,
        "classification_report": V.report_of(V.confusion(run.scored, predicted="predicted")),
        "threshold_table": V.threshold_table(run.scored),
        "group_insights": P.group_insights(processed, "language_grouped", cfg.rare_below),
    }
    if any(hasattr(m, "featureImportances") for m in run.trained.models.values()):
        tree = run.trained.models[run.trained.best_tree()]
        reports["feature_importance"] = X.feature_importance(spark, tree, run.fitted.features)
        reports["feature_comparison"] = feature_comparison(dataset, run)
        reports["shapley_summary"] = X.shapley_summary(shapley_table(run, seed=cfg.seed)[0])
    for name, table in reports.items():
        write_dataset(table, f"{output}/reports/{name}")
    counts = [(name, spark.read.parquet(f"{output}/reports/{name}").count()) for name in reports]
    write_dataset(spark.createDataFrame(counts, "report STRING, n_rows BIGINT").coalesce(1), f"{output}/manifest")
    return run


def load_run(spark: SparkSession, output: str) -> tuple[D.SuccessModel, dict[str, DataFrame]]:
    """Model and reports of a run that ended; a run without manifest, or with other reports than it names, is refused."""
    try:
        manifest = {r["report"]: r["n_rows"] for r in spark.read.parquet(f"{output}/manifest").collect()}
    except AnalysisException as error:
        raise ValueError(f"{output} holds no run that ended") from error
    reports = {name: spark.read.parquet(f"{output}/reports/{name}") for name in manifest}
    wrong = [name for name, table in reports.items() if table.count() != manifest[name]]
    if wrong:
        raise ValueError(f"{output}: reports differ from the manifest: {wrong}")
    return D.load_model(f"{output}/model"), reports
