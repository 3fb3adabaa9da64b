"""Training, comparison, saving and scoring of success classifiers on Spark ML."""

from __future__ import annotations

import statistics
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import partial

from pyspark import inheritable_thread_target
from pyspark.ml import Estimator, Model, PipelineModel
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassifier,
    LogisticRegression,
    RandomForestClassifier,
)
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F

from cohortlens.config import TrainConfig
from cohortlens.operators import evaluate as V
from cohortlens.operators import features as E
from cohortlens.operators.sampling import assign_folds
from cohortlens.operators.smote import class_sizes, rows_to_add, smote
from cohortlens.storage import stage

# rows of a fit that one task takes: less would be job overhead, not work
TASK_ROWS = 50_000

RESULT_SCHEMA = (
    "model STRING, cv_roc_auc_mean DOUBLE, cv_roc_auc_std DOUBLE, test_roc_auc DOUBLE, "
    "test_accuracy DOUBLE, test_precision DOUBLE, test_recall DOUBLE, test_f1 DOUBLE"
)


# preparation


@dataclass(frozen=True)
class Preparation:
    """Everything learned before the model: categories (all rows) and scaling (training rows)."""

    categories: tuple[str, ...]
    scaler: E.Scaler
    lists: E.FeatureLists

    def transformer(self) -> PipelineModel:
        """Cleaning, one-hots, ratios, scaling and the vector as saveable stages."""
        plain = [c for c in self.lists.all if c not in set(self.lists.language)]
        x = [
            (self.scaler.sql(c) if c in self.scaler.means else f"CAST(`{c}` AS DOUBLE)") + f" AS x_{i}"
            for i, c in enumerate(plain)
        ]
        before = len(self.lists.early) + len(self.lists.metadata)
        places = [f"x_{i}" for i in range(len(x))]
        return PipelineModel(
            stages=[
                SQLTransformer(statement=_select(METADATA_SQL)),
                *E.one_hot_stages(SparkSession.active(), GROUPED, self.categories, LANGUAGE),
                SQLTransformer(statement=_select({n: E.finite_sql(s) for n, s in E.ENGINEERED.items()})),
                SQLTransformer(statement=f"SELECT *, {', '.join(x)} FROM __THIS__"),
                VectorAssembler(
                    inputCols=[*places[:before], *([LANGUAGE] if self.lists.language else []), *places[before:]],
                    outputCol="features",
                    handleInvalid="keep",
                ),
            ]
        )


def _select(columns: dict[str, str]) -> str:
    return "SELECT *, " + ", ".join(f"{sql} AS `{name}`" for name, sql in columns.items()) + " FROM __THIS__"


# the language on its way to the one-hot vector, and that vector
GROUPED = "language_for_model"
LANGUAGE = "language_one_hot"
METADATA_SQL = {
    "has_description": "CASE WHEN description IS NOT NULL THEN 1 ELSE 0 END",
    GROUPED: f"coalesce(primary_language, '{E.UNKNOWN}')",
}


def fit_categories(dataset: DataFrame, cfg: TrainConfig) -> tuple[str, ...]:
    """Language categories, learned from all rows: they decide the columns."""
    cleaned = E.clean_metadata(dataset)
    return tuple(E.fit_categories(cleaned, "primary_language", cfg.rare_below))


def fit_preparation(categories, train: DataFrame) -> Preparation:
    """Scaling, learned from the training rows only."""
    lists = E.feature_lists(E.one_hot_names(categories))
    # only numbers are scaled, so cleaning and one-hots are not needed here
    scaler = E.fit_scaler(E.engineer_features(train), lists.scaled)
    return Preparation(tuple(categories), scaler, lists)


def assemble(df: DataFrame, preparation: Preparation, cfg: TrainConfig) -> DataFrame:
    """(key, y, features) for training and testing."""
    # without the attributes of the one-hot places: trees split 0/1 at a threshold like every other feature
    features = F.col("features").alias("features", metadata={"comment": "assembled"})
    return preparation.transformer().transform(df).select(
        F.col(cfg.key).cast("string").alias("key"), F.col(cfg.target).cast("int").alias("y"), features
    )


# estimators and weights


def class_weights(df: DataFrame, y: str) -> DataFrame:
    """Balanced weights n / (classes * n_class), one row per class."""
    sizes = df.groupBy(y).agg(F.count(F.lit(1)).alias("n"))
    totals = sizes.agg(F.sum("n") / F.count(F.lit(1)))
    return sizes.select(F.col(y).alias("class"), "n", (totals.scalar() / F.col("n")).alias("weight"))


def with_weights(train: DataFrame, positive_weight: float) -> DataFrame:
    """Weight columns: balanced over the classes, and positives by ``positive_weight``."""
    # one row per class
    balanced = {r["class"]: r["weight"] for r in class_weights(train, "y").collect()}
    return train.withColumns(
        {
            "weight": F.when(F.col("y") == 1, balanced.get(1, 1.0)).otherwise(balanced.get(0, 1.0)),
            "positive_weight": F.when(F.col("y") == 1, positive_weight).otherwise(1.0),
        }
    )


def make_models(cfg: TrainConfig, n_train: int) -> dict[str, Estimator]:
    """The compared estimators; the last two are deeper boosted trees with class weights."""
    common = dict(labelCol="y", featuresCol="features")
    # more memory per pass: deep forests need fewer passes over the rows
    trees = dict(common, seed=cfg.seed, maxBins=64, maxMemoryInMB=512)
    boosted = dict(trees, maxIter=cfg.trees)
    # deep trees are not walked again for every row at each level, nor sent along with every task
    deep = dict(trees, cacheNodeIds=True)
    models = {
        "Logistic Regression": LogisticRegression(
            **common, maxIter=cfg.max_iter, regParam=1.0 / n_train, standardization=False, weightCol="weight"
        ),
        "Decision Tree": DecisionTreeClassifier(**deep, maxDepth=10, weightCol="weight"),
        "Random Forest": RandomForestClassifier(
            **deep, numTrees=cfg.trees, maxDepth=15, weightCol="weight"
        ),
        "Gradient Boosting": GBTClassifier(**boosted, maxDepth=5, stepSize=0.1),
        "Gradient Boosting (positive weight)": GBTClassifier(**boosted, maxDepth=6, stepSize=0.3, weightCol="positive_weight"),
        "Gradient Boosting (balanced)": GBTClassifier(**boosted, maxDepth=6, stepSize=0.1, weightCol="weight"),
    }
    return {name: models[name] for name in cfg.models}


def exact_auc(scored: DataFrame) -> float:
    """ROC-AUC over all distinct scores (numBins=0: no down-sampled curve)."""
    return BinaryClassificationEvaluator(labelCol="y", rawPredictionCol="score", numBins=0).evaluate(scored)


def scored_by(model: Model, df: DataFrame) -> DataFrame:
    """(key, y, score = P(1), predicted)."""
    predictions = model.transform(df)
    return predictions.select(
        "key",
        "y",
        vector_to_array("probability")[1].alias("score"),
        F.col("prediction").cast("int").alias("predicted"),
    )


# cross-validation and comparison


def resampled(train: DataFrame, cfg: TrainConfig, positive_weight: float) -> DataFrame:
    """Training rows after the gate and oversampling, staged, with weights."""
    rows = smote(train, "y", cfg.neighbours, cfg.resample_ratio, cfg.resample_gate, cfg.seed)
    return with_weights(stage(rows, "train"), positive_weight)


def side_by_side(jobs: list, workers: int) -> list:
    """Results of functions that run Spark jobs, ``workers`` at a time, in order."""
    with ThreadPoolExecutor(max_workers=max(1, workers)) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(job)) for job in jobs]]


def compact(rows: DataFrame, count: int) -> DataFrame:
    """``rows`` in as many partitions as their number is worth."""
    return rows.coalesce(max(1, -(-count // TASK_ROWS))).cache()


def cross_validate(estimators: dict[str, Estimator], train: DataFrame, cfg: TrainConfig, positive_weight: float) -> dict[str, tuple[float, float]]:
    """Mean and population deviation of the folds' ROC-AUC per model.

    All fits, of every model and fold, share one pool. Oversampling happens inside
    each fold's training part; ``leaky_folds`` oversamples before folding, as the
    published runs did.
    """
    source = resampled(train, cfg, positive_weight) if cfg.leaky_folds else train
    folded = stage(assign_folds(source.withColumn("stratum", F.col("y")), "key", "stratum", cfg.folds, cfg.seed), "folds")
    inside = not cfg.leaky_folds and rows_to_add(class_sizes(train, "y"), cfg.resample_ratio, cfg.resample_gate)[1] > 0
    weighted = folded if cfg.leaky_folds or inside else with_weights(folded, positive_weight)

    def prepared(fold: int) -> tuple[DataFrame, DataFrame]:
        part = weighted.filter(F.col("fold") != fold)
        part = resampled(part, cfg, positive_weight) if inside else part
        part = compact(part, part.count())
        held = folded.filter(F.col("fold") == fold)
        return part, compact(held, held.count())

    parts = side_by_side([partial(prepared, fold) for fold in range(cfg.folds)], cfg.parallelism)

    def one(name: str, fold: int) -> float:
        part, held = parts[fold]
        return exact_auc(scored_by(estimators[name].fit(part), held))

    # the last estimators take longest and so begin first
    names = list(reversed(estimators))
    found = side_by_side([partial(one, name, fold) for name in names for fold in range(cfg.folds)], cfg.parallelism)
    for part, held in parts:
        part.unpersist()
        held.unpersist()
    scores = {name: found[i * cfg.folds : (i + 1) * cfg.folds] for i, name in enumerate(names)}
    return {name: (statistics.fmean(scores[name]), statistics.pstdev(scores[name])) for name in estimators}


@dataclass
class Trained:
    """Fitted models by name, their metrics on the test rows and, once asked for, of the folds."""

    models: dict[str, Model]
    tested: list[tuple]
    scores: dict[str, DataFrame]
    folds: dict[str, tuple[float, float]] | None = None

    @property
    def best(self) -> str:
        return select_best(self.tested, at=1)

    @property
    def results(self) -> DataFrame:
        """The comparison table; its fold columns are NULL while the folds have not been fitted."""
        rows = [(name, *(self.folds[name] if self.folds else (None, None)), *metrics) for name, *metrics in self.tested]
        return SparkSession.active().createDataFrame(rows, RESULT_SCHEMA).orderBy(F.desc("test_roc_auc"))

    def best_tree(self) -> str:
        """The model with the highest test ROC-AUC among those that have feature importances."""
        trees = [row for row in self.tested if hasattr(self.models[row[0]], "featureImportances")]
        return select_best(trees, at=1)


def positive_weight_of(train: DataFrame) -> float:
    """The weight of a positive training row: negatives per positive."""
    sizes = class_sizes(train, "y")
    if len(sizes) < 2:
        raise ValueError("training rows must have both classes")
    return sizes[0] / sizes[1]


def fit_models(train: DataFrame, test: DataFrame, cfg: TrainConfig) -> Trained:
    """Fit every model on all training rows and evaluate it on the test rows; no folds.

    ``train`` and ``test`` are staged (key, y, features) tables. Models are fitted
    side by side; every fit and evaluation is distributed.
    """
    rows = resampled(train, cfg, positive_weight_of(train))
    count = rows.count()
    rows = compact(rows, count)
    estimators = make_models(cfg, count)

    def fitted(name: str) -> tuple[Model, DataFrame, tuple]:
        model = estimators[name].fit(rows)
        scored = stage(scored_by(model, test), "scored")
        m = V.metrics_of(V.confusion(scored, predicted="predicted")).first()
        return model, scored, (name, exact_auc(scored), m.accuracy, m.precision, m.recall, m.f1)

    names = list(reversed(estimators))
    found = dict(zip(names, side_by_side([partial(fitted, name) for name in names], cfg.parallelism)))
    rows.unpersist()
    return Trained(
        {name: found[name][0] for name in estimators},
        [found[name][2] for name in estimators],
        {name: found[name][1] for name in estimators},
    )


def fit_folds(train: DataFrame, cfg: TrainConfig) -> dict[str, tuple[float, float]]:
    """Cross-validated ROC-AUC (mean, deviation) of every model over all training rows; needs no final fit."""
    return cross_validate(make_models(cfg, train.count()), train, cfg, positive_weight_of(train))


def select_best(results: list[tuple], at: int = 3) -> str:
    """Name of the model with the highest test ROC-AUC; the first one wins a tie."""
    return max(results, key=lambda r: r[at])[0]


# saving and scoring


@dataclass
class SuccessModel:
    """The whole fitted pipeline: raw dataset row in, probability out."""

    name: str
    pipeline: PipelineModel
    features: tuple[str, ...]

    @property
    def model(self) -> Model:
        return self.pipeline.stages[-1]

    @property
    def preparation(self) -> PipelineModel:
        return PipelineModel(stages=self.pipeline.stages[:-1])

    def score(self, df: DataFrame, threshold: float = 0.5) -> DataFrame:
        """``df`` (batch or streaming) with ``probability_of_success`` and ``is_predicted``."""
        scored = self.pipeline.transform(df)
        probability = vector_to_array("probability")[1]
        return scored.select(
            *df.columns,
            probability.alias("probability_of_success"),
            F.when(probability >= threshold, 1).otherwise(0).alias("is_predicted"),
        )


def bundle(name: str, preparation: Preparation, model: Model) -> SuccessModel:
    stages = [*preparation.transformer().stages, model]
    return SuccessModel(name, PipelineModel(stages=stages), preparation.lists.all)


def save_model(fitted: SuccessModel, folder: str) -> None:
    """Write the pipeline and the feature names."""
    fitted.pipeline.write().overwrite().save(f"{folder}/pipeline")
    rows = [(fitted.name, i, feature) for i, feature in enumerate(fitted.features)]
    spark = SparkSession.active()
    names = spark.createDataFrame(rows, "model STRING, position INT, feature STRING")
    names.coalesce(1).write.mode("overwrite").parquet(f"{folder}/features")


def load_model(folder: str) -> SuccessModel:
    spark = SparkSession.active()
    # one row per feature
    rows = spark.read.parquet(f"{folder}/features").orderBy("position").collect()
    return SuccessModel(
        rows[0]["model"], PipelineModel.load(f"{folder}/pipeline"), tuple(r["feature"] for r in rows)
    )
