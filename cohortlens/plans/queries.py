"""Named queries over the given tables, one or more per operator."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession, functions as F

from cohortlens.config import TrainConfig
from cohortlens.functions import activity_level, json_scalar
from cohortlens.operators import cohort as C
from cohortlens.operators import evaluate as V
from cohortlens.operators import explain as X
from cohortlens.operators import features as E
from cohortlens.operators import metrics as M
from cohortlens.operators import models as D
from cohortlens.operators import profile as P
from cohortlens.operators import sampling as S
from cohortlens.operators.smote import smote as oversample
from cohortlens.plans import archive
from cohortlens.plans.dataset import combined_dataset
from cohortlens.sources.dataset import (
    EARLY_COLUMNS,
    OUTCOME_COLUMNS,
    profile_schema,
    read_dataset_csv,
    refused_values,
    write_dataset,
)
from cohortlens.sources.events import canonical_events, read_events, write_events
from cohortlens.sources.tables import (
    PART_CONFIG,
    USER_CONFIG,
    half_year_events,
    part_cohort,
    part_events,
    user_archive,
    user_events,
)
from cohortlens.plans.training_run import Run, load_run, run_training, shapley_table, train_and_evaluate
from cohortlens.storage import scratch_dir, stage

# At sf0.01 about half of the languages have fewer entities than this.
RARE_BELOW = 78
TARGET = P.TARGET
# inside the month that the events span
SHARD_BOUNDS = ("2024-01-08", "2024-01-21")
USER_PAIRS = USER_CONFIG.but(unique=False, null_size="skip")

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    """Register a query; timestamps leave without zone, doubles with 6 digits."""

    def plain(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = function(spark, sf_dir)
        kinds = {"timestamp": "CAST(`{0}` AS TIMESTAMP_NTZ)", "double": "round(`{0}`, 6)"}
        changed = {c: F.expr(kinds[t].format(c)) for c, t in df.dtypes if t in kinds}
        return df.withColumns(changed) if changed else df

    QUERIES[function.__name__] = plain
    return function


def part_dataset(spark: SparkSession, sf_dir: str, ordered: bool = False) -> DataFrame:
    events = part_events(spark, sf_dir)
    return combined_dataset(events, PART_CONFIG, part_cohort(spark, sf_dir), ordered=ordered)


def staged_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part dataset, staged because its reader reads it more than once."""
    return stage(part_dataset(spark, sf_dir), "dataset")


def scored(dataset: DataFrame) -> DataFrame:
    """Rows scored with fixed weights, rounded so that ties occur."""
    z = "0.55D * stars_30d + 0.12D * total_events_30d + 0.05D * unique_contributors_30d - 2.1D"
    return dataset.selectExpr(
        "repo_id", f"{TARGET} AS y", f"round(1D / (1D + exp(-({z}))), 4) AS score"
    )


# cohorts and metrics


def _canonical(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("entity_id").alias("repo_id"),
        F.col("entity_name").alias("repo_name"),
        "event_type",
        "actor_id",
        "actor_login",
        "event_time",
        json_scalar(F.col("payload"), "$.ref_type").alias("ref_type"),
        json_scalar(F.col("payload"), "$.action").alias("action"),
        json_scalar(F.col("payload"), "$.size", "bigint").alias("size"),
        json_scalar(F.col("payload"), "$.repository").alias("nested"),
    )


@query
def canonical(spark, sf_dir):
    return _canonical(user_events(spark, sf_dir))


@query
def canonical_kinds(spark, sf_dir):
    kinds = (M.PUSH, M.STAR, M.ISSUES, "CreateEvent")
    return _canonical(user_events(spark, sf_dir).filter(F.col("event_type").isin(*kinds)))


def _scratch(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query
def day_shards(spark, sf_dir):
    """Two weeks of an archive with a folder per day, whose bounds prune folders."""
    path = _scratch(spark, "archive")
    write_events(user_archive(spark, sf_dir), path)
    return _canonical(canonical_events(read_events(spark, path, *SHARD_BOUNDS, fmt="parquet")))


@query
def new_entities(spark, sf_dir):
    return C.new_entities(user_events(spark, sf_dir), USER_CONFIG)


@query
def cohort_attrs(spark, sf_dir):
    rows = C.cohort(user_events(spark, sf_dir), USER_PAIRS, C.FULL_ATTRIBUTES)
    return rows.withColumnsRenamed({"entity_id": "repo_id", "entity_name": "repo_name"})


@query
def cohort_first_event(spark, sf_dir):
    rows = part_cohort(spark, sf_dir)
    return rows.withColumnsRenamed({"entity_id": "repo_id", "entity_name": "repo_name"})


@query
def first_seen(spark, sf_dir):
    rows = C.cohort(user_events(spark, sf_dir), USER_PAIRS, ["entity_name"])
    return rows.withColumnsRenamed({"entity_id": "repo_id", "entity_name": "repo_name"})


def _user_cohort(spark, sf_dir):
    return stage(C.cohort(user_events(spark, sf_dir), USER_PAIRS, ["entity_name"]), "cohort")


@query
def early_metrics(spark, sf_dir):
    return M.early_metrics(user_events(spark, sf_dir), _user_cohort(spark, sf_dir), USER_PAIRS)


@query
def sustained_metrics(spark, sf_dir):
    cfg = USER_PAIRS.but(sustain_from=14)
    return M.sustained_metrics(user_events(spark, sf_dir), _user_cohort(spark, sf_dir), cfg)


@query
def cumulative_totals(spark, sf_dir):
    return M.cohort_totals(user_events(spark, sf_dir), _user_cohort(spark, sf_dir), USER_PAIRS)


@query
def cumulative_totals_shuffled(spark, sf_dir):
    cohort_rows = _user_cohort(spark, sf_dir)
    return M.cohort_totals(user_events(spark, sf_dir), cohort_rows, USER_PAIRS, "shuffle")


@query
def cumulative_totals_salted(spark, sf_dir):
    """Entities with a thousandth of the events, 40 at least, are spread over all partitions."""
    cfg = USER_PAIRS.but(heavy_share=0.001, heavy_min_rows=40)
    return M.cohort_totals(user_events(spark, sf_dir), _user_cohort(spark, sf_dir), cfg, "shuffle")


def _part_metrics(spark, sf_dir, bundle):
    cohort_rows = stage(C.cohort(part_events(spark, sf_dir), PART_CONFIG), "cohort")
    metrics = bundle(PART_CONFIG)
    attached, rows = C.attach_counted(
        part_events(spark, sf_dir), cohort_rows, 0, PART_CONFIG.horizon_days, PART_CONFIG
    )
    return M.entity_metrics(attached, ["entity_id"], metrics, rows=rows).withColumnRenamed("entity_id", "repo_id")


@query
def early_metrics_q5(spark, sf_dir):
    return _part_metrics(spark, sf_dir, M.early_features)


@query
def outcome_metrics(spark, sf_dir):
    return _part_metrics(spark, sf_dir, M.outcomes)


@query
def combined_dataset_parts(spark, sf_dir):
    return part_dataset(spark, sf_dir, ordered=True)


@query
def combined_dataset_users(spark, sf_dir):
    return combined_dataset(user_events(spark, sf_dir), USER_CONFIG)


@query
def combined_fanout(spark, sf_dir):
    return combined_dataset(user_events(spark, sf_dir), USER_CONFIG.but(unique=False))


@query
def first_rows(spark, sf_dir):
    return part_dataset(spark, sf_dir, ordered=True).limit(100)


@query
def csv_round_trip(spark, sf_dir):
    """The dataset after CSV: quoted text over several lines, words that mean missing, whole numbers with a point."""
    path = _scratch(spark, "csv")
    description = r"""CASE repo_id % 5 WHEN 0 THEN 'None'
        WHEN 1 THEN concat(description, '\n"quoted", twice: ""', repo_id, '\n\n ') ELSE description END"""
    changed = {"description": F.expr(description), "stars_30d": F.col("stars_30d").cast("double")}
    write_dataset(part_dataset(spark, sf_dir).withColumns(changed), path, "csv")
    return read_dataset_csv(spark, path)


@query
def csv_refused(spark, sf_dir):
    """Values that a reader of the dataset would refuse, counted beside the read."""
    path = _scratch(spark, "csv")
    planted = {
        "stars_30d": F.expr("CASE WHEN repo_id % 4 = 0 THEN concat('n', repo_id % 3) ELSE CAST(stars_30d AS STRING) END"),
        "forks_30d": F.expr("CASE WHEN repo_id % 7 = 0 THEN '1.5' ELSE CAST(forks_30d AS STRING) END"),
    }
    write_dataset(part_dataset(spark, sf_dir).withColumns(planted), path, "csv")
    return refused_values(spark, path)


# the published reports with their own dates, windows and floors


@query
def archive_new_entities(spark, sf_dir):
    return archive.new_repositories(user_events(spark, sf_dir))


@query
def archive_early_metrics(spark, sf_dir):
    return archive.early_activity(user_events(spark, sf_dir))


@query
def archive_cumulative_totals(spark, sf_dir):
    return archive.cumulative_totals(user_events(spark, sf_dir))


@query
def archive_combined_dataset(spark, sf_dir):
    return archive.combined_dataset(user_events(spark, sf_dir))


@query
def archive_combined_faithful(spark, sf_dir):
    return archive.combined_dataset(user_events(spark, sf_dir), faithful=True)


@query
def archive_sustained_metrics(spark, sf_dir):
    return archive.sustained_activity(half_year_events(spark, sf_dir))


@query
def archive_half_year_dataset(spark, sf_dir):
    """The published dataset on events that reach over its dates and windows."""
    return archive.combined_dataset(half_year_events(spark, sf_dir))


# profile


@query
def dataset_schema(spark, sf_dir):
    return profile_schema(part_dataset(spark, sf_dir))


@query
def value_counts(spark, sf_dir):
    return P.value_counts(staged_dataset(spark, sf_dir), TARGET)


@query
def class_ratio(spark, sf_dir):
    return P.class_ratio(part_dataset(spark, sf_dir))


@query
def top_languages(spark, sf_dir):
    return P.top_k(part_dataset(spark, sf_dir), "primary_language", 15)


@query
def success_by_language(spark, sf_dir):
    dataset = staged_dataset(spark, sf_dir)
    return P.rate_by(P.semi_join_top_k(dataset, "primary_language", 10), "primary_language")


@query
def success_by_activity(spark, sf_dir):
    dataset = part_dataset(spark, sf_dir)
    level = activity_level(F.col("total_events_30d"), (0, 3, 5, 8, 12, float("inf")))
    return P.rate_by(dataset.withColumn("activity_level", level), "activity_level")


@query
def weekly_trend(spark, sf_dir):
    return P.weekly_trend(part_dataset(spark, sf_dir))


@query
def class_comparison(spark, sf_dir):
    return P.class_means(part_dataset(spark, sf_dir), EARLY_COLUMNS)


@query
def successful_rows(spark, sf_dir):
    return P.by_class(part_dataset(spark, sf_dir), 1).select("repo_id", *P.WEEK_COLUMNS)


def _grouped(spark, sf_dir):
    cleaned = E.clean_metadata(staged_dataset(spark, sf_dir))
    categories = E.fit_categories(cleaned, "primary_language", RARE_BELOW)
    return E.group_rare(cleaned, "primary_language", categories), categories


@query
def group_insights(spark, sf_dir):
    return P.group_insights(_grouped(spark, sf_dir)[0], "language_grouped", RARE_BELOW)


@query
def missing_report(spark, sf_dir):
    return P.missing_report(part_dataset(spark, sf_dir))


@query
def coverage(spark, sf_dir):
    return P.coverage(part_dataset(spark, sf_dir))


@query
def describe_numeric(spark, sf_dir):
    return P.describe_numeric(staged_dataset(spark, sf_dir), EARLY_COLUMNS + OUTCOME_COLUMNS)


@query
def corr_target(spark, sf_dir):
    dataset = part_dataset(spark, sf_dir)
    return P.corr_with(dataset, P.numeric_columns(dataset, P.CORRELATION_EXCLUDES))


@query
def corr_matrix(spark, sf_dir):
    return P.corr_matrix(part_dataset(spark, sf_dir))


@query
def histogram(spark, sf_dir):
    return P.histogram(staged_dataset(spark, sf_dir), P.HISTOGRAM_COLUMNS, 50, 0.1)


@query
def box_stats(spark, sf_dir):
    return P.box_stats(part_dataset(spark, sf_dir))


@query
def category_counts(spark, sf_dir):
    return P.category_counts(part_dataset(spark, sf_dir), "primary_language", RARE_BELOW)


# features


@query
def grouped_language(spark, sf_dir):
    return _grouped(spark, sf_dir)[0].select("repo_id", "has_description", "language_grouped")


@query
def one_hot(spark, sf_dir):
    grouped, categories = _grouped(spark, sf_dir)
    hot = E.one_hot(grouped, "language_grouped", categories)
    sums = hot.agg(Summarizer.sum(F.col("language_vector")).alias("sums"), F.count(F.lit(1)).alias("n_rows"))
    names = F.array(*[F.lit(n) for n in E.one_hot_names(categories)])
    pairs = F.arrays_zip(names.alias("feature"), vector_to_array("sums").alias("ones"))
    long = sums.select(F.explode(pairs).alias("pair"), "n_rows")
    return long.select("pair.feature", F.col("pair.ones").cast("bigint").alias("ones"), "n_rows")


@query
def engineered(spark, sf_dir):
    return E.engineer_features(part_dataset(spark, sf_dir)).select("repo_id", *E.ENGINEERED)


@query
def scaled(spark, sf_dir):
    """All rows, scaled by what the training part gives."""
    dataset = stage(E.engineer_features(part_dataset(spark, sf_dir)), "features")
    columns = E.feature_lists([]).scaled
    part = S.stratified_split(dataset.select("repo_id", TARGET), "repo_id", TARGET)
    train = dataset.join(part.where("is_test = 0").select("repo_id"), "repo_id")
    return E.fit_scaler(train, columns).transform(dataset).select("repo_id", *columns)


# splits and samples


@query
def split(spark, sf_dir):
    dataset = staged_dataset(spark, sf_dir).select("repo_id", TARGET)
    return S.stratified_split(dataset, "repo_id", TARGET)


@query
def folds(spark, sf_dir):
    dataset = staged_dataset(spark, sf_dir).select("repo_id", TARGET)
    return S.assign_folds(dataset, "repo_id", TARGET)


@query
def sample(spark, sf_dir):
    return S.bounded_sample(part_dataset(spark, sf_dir), "repo_id", 100).select("repo_id")


# evaluation of fixed scores


@query
def confusion(spark, sf_dir):
    return V.confusion(scored(part_dataset(spark, sf_dir)))


@query
def binary_metrics(spark, sf_dir):
    return V.binary_metrics(scored(part_dataset(spark, sf_dir)))


@query
def classification_report(spark, sf_dir):
    return V.classification_report(scored(part_dataset(spark, sf_dir)))


@query
def roc_auc(spark, sf_dir):
    return V.roc_auc(scored(part_dataset(spark, sf_dir)))


@query
def roc_curve(spark, sf_dir):
    return V.roc_curve(scored(part_dataset(spark, sf_dir)))


@query
def pr_curve(spark, sf_dir):
    return V.pr_curve(scored(part_dataset(spark, sf_dir)))


@query
def average_precision(spark, sf_dir):
    return V.average_precision(scored(part_dataset(spark, sf_dir)))


@query
def score_histogram(spark, sf_dir):
    return V.score_histogram(stage(scored(part_dataset(spark, sf_dir)), "scored"))


@query
def threshold_table(spark, sf_dir):
    return V.threshold_table(scored(part_dataset(spark, sf_dir)))


# training, scoring and explanation with the published settings


@query
def class_weights(spark, sf_dir):
    return D.class_weights(staged_dataset(spark, sf_dir), TARGET)


CONFIG = TrainConfig(rare_below=RARE_BELOW)
_RUNS: dict[tuple[str, str], Run] = {}


def training(spark: SparkSession, sf_dir: str) -> Run:
    """The six final fits on the part dataset, made once per session and data folder; no folds."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _RUNS:
        _RUNS[key] = train_and_evaluate(part_dataset(spark, sf_dir), CONFIG, folds=False)
    return _RUNS[key]


@query
def smote(spark, sf_dir):
    dataset = staged_dataset(spark, sf_dir)
    prepared = D.fit_preparation(D.fit_categories(dataset, CONFIG), dataset)
    rows = stage(D.assemble(dataset, prepared, CONFIG), "train")
    return oversample(rows).groupBy("y").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("key").startswith("made-")).alias("made")
    )


@query
def model_comparison(spark, sf_dir):
    """Test and fold metrics of the six models: this query alone fits the folds."""
    run = training(spark, sf_dir)
    if run.trained.folds is None:
        run.trained.folds = D.fit_folds(run.train, CONFIG)
    return run.trained.results


@query
def comparison_recomputed(spark, sf_dir):
    """Models whose row of the comparison is not what their stored test scores give: none of the six."""
    run = training(spark, sf_dir)
    rows = []
    for name, scored in run.trained.scores.items():
        counts = scored.agg(
            F.count_if(F.expr("y = 1 AND predicted = 1")).alias("tp"),
            F.count_if(F.expr("y = 0 AND predicted = 1")).alias("fp"),
            F.count_if(F.expr("y = 1 AND predicted = 0")).alias("fn"),
            F.count(F.lit(1)).alias("n"),
        )
        # a way of its own: the comparison asks Spark's evaluator
        auc = V.roc_auc(scored.select("y", "score")).first()[0]
        rows.append(counts.select(F.lit(name).alias("model"), F.lit(auc).alias("auc"), "*"))
    found = rows[0]
    for more in rows[1:]:
        found = found.unionByName(more)
    both = found.join(run.trained.results, "model").withColumns(
        {"precision": F.expr("tp / nullif(tp + fp, 0)"), "recall": F.expr("tp / nullif(tp + fn, 0)")}
    )
    off = "abs(coalesce(precision, 0) - test_precision) > 1e-9 OR abs(coalesce(recall, 0) - test_recall) > 1e-9 OR abs(auc - test_roc_auc) > 1e-9"
    return both.agg(F.count(F.lit(1)).alias("models"), F.min("n").alias("test_rows"), F.count_if(F.expr(off)).alias("different"))


@query
def score_new(spark, sf_dir):
    """Rows scored by the best of the six models after saving and loading it."""
    run = training(spark, sf_dir)
    folder = f"{scratch_dir(spark)}/saved-{uuid.uuid4().hex}"
    D.save_model(run.fitted, folder)
    rows = D.load_model(folder).score(part_dataset(spark, sf_dir), 0.5)
    return rows.select("repo_id", "probability_of_success", "is_predicted")


@query
def score_new_checked(spark, sf_dir):
    """All rows: out of range, labels that do not follow the threshold, and differences between loaded and fitted model."""
    run = training(spark, sf_dir)
    folder = f"{scratch_dir(spark)}/saved-{uuid.uuid4().hex}"
    D.save_model(run.fitted, folder)
    rows = stage(part_dataset(spark, sf_dir), "dataset")
    fresh = run.fitted.score(rows, 0.5).select("repo_id", F.col("probability_of_success").alias("p"))
    both = D.load_model(folder).score(rows, 0.5).join(fresh, "repo_id")
    return both.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.expr("probability_of_success NOT BETWEEN 0 AND 1")).alias("outside"),
        F.count_if(F.expr("(probability_of_success >= 0.5) <> (is_predicted = 1)")).alias("mislabelled"),
        F.count_if(F.expr("abs(p - probability_of_success) > 1e-12")).alias("changed"),
    )


@query
def feature_importance(spark, sf_dir):
    run = training(spark, sf_dir)
    return X.feature_importance(spark, run.trained.models[run.trained.best_tree()], run.fitted.features)


@query
def shapley_summary(spark, sf_dir):
    return X.shapley_summary(shapley_table(training(spark, sf_dir))[0])


@query
def shapley_additive(spark, sf_dir):
    """Test rows, and those whose Shapley values do not sum with the base value to the model's output."""
    run = training(spark, sf_dir)
    table, base = shapley_table(run)
    name = run.trained.best_tree()
    model = run.trained.models[name]
    output = vector_to_array("rawPrediction")[1] if "GBT" in type(model).__name__ else vector_to_array("probability")[1]
    margins = model.transform(run.test).select("key", output.alias("margin"))
    sums = table.groupBy("key").agg((F.sum("phi") + F.lit(base)).alias("total"))
    both = margins.join(sums, "key")
    return both.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.expr("abs(margin - total) > 1e-6")).alias("off"))


@query
def shapley_rows(spark, sf_dir):
    """Per test row the values of the 20 top features (beeswarm data): rows per feature."""
    rows = X.shapley_rows(shapley_table(training(spark, sf_dir))[0])
    return rows.groupBy("place").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("key").alias("n_keys"))


@query
def run_summary(spark, sf_dir):
    return training(spark, sf_dir).summary


@query
def run_checked(spark, sf_dir):
    """A whole run from file to file: rows of its comparison, rows scored, and differences between what it wrote and what it held."""
    source, output = _scratch(spark, "input"), _scratch(spark, "run")
    write_dataset(part_dataset(spark, sf_dir), source)
    run = run_training(spark, source, output, CONFIG, folds=False)
    model, reports = load_run(spark, output)
    held = run.fitted.score(run.dataset).select("repo_id", F.col("probability_of_success").alias("p"))
    both = model.score(run.dataset).join(held, "repo_id")
    summary = run.summary.exceptAll(reports["summary"]).count() + run.trained.results.exceptAll(reports["model_comparison"]).count()
    return both.agg(
        F.lit(reports["model_comparison"].count()).alias("models"),
        F.count(F.lit(1)).alias("n"),
        (F.count_if(F.expr("abs(p - probability_of_success) > 1e-12")) + F.lit(summary)).alias("different"),
    )
