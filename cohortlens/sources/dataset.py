"""The wide dataset as files: explicit schema, CSV with missing-value rules, sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

# The 40 columns of the wide dataset in order.
METADATA_COLUMNS = (
    "repo_id",
    "repo_name",
    "primary_language",
    "description",
    "repo_created_at",
    "creator_id",
    "creator_login",
)
EARLY_COLUMNS = (
    "push_events_30d",
    "total_commits_30d",
    "issue_events_30d",
    "issues_opened_30d",
    "issues_closed_30d",
    "issue_comments_30d",
    "pr_events_30d",
    "prs_opened_30d",
    "prs_closed_30d",
    "pr_reviews_30d",
    "stars_30d",
    "forks_30d",
    "unique_contributors_30d",
    "unique_committers_30d",
    "events_week_1",
    "events_week_2",
    "events_week_3",
    "events_week_4",
    "total_events_30d",
)
OUTCOME_COLUMNS = (
    "total_stars_6m",
    "total_forks_6m",
    "total_contributors_6m",
    "total_committers_6m",
    "pushes_months_4_to_6",
    "issues_months_4_to_6",
    "prs_months_4_to_6",
    "contributors_months_4_to_6",
    "total_releases_6m",
    "total_events_6m",
)
LABEL_COLUMNS = (
    "is_starred_project",
    "has_community",
    "is_actively_maintained",
    "is_successful_project",
)

# Field texts that mean "missing" to the reader of the reference data.
NA_VALUES = (
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
)


def _field(name: str) -> T.StructField:
    kinds = {
        "repo_name": T.StringType(),
        "primary_language": T.StringType(),
        "description": T.StringType(),
        "repo_created_at": T.TimestampType(),
        "creator_login": T.StringType(),
    }
    label = T.IntegerType() if name in LABEL_COLUMNS else T.LongType()
    return T.StructField(name, kinds.get(name, label))


DATASET_SCHEMA = T.StructType(
    [_field(c) for c in METADATA_COLUMNS + EARLY_COLUMNS + OUTCOME_COLUMNS + LABEL_COLUMNS]
)


def _csv_text(spark: SparkSession, path: str, schema: T.StructType, multi_line: bool, header: bool) -> DataFrame:
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in schema])
    return (
        spark.read.schema(text)
        .option("header", header)
        .option("multiLine", multi_line)
        .option("quote", '"')
        .option("escape", '"')
        .option("emptyValue", "")
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .option("enforceSchema", False)
        .csv(path)
    )


def read_dataset_csv(
    spark: SparkSession,
    path: str,
    schema: T.StructType = DATASET_SCHEMA,
    na_values: Sequence[str] = NA_VALUES,
    multi_line: bool = True,
    header: bool = True,
) -> DataFrame:
    """Read the wide dataset from CSV; the ``na_values`` texts become NULL.

    Quoted fields may contain separators, doubled quotes and line breaks. Line
    breaks make a file unsplittable, so large data should come as many files
    (``write_dataset`` bounds them); ``multi_line=False`` splits every file.
    """
    raw = _csv_text(spark, path, schema, multi_line, header)
    columns = []
    for field in schema:
        value = F.when(~F.col(field.name).isin(*na_values), F.col(field.name))
        if isinstance(field.dataType, T.IntegralType):
            value = _whole(value, field)
        columns.append(value.cast(field.dataType).alias(field.name))
    return raw.select(*columns)


def _fits(text: Column, field: T.StructField) -> Column:
    """Whether a text is a whole number of the field's type, also written as "12.0" or "1.2e1"."""
    number = text.try_cast("decimal(38,10)")
    fits = (number == F.floor(number)) & number.cast("decimal(28,0)").try_cast(field.dataType.simpleString()).isNotNull()
    return F.coalesce(fits, F.lit(False))


def _whole(text: Column, field: T.StructField) -> Column:
    """A whole number; any other text ends the read with its value."""
    kind = field.dataType.simpleString()
    message = F.concat(F.lit(f"column {field.name}: no whole number of type {kind}: "), text)
    number = text.try_cast("decimal(38,10)")
    return F.when(text.isNull() | _fits(text, field), number).otherwise(F.raise_error(message).cast("decimal(38,10)"))


def refused_values(
    spark: SparkSession,
    path: str,
    schema: T.StructType = DATASET_SCHEMA,
    na_values: Sequence[str] = NA_VALUES,
    multi_line: bool = True,
    header: bool = True,
) -> DataFrame:
    """(column_name, value, n): texts that ``read_dataset_csv`` would refuse, and how often they occur.

    One scan; only refused values leave their task, combined there first.
    """
    raw = _csv_text(spark, path, schema, multi_line, header)
    bad = []
    for field in schema:
        text = F.when(~F.col(field.name).isin(*na_values), F.col(field.name))
        if isinstance(field.dataType, T.StringType):
            continue
        fits = _fits(text, field) if isinstance(field.dataType, T.IntegralType) else text.try_cast(field.dataType).isNotNull()
        bad.append(F.when(text.isNotNull() & ~fits, F.struct(F.lit(field.name).alias("column_name"), text.alias("value"))))
    found = raw.select(F.explode(F.filter(F.array(*bad), lambda x: x.isNotNull())).alias("bad"))
    return found.groupBy("bad.column_name", "bad.value").agg(F.count(F.lit(1)).alias("n"))


def write_dataset(
    df: DataFrame,
    path: str,
    fmt: str = "parquet",
    mode: str = "overwrite",
    max_records_per_file: int = 1_000_000,
) -> None:
    """Write as Parquet (default) or CSV in files of bounded size."""
    writer = df.write.mode(mode).option("maxRecordsPerFile", max_records_per_file)
    if fmt == "csv":
        writer = (
            writer.option("header", True)
            .option("quote", '"')
            .option("escape", '"')
            .option("timestampFormat", "yyyy-MM-dd HH:mm:ss.SSSSSS")
            .option("ignoreLeadingWhiteSpace", False)
            .option("ignoreTrailingWhiteSpace", False)
        )
    elif fmt != "parquet":
        raise ValueError(f"fmt: {fmt!r}")
    writer.format(fmt).save(path)


def profile_schema(df: DataFrame) -> DataFrame:
    """One row per column: position, name, type, non-null count, row and column count."""
    counts = [F.count(F.col(c)).alias(f"n{i}") for i, c in enumerate(df.columns)]
    totals = df.agg(F.count(F.lit(1)).alias("n_rows"), *counts)
    rows = [
        F.struct(
            F.lit(i + 1).alias("position"),
            F.lit(name).alias("column_name"),
            F.lit(kind).alias("data_type"),
            F.col(f"n{i}").alias("non_null"),
            F.col("n_rows"),
            F.lit(len(df.columns)).alias("n_columns"),
        )
        for i, (name, kind) in enumerate(df.dtypes)
    ]
    return totals.select(F.inline(F.array(*rows)))
