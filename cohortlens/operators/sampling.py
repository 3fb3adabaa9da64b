"""Seeded, repeatable splits, folds and samples by hashing the row key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from cohortlens.operators.ranks import hash_rank


def stratified_split(
    df: DataFrame, key: str, y: str, test_share: float = 0.2, seed: int = 42
) -> DataFrame:
    """Add ``is_test`` (0/1): ceil(share * N) test rows, spread over the classes exactly.

    Every class gives its proportional share to the training part; left-over
    places go to the classes with the largest fractions. Give a staged table.
    """
    ranked = hash_rank(df, key, y, seed)
    classes = df.groupBy(y).agg(F.count(F.lit(1)).alias("rows"))
    # one row per class
    everything = Window.partitionBy(F.lit(0))
    train_all = F.expr(f"all_rows - ceil(all_rows * {test_share}D)")
    quota = (
        classes.withColumn("all_rows", F.sum("rows").over(everything))
        .withColumn("exact", F.col("rows") * train_all / F.col("all_rows"))
        .withColumn("base", F.floor("exact"))
        .withColumn(
            "place",
            F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc(F.expr("exact - base")), F.asc(y))),
        )
        .withColumn("spare", train_all - F.sum("base").over(everything))
        .select(
            F.col(y).alias("quota_class"),
            F.expr("rows - base - CASE WHEN place <= spare THEN 1 ELSE 0 END").alias("test_rows"),
        )
    )
    split = ranked.join(F.broadcast(quota), F.col(y).eqNullSafe(F.col("quota_class")))
    is_test = F.when(F.col("shuffle_rank") <= F.col("test_rows"), 1).otherwise(0)
    return split.withColumn("is_test", is_test).drop("quota_class", "test_rows", "shuffle_rank", "part_rows")


def assign_folds(df: DataFrame, key: str, y: str, k: int = 5, seed: int = 42) -> DataFrame:
    """Add ``fold`` (0..k-1), balanced within each class. Give a staged table."""
    ranked = hash_rank(df, key, y, seed)
    fold = F.expr(f"CAST((shuffle_rank - 1) % {k} AS INT)")
    return ranked.withColumn("fold", fold).drop("shuffle_rank", "part_rows")


def bounded_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """The n rows first in a seeded shuffle (all rows if there are fewer)."""
    order = F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")))
    return df.orderBy(order, key).limit(n)
