"""Oversampling of the minority class by interpolation between near neighbours.

Copies of the same point are handled once, with their number: a point that occurs
more than k times has only copies of itself among its k neighbours, so its
synthetic rows are copies too and need no search. Random choices are hashes of
the point and the running number, so that a recomputed task gives the same rows.
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, functions as F

from cohortlens.operators.neighbours import nearest
from cohortlens.operators.ranks import running_totals
from cohortlens.storage import stage

PIECE_ROWS = 10_000


def class_sizes(df: DataFrame, y: str) -> dict[int, int]:
    """Rows per class (the label takes few values)."""
    return {r[0]: r[1] for r in df.groupBy(y).count().collect()}


def rows_to_add(sizes: dict[int, int], ratio: float, gate: float) -> tuple[int, int]:
    """Minority class and synthetic rows it needs: 0 below the gate or at the target ratio."""
    minority = min(sizes, key=lambda c: (sizes[c], -c))
    majority = max(sizes.values())
    if len(sizes) < 2 or majority / sizes[minority] <= gate:
        return minority, 0
    return minority, max(0, int(majority * ratio - sizes[minority]))


def smote(
    df: DataFrame,
    y: str = "y",
    k: int = 5,
    ratio: float = 1.0,
    gate: float = 1.5,
    seed: int = 42,
    features: str = "features",
) -> DataFrame:
    """``df`` (staged; key string, y, features vector) with synthetic minority rows.

    Does nothing when majority/minority does not exceed ``gate`` or the minority
    already has ``ratio`` times the rows of the majority.
    """
    sizes = class_sizes(df, y)
    minority, needed = rows_to_add(sizes, ratio, gate)
    base = df.select("key", y, features)
    if needed == 0:
        return base
    made = synthetic_rows(base.filter(F.col(y) == minority), sizes[minority], needed, k, seed, features)
    label = F.lit(minority).cast(dict(df.dtypes)[y]).alias(y)
    return base.unionByName(
        made.select(F.col("key"), label, array_to_vector("x").alias(features))
    )


def synthetic_rows(rows: DataFrame, n_rows: int, needed: int, k: int, seed: int, features: str) -> DataFrame:
    """(key, pid, other, x): exactly ``needed`` interpolated rows of one class."""
    k = max(1, min(k, n_rows - 1))
    vectors = rows.select(vector_to_array(features).alias("x"))
    points = stage(
        vectors.groupBy("x").agg(F.count(F.lit(1)).alias("copies")).select(
            F.md5(F.col("x").cast("string")).alias("pid"), "x", "copies"
        ),
        "points",
    )
    # every row is base of needed/n_rows synthetic rows, evenly spread
    shares = running_totals(points, "pid", ["copies"], bucket_sql="substring(pid, 1, 2)")
    spread = f"CAST(floor({{0}} * CAST({needed} AS DECIMAL(20, 0)) / {n_rows}) AS BIGINT)"
    share = f"{spread.format('copies_to')} - {spread.format('(copies_to - copies)')}"
    shares = shares.select("pid", "x", "copies", F.expr(share).alias("made"))

    near = nearest(points, k, searchers=f"copies <= {k}")
    copies = points.select(F.col("pid").alias("other"), F.col("copies").alias("other_copies"))
    # at most k rows per point
    lists = near.join(copies, "other").groupBy("pid").agg(
        F.sort_array(F.collect_list(F.struct("place", "other", "other_copies"))).alias("near")
    )
    expanded = f"flatten(transform(near, n -> array_repeat(n.other, CAST(least(n.other_copies, {k}) AS INT))))"
    sources = shares.filter("made > 0").join(lists, "pid", "left").select(
        "pid", "x", "copies", "made", F.expr(expanded).alias("near")
    )
    # a point with many copies makes many rows: cut them into pieces over the tasks
    pieces = sources.withColumn("piece", F.explode(F.expr(f"sequence(0L, made - 1, {PIECE_ROWS}L)")))
    pieces = pieces.repartition("pid", "piece")
    numbered = pieces.withColumn(
        "number", F.explode(F.expr(f"sequence(piece, least(piece + {PIECE_ROWS}, made) - 1)"))
    )
    pick = F.expr(f"CAST(pmod(xxhash64({seed}, 1, pid, number), {k}) AS INT)")
    # the first neighbours are the other copies of the point itself
    other = F.expr("CASE WHEN pick >= copies - 1 THEN get(near, CAST(pick - (copies - 1) AS INT)) END")
    unit = F.expr(f"pmod(xxhash64({seed}, 2, pid, number), 9007199254740992L) / 9007199254740992D")
    chosen = numbered.withColumn("pick", pick).select(
        "pid", "x", "number", unit.alias("step"), F.coalesce(other, F.col("pid")).alias("other")
    )
    copied = chosen.filter("other = pid").select("pid", "other", "number", "x")
    ends = points.select(F.col("pid").alias("other"), F.col("x").alias("end"))
    moved = chosen.filter("other != pid").join(ends, "other").select(
        "pid", "other", "number", F.expr("zip_with(x, end, (a, b) -> a + step * (b - a))").alias("x")
    )
    made = copied.unionByName(moved)
    return made.select(F.concat_ws("-", F.lit("made"), "pid", "number").alias("key"), "pid", "other", "x")
