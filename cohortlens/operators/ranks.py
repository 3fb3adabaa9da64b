"""Exact global prefix sums, quantiles and ranks without a single-task window.

Rows are cut into ordered buckets, the bucket totals (a small table of bounded
size) give each bucket its offset, and the window runs inside a bucket.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import DataFrame, Window, functions as F

from cohortlens.storage import stage

# the functions below travel with the task, so executors need not have the package
register_pickle_by_value(sys.modules[__name__])

# accuracy of the sketches that bracket a quantile: off by a thousandth of the rows at most
SKETCH = 1000


def bucket_count(df: DataFrame) -> int:
    """As many buckets as shuffle partitions, within what a broadcast table of offsets may hold."""
    return min(4096, max(8, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def running_totals(
    counts: DataFrame,
    order: str,
    sums: Sequence[str],
    parts: Sequence[str] = (),
    buckets: int | None = None,
    bucket_sql: str | None = None,
) -> DataFrame:
    """Add ``<sum>_to`` (ascending prefix sum up to and including the row) and ``<sum>_all``.

    ``counts`` has one row per (parts, order) - aggregate first - and should be a
    staged table, since it is read three times. ``parts`` takes few values.
    ``bucket_sql`` gives ready-made ordered buckets, such as the head of a hash.
    """
    if not parts:
        counts, parts = counts.withColumn("part_all", F.lit(0)), ["part_all"]
    if bucket_sql is not None:
        cut = counts.withColumn("bucket", F.expr(bucket_sql))
    else:
        buckets = buckets or bucket_count(counts)
        # cut points balance the distinct values; any cut points give the same sums
        shares = ", ".join(str(i / buckets) for i in range(1, buckets))
        cuts = counts.groupBy(*parts).agg(
            F.expr(f"percentile_approx({order}, array({shares}), {max(1000, 20 * buckets)})").alias("cuts")
        )
        # at most `buckets` values per part
        cut = counts.join(F.broadcast(cuts), list(parts)).withColumn(
            "bucket", F.expr(f"size(filter(cuts, c -> c < {order}))")
        ).drop("cuts")
    totals = cut.groupBy(*parts, "bucket").agg(*[F.sum(s).alias(s) for s in sums])
    before = Window.partitionBy(*parts).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*parts)
    offsets = totals.select(
        *parts,
        "bucket",
        *[F.coalesce(F.sum(s).over(before), F.lit(0)).alias(f"{s}_before") for s in sums],
        *[F.sum(s).over(whole).alias(f"{s}_all") for s in sums],
    )
    inside = (
        Window.partitionBy(*parts, "bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    )
    # one row per bucket
    return (
        cut.join(F.broadcast(offsets), [*parts, "bucket"])
        .withColumns({f"{s}_to": F.sum(s).over(inside) + F.col(f"{s}_before") for s in sums})
        .drop("bucket", "part_all", *[f"{s}_before" for s in sums])
    )


def value_quantiles(
    df: DataFrame, columns: Sequence[str], shares: dict[str, float], by: Sequence[str] = ()
) -> DataFrame:
    """(by, feature, one column per share): exact linearly interpolated quantiles of ``columns``, in two passes.

    The first pass brackets every quantile by approximate ones (one aggregate, a
    row per group). In the second each task counts the values below a bracket and
    sends only the distinct values inside it. NULL and NaN are left out, and so are
    rows with a NULL group; the groups are few. Give a staged table, as it is read twice.
    """
    by, columns, names = list(by), list(columns), list(shares)
    value = "nullif(CAST(`{0}` AS DOUBLE), CAST('NaN' AS DOUBLE))"
    rows = df.select(*by, *[F.expr(value.format(c)).alias(f"v{i}") for i, c in enumerate(columns)]).dropna(subset=by)
    slack = 2 / SKETCH
    asked = ", ".join(f"{max(0.0, s - slack)!r}D, {min(1.0, s + slack)!r}D" for s in shares.values())
    sketches = []
    for i in range(len(columns)):
        sketches += [F.expr(f"{f}(v{i})").alias(f"{f}{i}") for f in ("count", "min", "max")]
        sketches.append(F.expr(f"percentile_approx(v{i}, array({asked}), {SKETCH})").alias(f"cuts{i}"))
    brackets: dict[tuple, list[tuple[float, float]]] = {}
    # one row per group
    for r in (rows.groupBy(*by) if by else rows).agg(*sketches).collect():
        for i in range(len(columns)):
            n, low, high, cuts = (r[f"{f}{i}"] for f in ("count", "min", "max", "cuts"))
            if n:
                # few rows are all inside: there a sketch may be off by a place
                pairs = list(zip(cuts[::2], cuts[1::2])) if n > 10 * SKETCH else [(low, high)] * len(names)
                brackets[tuple(r[c] for c in by), i] = pairs

    def inside(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for group, part in batch.groupby(by, sort=False) if by else [((), batch)]:
                for i in range(len(columns)):
                    values = part[f"v{i}"].to_numpy(dtype=np.float64)
                    values, n = np.unique(values[~np.isnan(values)], return_counts=True)
                    for name, (lo, hi) in zip(names, brackets.get((group, i), ())):
                        start, stop = np.searchsorted(values, lo, "left"), np.searchsorted(values, hi, "right")
                        head = (*group, columns[i], name)
                        # the value of what lies below is NULL
                        found.append((*head, None, n[:start].sum(), n.sum()))
                        found += [(*head, v, m, 0) for v, m in zip(values[start:stop], n[start:stop])]
            yield pd.DataFrame(found, columns=[*by, "feature", "share", "value", "n", "n_all"])

    kinds = dict(df.dtypes)
    keys = [*by, "feature", "share"]
    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in by], "feature string, share string, value double, n bigint, n_all bigint"])
    sent = rows.mapInPandas(inside, schema).groupBy(*keys, "value").agg(F.sum("n").alias("n"), F.sum("n_all").alias("n_all"))
    sent = stage(sent, "brackets")
    # one row per quantile
    below = sent.where("value IS NULL").select(*keys, F.col("n").alias("below"), F.col("n_all").alias("whole"))
    running = running_totals(sent.where("value IS NOT NULL").select(*keys, "value", "n"), "value", ["n"], keys)
    shares_of = F.create_map(*[F.lit(x) for item in shares.items() for x in item])
    at = running.join(F.broadcast(below), keys).withColumn("at", F.expr("whole - 1") * shares_of[F.col("share")])
    covers = "below + n_to - n <= {0}(at) AND {0}(at) < below + n_to"
    ends = [F.expr(f"max(CASE WHEN {covers.format(f)} THEN value END)").alias(f) for f in ("floor", "ceil")]
    found = at.groupBy(*keys).agg(*ends, F.expr("max(at - floor(at))").alias("part"))
    # never reached while a sketch keeps its bound
    lost = "CAST(raise_error('a quantile lies outside its bracket') AS DOUBLE)"
    exact = F.expr(f"coalesce(floor + (ceil - floor) * part, {lost})").alias("exact")
    return found.select(*keys, exact).groupBy(*by, "feature").pivot("share", names).agg(F.first("exact"))


def hash_rank(df: DataFrame, key: str, part: str, seed: int, digits: int = 3) -> DataFrame:
    """Add ``shuffle_rank``: 1-based position in a seeded shuffle within each ``part``.

    The order is that of ``md5(seed|key)``; its first hex digits are evenly filled
    buckets. Also adds ``part_rows``. Give a staged table.
    """
    hashed = df.withColumn("shuffle_hash", F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string"))))
    hashed = hashed.withColumn("bucket", F.substring("shuffle_hash", 1, digits))
    totals = hashed.groupBy(part, "bucket").agg(F.count(F.lit(1)).alias("n"))
    by_part = Window.partitionBy(part).orderBy("bucket")
    # at most 16^digits rows per part; the grand total is a sum over parts
    offsets = totals.select(
        F.col(part).alias("offset_part"),
        F.col("bucket").alias("offset_bucket"),
        F.coalesce(F.sum("n").over(by_part.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
        F.sum("n").over(Window.partitionBy(part)).alias("part_rows"),
    )
    ranked = hashed.join(
        F.broadcast(offsets),
        F.col(part).eqNullSafe(F.col("offset_part")) & (F.col("bucket") == F.col("offset_bucket")),
    )
    inside = Window.partitionBy(part, "bucket").orderBy("shuffle_hash", key)
    return ranked.withColumn("shuffle_rank", F.row_number().over(inside) + F.col("before")).drop(
        "shuffle_hash", "bucket", "offset_part", "offset_bucket", "before"
    )
