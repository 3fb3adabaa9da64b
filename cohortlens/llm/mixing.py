"""Mixing sources to target weights by subset-sum budget fitting.

Every source gets a word target. The whole passes that fit into the target are
taken as they are (a document counts once per pass); for the rest of the target
documents are counted by (source, exact length in words), a proportional share
of each length is set aside, and a bounded knapsack over the remaining counts
finds the lengths whose sum comes nearest to what is then left. Which documents
of a length are taken is decided by a seeded hash of the document.

Only counts travel: text is read once, for its length. The knapsack runs once
per source over the histogram of lengths, which has one row per distinct length
however many documents there are; its table has one bit per word of the reserve
(four times the longest document, at most ``RESERVE_WORDS``). Documents are
chosen without gathering a length: hashes are cut into ``SLOTS`` ranges, ranges
are counted, and only the one range that the quota cuts is ranked.

Defined results: NULL and blank texts have size 0 and 0 words are taken of them.
The NULL source is a source of its own, ordered last. Repeated rows are
documents of their own. A source without words has target 0, an empty table an
empty result. Extra columns are ignored by ``mix``, kept by ``repeat_documents``.
"""

from __future__ import annotations

import sys
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.llm.common import WORD, fresh, staged

# the functions below travel with the task, so executors need not have the package
register_pickle_by_value(sys.modules[__name__])

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MAX_PASSES = 2.0
SLOTS = 4096
RESERVE_WORDS = 1 << 20


def targets(sizes: list[tuple[str | None, int]], weights: Sequence[float], share: float, most: float) -> list[float]:
    """Word targets of sources, in the order of their weights.

    ``share`` of all words is dealt by weight; a target stops at ``most`` times
    its source and the excess is dealt again among the others, until none is above.
    """
    limits = [most * n for _, n in sizes]
    weight = [float(weights[i % len(weights)]) for i in range(len(sizes))]
    out = [0.0] * len(sizes)
    open_, left = set(range(len(sizes))), share * sum(n for _, n in sizes)
    while open_:
        total = sum(weight[i] for i in sorted(open_))
        over = [i for i in sorted(open_) if left * weight[i] / total >= limits[i]]
        if not over:
            for i in sorted(open_):
                out[i] = left * weight[i] / total
            break
        for i in over:
            out[i] = limits[i]
            left -= limits[i]
            open_.discard(i)
    return out


def knapsack(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many of each length to take so that their sum is as near as possible to ``budget``.

    Bounded subset sum: counts are split into powers of two, the reachable sums
    are the bits of one number. Of two sums as near, the smaller is taken.
    """
    take = np.zeros(len(lengths), dtype=np.int64)
    if budget <= 0 or not len(lengths):
        return take
    cap = budget + int(lengths.max())
    mask = (1 << (cap + 1)) - 1
    reach, pieces = 1, []
    for i in np.argsort(-lengths, kind="stable").tolist():
        length, left, power = int(lengths[i]), int(min(counts[i], cap // max(1, int(lengths[i])))), 1
        while length and left:
            n = min(power, left)
            new = (reach | reach << (n * length)) & mask
            if new != reach:
                pieces.append((i, n, n * length, reach))
                reach = new
            left -= n
            power *= 2
        if reach >> budget & 1:
            break
    below = reach & ((1 << (budget + 1)) - 1)
    best = below.bit_length() - 1
    above = reach >> budget
    if above:
        up = budget + ((above & -above).bit_length() - 1)
        if up - budget < budget - best:
            best = up
    for i, n, size, before in reversed(pieces):
        if not before >> best & 1:
            take[i] += n
            best -= size
    return take


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """Counts to take of each length for ``budget`` words: a proportional share, then the knapsack."""
    order = np.argsort(lengths, kind="stable")
    size, have = lengths[order].astype(np.int64), counts[order].astype(np.int64)
    total = int((size * have).sum())
    if budget >= total:
        take = have.copy()
    else:
        reserve = min(budget, max(int(size.max()), min(4 * int(size.max()), RESERVE_WORDS)))
        part, carry = (budget - reserve) / total, 0.0
        take = np.zeros(len(size), dtype=np.int64)
        for i, (length, n) in enumerate(zip(size.tolist(), have.tolist())):
            if length:
                carry += part * n * length
                take[i] = min(n, int(carry // length))
                carry -= take[i] * length
        take += knapsack(size, have - take, budget - int((size * take).sum()))
    out = np.empty_like(take)
    out[order] = take
    return out


def _quotas(pdf: pd.DataFrame) -> pd.DataFrame:
    """The histogram of one source: whole passes and how many of each length come once more."""
    target, total = float(pdf["target"].iloc[0]), int(pdf["source_size"].iloc[0])
    passes = int(target // total) if total else 0
    size, count = pdf["size"].to_numpy(np.int64), pdf["n"].to_numpy(np.int64)
    extra = fit(size, count, round(target - passes * total)) if total else np.zeros(len(pdf), np.int64)
    return pdf.assign(passes=passes, extra=extra)[["source", "size", "source_size", "target", "passes", "extra"]]


def mix(
    documents: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    share: float = SHARE,
    most: float = MAX_PASSES,
    seed: int = 17,
) -> DataFrame:
    """One row per document: doc_id, size, source_size, target and taken (words the mix takes of it)."""
    spark = documents.sparkSession
    sized = staged(
        documents.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            F.col("source").cast("string").alias("source"),
            F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        ).withColumn("place", F.xxhash64(F.lit(seed), "doc_id", "size")),
        "mix-sizes",
    )
    slot = F.shiftright("place", 52) + F.lit(SLOTS // 2)
    ranges = staged(
        sized.withColumn("slot", slot).groupBy("source", "size", "slot").agg(F.count(F.lit(1)).alias("n")), "mix-slots"
    )
    by_source = ranges.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).cast("long").alias("source_size"))
    # one row per source: the weights are given for them one by one
    order = sorted(((r[0], int(r[1])) for r in by_source.collect()), key=lambda x: (x[0] is None, x[0] or ""))
    goals = spark.createDataFrame(
        [(s, n, t) for (s, n), t in zip(order, targets(order, weights, share, most))],
        "source string, source_size long, target double",
    )
    lengths = ranges.groupBy("source", "size").agg(F.sum("n").cast("long").alias("n"))
    lengths = lengths.join(goals, lengths["source"].eqNullSafe(goals["source"])).drop(goals["source"])
    quotas = staged(
        lengths.groupBy("source").applyInPandas(
            _quotas,
            "source string, size long, source_size long, target double, passes long, extra long",
        ),
        "mix-quotas",
    )
    upto = Window.partitionBy("source", "size").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    before = ranges.withColumn("before", F.coalesce(F.sum("n").over(upto), F.lit(0)))
    q = quotas.withColumnRenamed("source", "q_source").withColumnRenamed("size", "q_size")
    shares = before.join(q, (F.col("size") == F.col("q_size")) & F.col("source").eqNullSafe(F.col("q_source")))
    shares = shares.select(
        F.col("source").alias("q_source"),
        F.col("size").alias("q_size"),
        F.col("slot").alias("q_slot"),
        "source_size",
        "target",
        "passes",
        F.greatest(F.lit(0), F.least(F.col("n"), F.col("extra") - F.col("before"))).alias("quota"),
        "n",
    )
    dealt = sized.withColumn("slot", slot).join(
        shares,
        (F.col("size") == F.col("q_size")) & (F.col("slot") == F.col("q_slot")) & F.col("source").eqNullSafe(F.col("q_source")),
    )
    some = (F.col("quota") > 0) & (F.col("quota") < F.col("n"))
    rank = F.row_number().over(Window.partitionBy("source", "size", "slot").orderBy("place", "doc_id"))
    cut = dealt.where(some).withColumn("once", (rank <= F.col("quota")).cast("long"))
    rest = dealt.where(~some).withColumn("once", (F.col("quota") > 0).cast("long"))
    return rest.unionByName(cut).select(
        "doc_id",
        "size",
        "source_size",
        "target",
        (F.col("size") * (F.col("passes") + F.col("once"))).cast("long").alias("taken"),
    )


def repeat_documents(documents: DataFrame, mixed: DataFrame) -> DataFrame:
    """The mix itself: each row of ``documents`` as often as ``mixed`` takes it, with a column ``copy`` from 1.

    Rows are matched by doc_id. Rows that share one are matched by size too, and
    among equal ones in any order, so that each decision is used once.
    """
    copy, times, key, size, nth = fresh(documents, "copy", "times", "key", "words", "nth")
    passes = F.when(F.col("size") > 0, F.col("taken") / F.col("size")).otherwise(0).cast("int")
    wanted = mixed.select(F.col("doc_id").alias(key), F.col("size").alias(f"{size}_"), passes.alias(times))
    same_id = F.col("doc_id").cast("long").eqNullSafe(F.col(key))
    if mixed.groupBy("doc_id").count().where("count > 1").isEmpty():
        both = documents.join(wanted.where(F.col(times) > 0), same_id)
    else:
        words = F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
        rows = documents.withColumn(size, words)
        rows = rows.withColumn(nth, F.row_number().over(Window.partitionBy("doc_id", size).orderBy(size)))
        order = Window.partitionBy(key, f"{size}_").orderBy(times)
        wanted = wanted.withColumn(f"{nth}_", F.row_number().over(order))
        both = rows.join(wanted, same_id & (F.col(size) == F.col(f"{size}_")) & (F.col(nth) == F.col(f"{nth}_")))
        both = both.where(F.col(times) > 0)
    return both.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*documents.columns, copy)
