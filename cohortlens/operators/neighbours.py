"""Exact k nearest neighbours inside a set of points.

The points are cut into cells along their two leading directions, and cells into
blocks of about ``BLOCK_POINTS``. A point first searches its own block, which bounds
its k-th distance. It then visits the blocks of those cells only that lie within this
bound: the distance to a cell, seen along the two directions, is never more than the
distance to a point in it. A visited pair of blocks is a task of its own, and only the
k best of each searching point leave it, as ids; a grouped aggregate keeps the k best
of all. No point passes through the driver, a task holds two blocks, and the bounds of
the cells, at most ``CUTS`` squared rows, are the only table that is broadcast. Points
without structure along any direction still meet all others, as exact search must then.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, functions as F

from cohortlens.storage import stage

# the functions below travel with the task, so executors need not have the package
register_pickle_by_value(sys.modules[__name__])

# points of a block, if hashes deal evenly; a point travels once to each block it visits
BLOCK_POINTS = 40_000
# parts that a direction is cut into at most
CUTS = 64
# points that give the first bound of a distance
LIMIT_POINTS = 2_000
# searching points and distances held at once
CHUNK_ROWS = 256
BLOCK_CELLS = 4_000_000
# rough distances are compared with this relative slack, so that rounding excludes nothing
SLACK = 1e-9


def _matrix(column) -> np.ndarray:
    return np.array(list(column), dtype=np.float64)


class Rough:
    """Which of ``points`` may lie within a distance of others: one single-precision product, never wrong to leave a point out.

    ``x.p - |p|^2 / 2`` is compared with what the limit asks for. What rounding may do to it is
    at most ``slack`` of the squares, so it rules points out but is never a result.
    """

    def __init__(self, points: np.ndarray):
        self.centre = points.mean(axis=0)
        points = points - self.centre
        sizes = (points * points).sum(axis=1)
        # beyond this the squares leave the range of single precision
        self.kind = np.float32 if sizes.max(initial=0.0) < 1e30 else np.float64
        self.slack = (points.shape[1] + 16) * float(np.finfo(self.kind).eps) + SLACK
        self.points = np.column_stack([points, sizes * (self.slack - 1) / 2]).astype(self.kind)
        self.step = max(1, min(CHUNK_ROWS, BLOCK_CELLS // len(points)))
        self.products = np.empty((self.step, len(points)), dtype=self.kind)
        self.hits = np.empty((self.step, len(points)), dtype=bool)

    def within(self, x: np.ndarray, limits: np.ndarray) -> np.ndarray:
        """One row of flags per row of ``x`` (``step`` at most) with its squared limit; valid until the next call."""
        x = x - self.centre
        sizes = (x * x).sum(axis=1)
        # small products may vanish altogether
        asked = (sizes * (1 - self.slack) - limits) / 2 - (x.shape[1] + 16) * float(np.finfo(self.kind).tiny)
        with np.errstate(over="ignore", invalid="ignore"):
            left = np.column_stack([x, np.ones(len(x))]).astype(self.kind)
            products = np.matmul(left, self.points.T, out=self.products[: len(x)])
            # a bound is rounded as well; what overflows cannot be ruled out
            asked = np.nextafter(asked.astype(self.kind), self.kind(-np.inf))
            asked[~(sizes < 1e30) & (self.kind is np.float32)] = -np.inf
            missed = np.less(products, asked[:, None], out=self.hits[: len(x)])
        return np.logical_not(missed, out=missed)


def squared_limits(x: np.ndarray, at: np.ndarray, points: np.ndarray, k: int) -> np.ndarray:
    """For each row of ``x``, which is point ``at`` (-1: none of them), a square that k other points do not exceed.

    A share of the points will do: it only makes the bound wider.
    """
    some = np.linspace(0, len(points) - 1, min(len(points), LIMIT_POINTS)).astype(np.int64)
    if len(some) <= k:
        return np.full(len(x), np.inf)
    shift = points[some].mean(axis=0)
    x, against = x - shift, points[some] - shift
    sizes = (x * x).sum(axis=1)[:, None] + (against * against).sum(axis=1)[None, :]
    upper = sizes * (1 + SLACK) - 2.0 * (x @ against.T)
    upper[at[:, None] == some[None, :]] = np.inf
    return np.partition(upper, k - 1, axis=1)[:, k - 1]


def best_of(
    x: np.ndarray, at: np.ndarray, points: np.ndarray, k: int, reach: np.ndarray
) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(row of ``x``, its k nearest other points within ``reach``, their distances); ties by position, rows without any left out.

    A row is point ``at`` (-1: none of them). ``reach`` NaN: any distance.
    """
    rough = Rough(points)
    for start in range(0, len(x), rough.step):
        some = slice(start, start + rough.step)
        limits = reach[some] ** 2 * (1 + SLACK)
        free = np.flatnonzero(np.isnan(limits))
        if len(free):
            limits[free] = squared_limits(x[some][free], at[some][free], points, k)
        hits = rough.within(x[some], limits)
        for i in np.flatnonzero(hits.any(axis=1)) + start:
            near = np.flatnonzero(hits[i - start])
            near = near[near != at[i]]
            exact = np.sqrt(((points[near] - x[i]) ** 2).sum(axis=1))
            # stable: equal distances keep the order of the ids
            order = np.argsort(exact, kind="stable")[:k]
            yield i, near[order], exact[order]


def _cut(points: DataFrame, by: str, order: str, parts: int, name: str) -> DataFrame:
    """Add ``name``: which of about equal ``parts`` along ``order`` a point of its ``by`` group lies in."""
    shares = ", ".join(str(i / parts) for i in range(1, parts)) or "0.5"
    cuts = points.groupBy(by).agg(F.expr(f"percentile_approx({order}, array({shares}), 2000)").alias("cuts"))
    # at most CUTS groups of as many cuts
    return points.join(F.broadcast(cuts), by).withColumn(name, F.expr(f"size(filter(cuts, c -> c < {order}))")).drop("cuts")


def _blocks(points: DataFrame, blocks: int) -> tuple[DataFrame, DataFrame]:
    """Staged points (pid, x, a, b, norm, cell, sub), and the bounds of the cells with their number of blocks.

    ``a`` and ``b`` are places along the leading directions. A cell with more
    points than a block holds is dealt by hash into blocks ``sub``.
    """
    zero = F.lit(0.0)
    norm = F.sqrt(F.aggregate("x", zero, lambda total, v: total + v * v)).alias("norm")
    if blocks == 1:
        placed = points.select("pid", "x", zero.alias("a"), zero.alias("b"), norm, F.lit(0).alias("cell"))
    else:
        vectors = points.select("pid", "x", norm, array_to_vector(F.concat("x", F.array(zero))).alias("v"))
        # a coordinate of zeros lets points of a single one have two directions as well
        turned = PCA(k=2, inputCol="v", outputCol="at").fit(vectors).transform(vectors)
        at = turned.select("pid", "x", "norm", vector_to_array("at").alias("at"), F.lit(0).alias("whole"))
        placed = at.select("pid", "x", F.get("at", F.lit(0)).alias("a"), F.get("at", F.lit(1)).alias("b"), "norm", "whole")
        parts = min(CUTS, int(np.ceil(np.sqrt(blocks))))
        placed = _cut(placed, "whole", "a", parts, "slab").drop("whole")
        placed = _cut(placed, "slab", "b", parts, "part").withColumn("cell", F.expr(f"CAST(slab * {CUTS} + part AS INT)"))
        placed = stage(placed.select("pid", "x", "a", "b", "norm", "cell"), "cells")
    ends = [F.min(c).alias(f"{c}_lo") for c in "ab"] + [F.max(c).alias(f"{c}_hi") for c in "ab"]
    bounds = placed.groupBy("cell").agg(
        F.expr(f"CAST(ceil(count(*) / {BLOCK_POINTS}) AS INT)").alias("subs"), F.max("norm").alias("reach_of_norm"), *ends
    )
    sub = F.expr("CAST(pmod(xxhash64(pid), subs) AS INT)").alias("sub")
    # one row per cell
    dealt = placed.join(F.broadcast(bounds.select("cell", "subs")), "cell")
    return stage(dealt.select("pid", "x", "a", "b", "norm", "cell", sub), "blocks"), bounds


def _search(left: pd.DataFrame, right: pd.DataFrame, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(row of ``left``, names, distances) of the k nearest rows of ``right``, which is sorted by pid.

    Only rows within the ``reach`` of a row of ``left``, if it has one.
    """
    names = right["pid"].to_numpy(dtype=object)
    if not len(left) or not len(right):
        return
    x, against = _matrix(left["x"]), _matrix(right["x"])
    place = {p: i for i, p in enumerate(names)}
    at = np.array([place.get(p, -1) for p in left["pid"]])
    reach = left["reach"].to_numpy(dtype=np.float64) if "reach" in left else np.full(len(left), np.nan)
    for i, near, distance in best_of(x, at, against, k, reach):
        yield i, names[near], distance


def _near_blocks(own: DataFrame, bounds: DataFrame) -> DataFrame:
    """Each searching point once for every other block within its ``reach`` (NULL: any).

    Projections are off by rounding, in proportion to the points' norms, so cells are taken a little wider.
    """
    gap = "greatest({0}_lo - {0}, {0} - {0}_hi, 0D)"
    square = " + ".join(f"power({gap.format(c)}, 2)" for c in "ab")
    slack = f"{SLACK}D * (norm + reach_of_norm)"
    cells = bounds.withColumnRenamed("cell", "to_cell")
    # at most CUTS squared rows are broadcast
    met = own.join(F.broadcast(cells), F.expr(f"reach IS NULL OR sqrt({square}) <= reach + 2 * {slack}"))
    visits = met.select(
        "pid", "x", "reach", "cell", "sub", "to_cell", F.explode(F.expr("sequence(0, subs - 1)")).alias("to_sub")
    )
    return visits.where("cell <> to_cell OR sub <> to_sub")


def nearest(points: DataFrame, k: int, searchers: str = "true") -> DataFrame:
    """(pid, other, distance, place) of the k nearest other points; ties by ``other``.

    ``points`` is a staged table (pid, x array<double>) with distinct pids; ``searchers``
    is a SQL test on its columns that chooses the points to search for.
    """
    blocks = max(1, -(-points.count() // BLOCK_POINTS))
    dealt, bounds = _blocks(points, blocks)
    chosen = points.where(F.expr(searchers)).select("pid", F.lit(True).alias("searches"))
    marked = dealt.join(chosen, "pid", "left") if searchers != "true" else dealt.withColumn("searches", F.lit(True))

    def inside(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pid", kind="stable")
        left = rows[rows["searches"].eq(True)].drop(columns="searches").reset_index(drop=True)
        others, distances = [[] for _ in range(len(left))], [[] for _ in range(len(left))]
        for i, names, distance in _search(left, rows, k):
            others[i], distances[i] = list(names), list(distance)
        reach = [d[-1] if len(d) == k else None for d in distances]
        # a block may hold no searching point, and empty lists would become a column of numbers
        lists = {"reach": reach, "others": others, "distances": distances}
        return left.assign(**{c: pd.Series(v, dtype="object") for c, v in lists.items()})

    columns = "pid string, x array<double>, a double, b double, norm double, cell int, sub int"
    found = "reach double, others array<string>, distances array<double>"
    marked = marked.select("pid", "x", "a", "b", "norm", "cell", "sub", "searches")
    own = marked.groupBy("cell", "sub").applyInPandas(inside, f"{columns}, {found}")
    if blocks > 1:
        own = stage(own, "own-blocks")
    pair = F.explode(F.arrays_zip("others", "distances")).alias("pair")
    met = own.select("pid", pair).select("pid", F.col("pair.others").alias("other"), F.col("pair.distances").alias("distance"))
    if blocks > 1:
        met = met.unionByName(_among_blocks(dealt, _near_blocks(own, bounds), k))
    # at most k rows of each block
    best = met.groupBy("pid").agg(F.slice(F.sort_array(F.collect_list(F.struct("distance", "other"))), 1, k).alias("best"))
    placed = best.select("pid", F.posexplode("best").alias("before", "b"))
    return placed.select("pid", F.col("b.other").alias("other"), F.col("b.distance").alias("distance"), (F.col("before") + 1).alias("place"))


def _among_blocks(dealt: DataFrame, visits: DataFrame, k: int) -> DataFrame:
    """(pid, other, distance): the k nearest of each visited block within reach; a block travels once to each block that visits it."""

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        right = right.sort_values("pid", kind="stable")
        pids = left["pid"].to_numpy(dtype=object)
        found: dict[str, list] = {"pid": [], "other": [], "distance": []}
        for i, names, distance in _search(left, right, k):
            found["pid"] += [pids[i]] * len(names)
            found["other"] += list(names)
            found["distance"] += list(distance)
        # nothing may be within reach
        return pd.DataFrame(found).astype({"pid": "object", "other": "object", "distance": "float64"})

    keys = ["cell", "sub", "to_cell", "to_sub"]
    right = dealt.select("pid", "x", F.col("cell").alias("to_cell"), F.col("sub").alias("to_sub"))
    right = right.join(stage(visits.select(*keys).distinct(), "visits"), ["to_cell", "to_sub"])
    left, right = visits.select("pid", "x", "reach", *keys), right.select("pid", "x", *keys)
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(search, "pid string, other string, distance double")
