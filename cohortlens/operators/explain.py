"""Which features drive a fitted tree model: importances and exact Shapley values."""

from __future__ import annotations

import sys
import uuid
from collections.abc import Iterator, Sequence
from math import factorial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.ml import Model
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from cohortlens.storage import scratch_dir, stage

# the functions below travel with the task, so executors need not have the package
register_pickle_by_value(sys.modules[__name__])

# size of a (rows x leaves x path features) block in a task
BLOCK_CELLS = 2_000_000
# patterns of a path that a table may have
TABLE_PATTERNS = 256
# rows and leaves with long paths that are handled at once
LONG_ROWS, LONG_LEAVES = 4_096, 256
# leaves of the trees that are sent to the tasks at once, about 110 bytes each; a larger tree is a block of its own
BLOCK_LEAVES = 250_000
# a model of more leaves than this makes rows of a repeated key one, with the sums of their values
MERGED_LEAVES = 20_000
# rows that walk a tree together, and rows of a batch that leaves a task
CHUNK_ROWS, ARROW_ROWS = 32_768, 8_192
# leaves of the subtrees through which rows that are alike there go as one, and the rows for which this is worth while
SUBTREES = (16, 4)
LEAST_ROWS = 512


def feature_importance(spark: SparkSession, model: Model, names: Sequence[str], k: int = 20) -> DataFrame:
    """The k most important features of a tree model (the model has one value per feature)."""
    if not hasattr(model, "featureImportances"):
        raise ValueError(f"{type(model).__name__} has no feature importances")
    values = model.featureImportances.toArray()
    rows = [(name, float(value)) for name, value in zip(names, values, strict=True)]
    table = spark.createDataFrame(rows, "feature STRING, importance DOUBLE")
    return table.orderBy(F.desc("importance"), F.asc("feature")).limit(k)


def tree_nodes(spark: SparkSession, model: Model) -> DataFrame:
    """Nodes of all trees with the weight of their tree, from the saved form of the model.

    Boosted trees add ``weight * value``; forests average class probabilities.
    """
    path = f"{scratch_dir(spark)}/model-{uuid.uuid4().hex}"
    model.write().save(path)
    nodes = spark.read.parquet(f"{path}/data")
    if "treeID" in nodes.columns:
        trees = spark.read.parquet(f"{path}/treesMetadata").toDF("treeID", "metadata", "weight")
        # one row per tree
        nodes = nodes.join(F.broadcast(trees.select("treeID", "weight")), "treeID")
        nodes = nodes.select("treeID", "weight", "nodeData.*")
    else:
        nodes = nodes.select(F.lit(0).alias("treeID"), F.lit(1.0).alias("weight"), "*")
    boosted = "GBT" in type(model).__name__
    stats = F.col("impurityStats")
    value = F.col("prediction") if boosted else stats[1] / (stats[0] + stats[1])
    scale = F.col("weight") if boosted else F.col("weight") / F.lit(float(getattr(model, "getNumTrees", 1)))
    return nodes.select(
        "treeID",
        "id",
        (value * scale).alias("value"),
        F.col("rawCount").alias("cover"),
        "leftChild",
        "rightChild",
        F.col("split.featureIndex").alias("feature"),
        F.get("split.leftCategoriesOrThreshold", F.lit(0)).alias("threshold"),
    )


Leaf = tuple[float, dict[int, tuple[float, float, float]]]


def tree_leaves(nodes: dict[int, tuple]) -> list[Leaf]:
    """Per leaf of one tree its value and, per feature on its path, (low, high, share of cover kept).

    A row satisfies the path on a feature when low < x <= high. ``nodes`` holds
    (value, cover, left child, right child, feature, threshold) by id.
    """
    leaves, pending = [], [(0, {})]
    while pending:
        at, path = pending.pop()
        value, cover, left, right, feature, threshold = nodes[at]
        if left < 0:
            leaves.append((value, path))
            continue
        low, high, kept = path.get(feature, (-np.inf, np.inf, 1.0))
        for child, bounds in ((left, (low, min(high, threshold))), (right, (max(low, threshold), high))):
            share = nodes[child][1] / cover
            pending.append((child, {**path, feature: (*bounds, kept * share)}))
    return leaves


def stacked_leaves(leaves) -> dict[int, tuple[np.ndarray, ...]]:
    """Leaves as arrays, grouped by the number of features on their path."""
    groups: dict[int, list] = {}
    for value, path in leaves:
        groups.setdefault(len(path), []).append((value, path))
    stacked = {}
    for d, members in groups.items():
        values = np.array([v for v, _ in members])
        if d:
            features = np.array([list(p) for _, p in members])
            low, high, share = (np.array([[b[i] for b in p.values()] for _, p in members]) for i in range(3))
            stacked[d] = (values, features, low, high, share)
        else:
            stacked[0] = (values,)
    return stacked


def pattern_gains(values: np.ndarray, share: np.ndarray, hit: np.ndarray) -> np.ndarray:
    """Shapley values (cases x path features) of one leaf each, given which features of its path a row satisfies.

    A leaf is the product game v(S) = value * prod(a_f, f in S) * prod(b_f, f not in S)
    with a_f = 1 if the row satisfies the path on f, b_f = the cover share kept by f.
    The coefficients of prod(b_f + a_f t) sum its subsets by size; dividing one
    factor out gives the subsets without that feature.
    """
    n, d = share.shape
    weights = [factorial(k) * factorial(d - 1 - k) / factorial(d) for k in range(d)]
    poly = np.zeros((d + 1, n))
    poly[0] = 1.0
    for f in range(d):
        poly[1:] = poly[1:] * share[:, f] + poly[:-1] * hit[:, f]
        poly[0] *= share[:, f]
    gains = np.empty((n, d))
    for f in range(d):
        b, rest, total = share[:, f], np.zeros(n), np.zeros(n)
        for k in range(d - 1, -1, -1):
            # hit: divide by (b + t) from the top; miss: divide by b
            rest = np.where(hit[:, f], poly[k + 1] - b * rest, poly[k] / b)
            total += weights[k] * rest
        gains[:, f] = values * (hit[:, f] - b) * total
    return gains


def shapley_matrix(x: np.ndarray, stacked: dict[int, tuple[np.ndarray, ...]]) -> np.ndarray:
    """Shapley values (rows x features) of the sum of all leaves, one leaf after the other (``TreeWalk`` is checked against it).

    What a leaf adds depends only on the pattern of satisfied features of its path. Short paths
    get a table of all patterns, long ones are integrated (``add_long_paths``).
    """
    phi = np.zeros_like(x)
    for d, arrays in stacked.items():
        if d == 0:
            continue
        if 1 << d > min(len(x), TABLE_PATTERNS):
            for at in range(0, len(x), LONG_ROWS):
                some = slice(at, at + LONG_ROWS)
                added = np.zeros((x.shape[1], len(x[some])))
                add_long_paths(added, np.ascontiguousarray(x[some].T), arrays)
                phi[some] += added.T
            continue
        step = max(1, BLOCK_CELLS // (d << d))
        for start in range(0, len(arrays[0]), step):
            values, features, low, high, share = (a[start : start + step] for a in arrays)
            leaves = len(values)
            place = np.zeros((d, leaves, x.shape[1]))
            for k in range(d):
                place[k, np.arange(leaves), features[:, k]] = 1.0
            hit = (np.arange(1 << d)[:, None] >> np.arange(d)) & 1 > 0
            gains = pattern_gains(np.repeat(values, 1 << d), np.repeat(share, 1 << d, axis=0), np.tile(hit, (leaves, 1)))
            chunk = max(1, BLOCK_CELLS // (leaves * d))
            for at in range(0, len(x), chunk):
                rows = x[at : at + chunk]
                code = np.arange(leaves)[None, :] << d
                for k in range(d):
                    seen = rows[:, features[:, k]]
                    code = code | (((seen > low[:, k]) & (seen <= high[:, k])).astype(np.int64) << k)
                for k in range(d):
                    phi[at : at + chunk] += gains[:, k][code] @ place[k]
    return phi


def add_long_paths(phi: np.ndarray, x: np.ndarray, arrays: tuple[np.ndarray, ...]) -> None:
    """Add to ``phi`` the Shapley values of leaves with d features on their path; ``phi`` and ``x`` are features x rows.

    The weight k! (d-1-k)! / d! is the integral of u^k (1-u)^(d-1-k) from 0 to 1. So a feature's value
    (see ``pattern_gains``) is the integral of v (a_f - b_f) prod((1-u) b_g + u a_g, g not f), which d/2 Gauss
    points give exactly. It is the same for all features that a row misses. The products come from
    tables of the patterns of eight features each.
    """
    d = arrays[1].shape[1]
    points, weight = np.polynomial.legendre.leggauss((d + 1) // 2)
    u, weight = (points + 1) / 2, weight / 2
    for start in range(0, len(arrays[0]), LONG_LEAVES):
        values, features, low, high, share = (a[start : start + LONG_LEAVES] for a in arrays)
        missed = share[:, :, None] * (1 - u)
        met = missed + u
        tables = []
        for first in range(0, d, 8):
            table = np.ones((len(values), 1, len(u)))
            for g in range(first, min(d, first + 8)):
                table = np.concatenate([table * missed[:, None, g], table * met[:, None, g]], axis=1)
            tables.append(table)
        if_met = (values[:, None] * (1 - share))[:, :, None] * weight / met
        if_missed = -values[:, None] * (weight / (1 - u))
        factors = np.concatenate([if_met, if_missed[:, None]], axis=1)
        for leaf, place in enumerate(features):
            seen = x[place]
            hit = (seen > low[leaf][:, None]) & (seen <= high[leaf][:, None])
            codes = np.packbits(hit, axis=0, bitorder="little")
            product = tables[0][leaf].take(codes[0], axis=0)
            for table, code in zip(tables[1:], codes[1:]):
                product *= table[leaf].take(code, axis=0)
            gains = factors[leaf] @ product.T
            phi[place] += np.where(hit, gains[:d], gains[d])


def base_value(stacked: dict[int, tuple[np.ndarray, ...]]) -> float:
    """Expected model output over the training cover."""
    total = 0.0
    for d, arrays in stacked.items():
        total += float((arrays[0] * (arrays[4].prod(axis=1) if d else 1.0)).sum())
    return total


# (value, cover, left child, right child, feature, threshold) by place; the root is the first, a leaf's children are negative
Tree = tuple[np.ndarray, ...]


def tree_arrays(nodes: pa.Table) -> list[Tree]:
    """The trees of a table of nodes, children by place instead of id."""
    columns = {c: nodes[c].to_numpy() for c in nodes.column_names}
    order = np.lexsort((columns["id"], columns["treeID"]))
    columns = {c: v[order] for c, v in columns.items()}
    starts = np.flatnonzero(np.diff(columns["treeID"], prepend=-1))
    trees = []
    for some in (slice(*ends) for ends in zip(starts, [*starts[1:], len(order)])):
        ids = columns["id"][some]
        children = [np.where(columns[c][some] < 0, -1, np.searchsorted(ids, columns[c][some])) for c in ("leftChild", "rightChild")]
        trees.append((columns["value"][some], columns["cover"][some], *children, columns["feature"][some], columns["threshold"][some]))
    return trees


def tree_levels(left: np.ndarray, right: np.ndarray) -> list[np.ndarray]:
    """Nodes by their distance from the root."""
    levels, level = [], np.array([0])
    while len(level):
        levels.append(level)
        inner = level[left[level] >= 0]
        level = np.concatenate([left[inner], right[inner]])
    return levels


def merged_patterns(hit: np.ndarray, product: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Groups of rows with the same flags as one."""
    bits = np.packbits(hit, axis=0)
    names = np.zeros(hit.shape[1], dtype=np.int64)
    for byte in bits:
        names = names << 8 | byte
    _, first, place = np.unique(names, return_index=True, return_inverse=True)
    return hit[:, first], product[:, first], place.astype(np.intp, copy=False)[group]


def numbered(key: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The values below ``size`` that occur, one row of each, and for each row the place of its value."""
    row_of = np.full(size, -1, dtype=np.intp)
    row_of[key] = np.arange(len(key))
    found = np.flatnonzero(row_of >= 0)
    place = np.empty(size, dtype=np.intp)
    place[found] = np.arange(len(found))
    return found, row_of[found], place.take(key)


class TreeWalk:
    """Shapley values of one tree for rows that walk all of its paths together.

    Values as in ``add_long_paths``. Rows that satisfy the same features of a path are a group, so the products
    of a path are made per group and carried from a node to its children. Rows that are alike in all splits
    of a small subtree and of the path to it go through it as one row.
    """

    def __init__(self, tree: Tree, n_features: int):
        self.value, self.cover, self.left, self.right, self.feature, self.threshold = tree
        levels = tree_levels(self.left, self.right)
        points, weight = np.polynomial.legendre.leggauss(max(1, (min(len(levels) - 1, n_features) + 1) // 2))
        self.u, self.weight = (points + 1)[:, None] / 2, weight / 2
        self.unmet = 1 - self.u
        self.leaves = np.ones(len(self.left), dtype=np.int64)
        for level in reversed(levels):
            inner = level[self.left[level] >= 0]
            self.leaves[inner] = self.leaves[self.left[inner]] + self.leaves[self.right[inner]]

    def add(self, phi: np.ndarray, x: np.ndarray) -> None:
        """Add the values of the tree to ``phi``; ``phi`` and ``x`` are features x rows."""
        if self.left[0] >= 0:
            start = np.zeros((0, 1), dtype=bool), np.ones((len(self.u), 1))
            self._below(0, phi, x, np.zeros(x.shape[1], dtype=np.intp), [], [], *start, 0)

    def _below(self, at, phi, x, group, path, shares, hit, product, size) -> None:
        """The subtree at ``at``. ``group`` of each row; ``hit``: features of the path that a group satisfies; their
        products at the points; ``size``: place in SUBTREES of the next size at which rows are taken together."""
        while size < len(SUBTREES) and self.leaves[at] <= SUBTREES[size]:
            size += 1
            if self.leaves[at] > 2 and len(group) >= LEAST_ROWS:
                if (alike := self._alike(at, x, group, hit.shape[1])) is not None:
                    rows, place, features = alike
                    some = np.empty((len(x), len(rows)))
                    some[features] = x[features][:, rows]
                    found = np.zeros_like(some)
                    self._split(at, found, some, group[rows], path, shares, hit, product, size)
                    self._give(phi, place, list({*features, *path}), found)
                    return
        self._split(at, phi, x, group, path, shares, hit, product, size)

    def _alike(self, at, x, group, groups) -> tuple[np.ndarray, np.ndarray, list[int]] | None:
        """One row of each kind in the subtree at ``at``, the kind of each row, and the features; None if there are many kinds."""
        splits, pending = set(), [at]
        while pending:
            node = pending.pop()
            if self.left[node] >= 0:
                splits.add((int(self.feature[node]), float(self.threshold[node])))
                pending += [self.left[node], self.right[node]]
        key, size = group, groups
        for f, threshold in sorted(splits):
            if 2 * size > 4 * len(group):
                found, _, key = numbered(key, size)
                size = len(found)
            key = key << 1
            key |= x[f] <= threshold
            size *= 2
        found, rows, place = numbered(key, size)
        return (rows, place, sorted({f for f, _ in splits})) if 2 * len(found) <= len(group) else None

    @staticmethod
    def _give(phi, place, features, found) -> None:
        added = np.empty(len(place))
        for f in features:
            phi[f] += found[f].take(place, out=added, mode="clip")

    def _split(self, at, phi, x, group, path, shares, hit, product, size) -> None:
        u, unmet, f = self.u, self.unmet, int(self.feature[at])
        again = path.index(f) if f in path else None
        # NaN goes right, as in the model
        below = x[f] <= self.threshold[at]
        if again is not None:
            below &= hit[again].take(group)
        key = group << 1
        key |= below
        ids, _, group = numbered(key, 2 * hit.shape[1])
        is_left, hit, product = ids & 1 == 1, hit[:, ids >> 1], product[:, ids >> 1]
        gains = None
        if again is None:
            path = [*path, f]
        else:
            kept, before = hit[again], shares[again]
            product = product / np.where(kept, unmet * before + u, unmet * before)
        for child, met in ((self.left[at], is_left), (self.right[at], ~is_left)):
            share = self.cover[child] / self.cover[at]
            if again is None:
                child_shares, child_hit = [*shares, share], np.concatenate([hit, met[None]])
            else:
                share, met = share * before, met & kept
                child_shares, child_hit = shares.copy(), hit.copy()
                child_shares[again], child_hit[again] = share, met
            child_product = product * np.where(met, unmet * share + u, unmet * share)
            if self.left[child] < 0:
                b = np.array(child_shares)[:, None]
                if_met = self.value[child] * (1 - b) * self.weight / (unmet.T * b + u.T)
                if_missed = -self.value[child] * self.weight / unmet[:, 0]
                made = np.where(child_hit, if_met @ child_product, if_missed @ child_product)
                gains = made if gains is None else gains + made
            else:
                child_group = group
                if again is not None:
                    child_hit, child_product, child_group = merged_patterns(child_hit, child_product, group)
                self._below(child, phi, x, child_group, path, child_shares, child_hit, child_product, size)
        if gains is not None:
            self._give(phi, group, path, dict(zip(path, gains)))


def tree_shapley(sample: DataFrame, model: Model, names: Sequence[str]) -> tuple[DataFrame, float]:
    """(key, feature, value, phi) for every row of ``sample`` (key, features), and the base value.

    phi sums with the base value to the model's margin (boosted trees) or to the
    probability (forest, single tree).
    """
    nodes = stage(tree_nodes(sample.sparkSession, model), "nodes")
    # one row per tree
    trees = nodes.groupBy("treeID").agg(
        F.count_if(F.expr("leftChild < 0")).alias("leaves"),
        # the shares of a path multiply to the leaf's part of the root's cover
        F.expr("sum(CASE WHEN leftChild < 0 THEN value * cover END) / max(CASE WHEN id = 0 THEN cover END)").alias("base"),
    ).orderBy("treeID").collect()
    blocks, room = [], 0
    for tree in trees:
        if tree["leaves"] > room:
            blocks.append({})
            room = BLOCK_LEAVES
        blocks[-1][tree["treeID"]] = tree["leaves"]
        room -= tree["leaves"]
    rows = sample.select(
        F.monotonically_increasing_id().alias("row"), F.col("key").cast("string").alias("key"), vector_to_array("features").alias("x")
    )
    rows = stage(rows.withColumn("phi", F.transform("x", lambda _: F.lit(0.0))), "rows")
    count = rows.count()
    for block in blocks:
        # staged: the table of a block is the start of the next one, and its reader may read it more than once
        rows = stage(_explained(rows, count, nodes.where(F.col("treeID").isin(*block)), block), "shapley")
    places = F.arrays_zip(F.array(*[F.lit(n) for n in names]).alias("feature"), F.col("x").alias("value"), "phi")
    table = rows.select("key", F.inline(places))
    if sum(tree["leaves"] for tree in trees) > MERGED_LEAVES and not rows.groupBy("key").count().where("count > 1").isEmpty():
        # rows of a repeated key are one
        table = table.groupBy("key", "feature").agg(F.first("value").alias("value"), F.sum("phi").alias("phi"))
    return table, sum(tree["base"] for tree in trees)


def dealt_trees(leaves: dict[int, int], parts: int) -> list[list[int]]:
    """Trees in parts of about equal numbers of leaves."""
    dealt: list[list[int]] = [[] for _ in range(parts)]
    held = [0] * parts
    for tree in sorted(leaves, key=lambda t: (-leaves[t], t)):
        least = held.index(min(held))
        dealt[least].append(tree)
        held[least] += leaves[tree]
    return dealt


def _explained(rows: DataFrame, count: int, nodes: DataFrame, leaves: dict[int, int]) -> DataFrame:
    """(row, key, x, phi) with the values of the trees of one block (about BLOCK_LEAVES leaves), which is broadcast, added to phi.

    A walk costs about as much for a thousand rows as for one, so a task takes up to about CHUNK_ROWS
    rows and a part of the trees; the sums of the parts are added up per row.
    """
    spark = rows.sparkSession
    tasks = spark.sparkContext.defaultParallelism
    slices = max(1, -(-count // CHUNK_ROWS))
    parts = min(len(leaves), max(1, -(-2 * tasks // slices)))
    slices = max(slices, -(-tasks // parts))
    dealt = dealt_trees(leaves, parts)
    found = dict(zip(sorted(leaves), tree_arrays(nodes.toArrow()), strict=True))
    shared = spark.sparkContext.broadcast([[found[t] for t in some] for some in dealt])

    def explain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(batches):
            # one part, as a task is given
            for part in chunk["part"].unique().to_pylist():
                table = chunk.filter(pc.equal(chunk["part"], part))
                x, phi = (
                    np.array(table[c].combine_chunks().flatten().to_numpy().reshape(len(table), -1).T, order="C") for c in ("x", "phi")
                )
                if part:
                    phi[:] = 0.0
                for tree in shared.value[part]:
                    TreeWalk(tree, len(x)).add(phi, x)
                ends = pa.array(np.arange(len(table) + 1, dtype=np.int32) * len(phi))
                columns = {"row": table["row"], "part": table["part"], "phi": pa.ListArray.from_arrays(ends, pa.array(phi.T.reshape(-1)))}
                # the row itself travels once
                for c in ("key", "x"):
                    columns[c] = pa.nulls(len(table), table[c].type) if part else table[c]
                yield from pa.table(columns).to_batches(ARROW_ROWS)

    dealt_rows = rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    task = F.pmod(F.xxhash64("row"), F.lit(slices)) * parts + F.col("part")
    sums = dealt_rows.repartitionById(slices * parts, task.cast("int")).mapInArrow(
        explain, "row bigint, part int, phi array<double>, key string, x array<double>"
    )
    once = [F.first(c, ignorenulls=True).alias(c) for c in ("key", "x")]
    if parts == 1:
        return sums.select("row", "key", "x", "phi")
    # as many lists per row as there are parts, added in their order
    lists = F.sort_array(F.collect_list(F.struct("part", "phi"))).alias("lists")
    total = "aggregate(slice(lists.phi, 2, size(lists) - 1), lists.phi[0], (a, b) -> zip_with(a, b, (p, q) -> p + q))"
    return sums.groupBy("row").agg(*once, lists).select("row", "key", "x", F.expr(total).alias("phi"))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches in tables of at most about CHUNK_ROWS; a little more than that is one table, too."""
    held, count = [], 0
    for batch in batches:
        if len(batch):
            held, count = [*held, batch], count + len(batch)
        if count >= CHUNK_ROWS * 1.25:
            yield pa.Table.from_batches(held)
            held, count = [], 0
    if held:
        yield pa.Table.from_batches(held)


def shapley_summary(table: DataFrame, k: int = 20) -> DataFrame:
    """The k features with the largest mean absolute Shapley value."""
    means = table.groupBy("feature").agg(
        F.avg(F.abs("phi")).alias("mean_abs_shapley"), F.avg("phi").alias("mean_shapley")
    )
    return means.orderBy(F.desc("mean_abs_shapley"), F.asc("feature")).limit(k)


def shapley_rows(table: DataFrame, k: int = 20) -> DataFrame:
    """Per-row values of the k top features, with the feature's place (beeswarm data)."""
    # k rows
    top = shapley_summary(table, k).select(
        "feature",
        F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("mean_abs_shapley"), "feature")).alias("place"),
    )
    return table.join(F.broadcast(top), "feature")
