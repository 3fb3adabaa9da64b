import numpy as np
import pytest
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import functions as F, types as T

from cohortlens.operators import neighbours
from cohortlens.operators.smote import rows_to_add, smote, synthetic_rows
from cohortlens.storage import stage

SCHEMA = T.StructType(
    [T.StructField("key", T.StringType()), T.StructField("y", T.IntegerType()), T.StructField("features", VectorUDT())]
)


def brute_force(x, k):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    return {(i, int(j)) for i in range(len(x)) for j in np.argsort(d[i], kind="stable")[:k]}


@pytest.mark.parametrize("shape", ["spread", "clusters", "line"])
@pytest.mark.parametrize("chunk", [2_048, 40])
def test_neighbours_equal_brute_force(spark, monkeypatch, shape, chunk):
    monkeypatch.setattr(neighbours, "CHUNK_ROWS", chunk)
    rng = np.random.default_rng(7)
    x = {
        "spread": lambda: rng.normal(size=(300, 5)),
        # a dense region holds a third of the points
        "clusters": lambda: np.concatenate([rng.normal(0, 0.01, (100, 3)), rng.gamma(0.5, 9, (200, 3))]),
        "line": lambda: np.arange(300.0)[:, None] * [1.0, 0.0],
    }[shape]()
    points = stage(spark.createDataFrame([(f"{i:04d}", r.tolist()) for i, r in enumerate(x)], "pid string, x array<double>"))
    got = neighbours.nearest(points, 4).collect()
    assert {(int(r.pid), int(r.other)) for r in got} == brute_force(x, 4) and len(got) == 1200


def test_neighbours_of_few_points(spark):
    points = stage(spark.createDataFrame([("a", [0.0]), ("b", [1.0]), ("c", [5.0])], "pid string, x array<double>"))
    got = {(r.pid, r.other) for r in neighbours.nearest(points, 5).collect()}
    assert got == {(p, o) for p in "abc" for o in "abc" if p != o}


def test_neighbours_over_blocks_without_gathering_points(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK_POINTS", 40)
    x = np.round(np.random.default_rng(3).normal(size=(150, 2)), 1)  # with ties
    points = stage(spark.createDataFrame([(f"{i:04d}", r.tolist()) for i, r in enumerate(x)], "pid string, x array<double>"))
    with monkeypatch.context() as m:
        m.setattr(type(points), "collect", lambda df: pytest.fail("points are gathered"))
        near = neighbours.nearest(points, 4, "pid < '0100'")
    got = near.collect()
    assert {(int(r.pid), int(r.other)) for r in got} == {(a, b) for a, b in brute_force(x, 4) if a < 100}
    assert sorted(r.place for r in got) == sorted([1, 2, 3, 4] * 100)


@pytest.mark.parametrize("shape", ["clusters", "plane", "same place", "copies of a coordinate"])
def test_neighbours_over_cells_equal_brute_force(spark, monkeypatch, shape):
    monkeypatch.setattr(neighbours, "BLOCK_POINTS", 12)
    rng = np.random.default_rng(11)
    x = {
        "clusters": lambda: np.repeat(rng.normal(0, 50, (6, 5)), 30, axis=0) + rng.normal(size=(180, 5)),
        "plane": lambda: rng.normal(size=(180, 2)) * [9, 4] + 1e6,
        # all cells are one along both directions: dealt by hash
        "same place": lambda: np.concatenate([np.zeros((180, 2)), 1e-7 * rng.normal(size=(180, 2))], axis=1) + 3,
        "copies of a coordinate": lambda: np.round(rng.normal(size=(180, 1)), 2) * [1.0, 1.0, 0.0],
    }[shape]()
    points = stage(spark.createDataFrame([(f"{i:04d}", r.tolist()) for i, r in enumerate(x)], "pid string, x array<double>"))
    got = neighbours.nearest(points, 4).collect()
    assert {(int(r.pid), int(r.other)) for r in got} == brute_force(x, 4) and len(got) == 720


def test_blocks_that_are_too_far_are_not_visited(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK_POINTS", 20)
    rng = np.random.default_rng(5)
    x = np.repeat(rng.normal(0, 90, (10, 6)), 20, axis=0) + rng.normal(size=(200, 6))
    points = stage(spark.createDataFrame([(f"{i:04d}", r.tolist()) for i, r in enumerate(x)], "pid string, x array<double>"))
    seen = []
    kept = neighbours._among_blocks
    monkeypatch.setattr(neighbours, "_among_blocks", lambda dealt, visits, k: seen.append((dealt, visits)) or kept(dealt, visits, k))
    got = {(int(r.pid), int(r.other)) for r in neighbours.nearest(points, 3).collect()}
    assert got == brute_force(x, 3)
    dealt, visits = seen[0]
    blocks = dealt.select("cell", "sub").distinct().count()
    pairs = visits.select("cell", "sub", "to_cell", "to_sub").distinct().count()
    assert blocks >= 10 and pairs < blocks * (blocks - 1) / 3


@pytest.mark.parametrize("points", [1_000, 40])
def test_points_without_a_searching_one(spark, monkeypatch, points):
    """A block, or all of them, may hold only points that others find."""
    monkeypatch.setattr(neighbours, "BLOCK_POINTS", points)
    x = np.random.default_rng(3).normal(size=(150, 2))
    rows = [(f"{i:04d}", r.tolist(), bool(r[0] > 1)) for i, r in enumerate(x)]
    near = stage(spark.createDataFrame(rows, "pid string, x array<double>, wanted boolean"))
    assert neighbours.nearest(near, 4, "false").collect() == []
    got = neighbours.nearest(near, 4, "wanted").collect()
    assert {(int(r.pid), int(r.other)) for r in got} == {(a, b) for a, b in brute_force(x, 4) if rows[a][2]}


@pytest.mark.parametrize("scale", [1.0, 1e17, 1e-23])
def test_single_precision_rules_no_neighbour_out(scale):
    rng = np.random.default_rng(5)
    x = np.round(rng.gamma(1, 2, (2_500, 7))) * scale
    x[0] = 1e5 * scale  # far off: its rounding is that of the others' distances
    x[1:60] += 3e4 * scale
    want = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(want, np.inf)
    order = np.argsort(want, axis=1, kind="stable")[:, :5]
    anywhere = np.full(len(x), np.nan)
    found = list(neighbours.best_of(x, np.arange(len(x)), x, 5, anywhere))
    assert [i for i, _, _ in found] == list(range(len(x)))
    assert all((near == order[i]).all() for i, near, _ in found)
    # within reach of the second neighbour, ties of it included
    reach = np.take_along_axis(want, order, 1)[:, 1]
    for i, near, distance in neighbours.best_of(x, np.arange(len(x)), x, 5, reach):
        assert distance[1] == reach[i] and set(order[i][want[i][order[i]] <= reach[i]]) <= set(near)


@pytest.fixture(scope="module")
def sample(spark):
    rng = np.random.default_rng(2)
    x = np.round(rng.gamma(1, 2, (120, 3)), 1)
    x[:40] = x[0]  # a third are copies of one point
    rows = [(str(i), 1, Vectors.dense(r)) for i, r in enumerate(x)]
    rows += [(f"n{i}", 0, Vectors.dense(r)) for i, r in enumerate(rng.normal(size=(400, 3)))]
    return x, stage(spark.createDataFrame(rows, SCHEMA))


def test_target_ratio_and_repeatability(sample):
    _, df = sample
    for ratio, want in ((1.0, 400), (0.5, 200)):
        out = smote(df, ratio=ratio)
        assert out.filter("y = 1").count() == want and out.filter("y = 0").count() == 400
        assert out.select("key").distinct().count() == want + 400
    again = smote(df.repartition(3))
    assert smote(df).select("key").exceptAll(again.select("key")).isEmpty()


def test_gate(sample):
    assert rows_to_add({0: 130, 1: 100}, 1.0, 1.5) == (1, 0)
    assert rows_to_add({0: 200, 1: 100}, 0.5, 1.5) == (1, 0)
    assert rows_to_add({0: 200, 1: 100}, 1.0, 1.5) == (1, 100)
    assert rows_to_add({0: 10, 1: 40}, 1.0, 1.5) == (0, 30)
    _, df = sample
    assert smote(df, gate=5.0).count() == 520


def test_points_lie_on_segments_to_near_neighbours(sample):
    x, df = sample
    minority = df.filter("y = 1").select("key", "y", "features")
    made = synthetic_rows(minority, 120, 600, 5, 42, "features").collect()
    assert len(made) == 600
    unique, copies = np.unique(x, axis=0, return_counts=True)
    copied = 0
    for row in made:
        p = np.array(row.x)
        if row.pid == row.other:
            assert (unique == p).all(axis=1).any()
            copied += 1
            continue
        on_segment = False
        for i, start in enumerate(unique):
            others = np.sqrt(((x - start) ** 2).sum(axis=1))
            reach = np.sort(others)[5]  # five nearest rows after the row itself
            for end in unique[np.sqrt(((unique - start) ** 2).sum(axis=1)) <= reach + 1e-9]:
                length = ((end - start) ** 2).sum()
                if length and copies[i] <= 5:
                    t = ((p - start) @ (end - start)) / length
                    on_segment |= -1e-9 <= t <= 1 + 1e-9 and np.abs(start + t * (end - start) - p).max() < 1e-9
        assert on_segment
    # the copied point is base of a third of the rows
    assert copied >= 200


def test_every_row_is_base_equally_often(sample):
    x, df = sample
    made = synthetic_rows(df.filter("y = 1"), 120, 240, 5, 42, "features")
    per_point = [r["count"] for r in made.groupBy("pid").count().collect()]
    assert sum(per_point) == 240 and max(per_point) == 80


def test_labels_stay_integers(sample):
    out = smote(sample[1])
    assert dict(out.dtypes)["y"] == "int" and out.agg(F.max("y")).first()[0] == 1
