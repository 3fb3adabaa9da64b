import math

import numpy as np
import pytest

from cohortlens.llm import hard_negatives as H

RELABEL = "CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END"
SCHEMA = "vec_id long, embedding array<float>, label int"


@pytest.mark.parametrize("leaf", [1, 3, 32])
@pytest.mark.parametrize("shape", [(1, 1, 1), (33, 65, 97), (7, 64, 130), (40, 5, 3), (0, 4, 3)])
def test_strassen_is_exact(shape, leaf):
    rng = np.random.default_rng(sum(shape) + leaf)
    n, k, m = shape
    a, b = rng.integers(-(10**8), 10**8, (n, k)), rng.integers(-(10**8), 10**8, (k, m))
    assert (H.strassen(a, b, leaf) == a @ b).all()


def test_strassen_wraps_inside():
    # half sums leave 64 bits, the products do not
    a = np.full((4, 4), (1 << 62) + 12345)
    b = np.zeros((4, 4), np.int64)
    b[0, 0] = 1
    assert (H.strassen(a, b, 1) == a @ b).all()


def brute(rows, positives=5, negatives=3, window=(50, 95), every=50):
    kept = {}
    for vec_id, x, label in rows:
        if label is None or x is None or any(v is None or not math.isfinite(v) for v in x):
            continue
        x = [math.floor(256 * float(np.float32(v))) for v in x]
        key = (label, x)
        if vec_id is None:
            kept[("none", len(kept))] = (None, x, label)
        elif vec_id not in kept or key < (kept[vec_id][2], kept[vec_id][1]):
            kept[vec_id] = (vec_id, x, label)
    use = [(i, x, (l + 1) % 10 if i is not None and i % 7 == 0 else l) for i, x, l in kept.values()]
    out = []
    for i, x, l in use:
        if i is None or i % every:
            continue
        scored = [(-sum(a * b for a, b in zip(x, y)), (j is None, j or 0), j, m) for j, y, m in use if j != i]
        scored.sort(key=lambda r: r[:2])
        for s, _, j, _ in [r for r in scored if r[3] == l][:positives]:
            hard = [r for r in scored if r[3] != l and window[0] * -s <= 100 * -r[0] <= window[1] * -s][:negatives]
            out += [(i, j, rank + 1, r[2], -s, -r[0]) for rank, r in enumerate(hard)]
    return sorted(out, key=str)


def mined(spark, rows, **how):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return sorted((tuple(r) for r in H.mine(df, relabel=RELABEL, anchor="vec_id % 50 = 0", **how).collect()), key=str)


def vectors(n, width=12, seed=3, ties=False):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, width)).astype(np.float32)
    if ties:
        x = np.round(x)
    return [(i, x[i].tolist(), int(rng.integers(0, 4))) for i in range(n)]


@pytest.mark.parametrize("ties", [False, True])
def test_equals_brute_force(spark, ties, monkeypatch):
    rows = vectors(420, ties=ties)
    got = mined(spark, rows)
    assert got == brute(rows) and len(got) > 30
    # several blocks and tiles give the same
    monkeypatch.setattr(H, "TILE", (2, 16))
    assert mined(spark, rows, block_anchors=3) == got


def test_edge_cases(spark):
    rows = vectors(220, width=6, seed=8)
    rows += [(300, None, 1), (350, [1.0, None], 1), (400, [float("nan")] * 6, 2), (450, [float("inf")] * 6, 2), (500, [1.0] * 6, None)]
    rows += [(None, rows[3][1], 1), (None, rows[4][1], 2), (50, [2.0] * 6, 3), rows[7], (100, rows[100][1][:4], 0), (550, [], 1)]
    got = mined(spark, rows)
    assert got == brute(rows)
    assert not {r[0] for r in got} & {300, 350, 400, 450, 500}
    assert mined(spark, []) == []
    assert mined(spark, [(0, [1.0, 2.0], 1)]) == []
    with pytest.raises(Exception, match="too long"):
        mined(spark, [(0, [1e30, 2.0], 1)])


def test_other_columns_do_not_matter(spark):
    rows = vectors(120)
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS x", "2 AS score", "3 AS rank", "4 AS slot")
    got = sorted((tuple(r) for r in H.mine(df, relabel=RELABEL).collect()), key=str)
    assert got == brute(rows)
