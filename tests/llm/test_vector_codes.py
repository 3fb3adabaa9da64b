import hashlib
import math

import numpy as np
import pytest

from cohortlens.llm import vector_codes as C

SCHEMA = "vec_id long, embedding array<float>, label int"


def clustered(n, width=32, seed=2):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(30, width))
    x = (centre[rng.integers(0, 30, n)] + 0.2 * rng.normal(size=(n, width))).astype(np.float32)
    return [(i, x[i].tolist(), int(rng.integers(0, 3))) for i in range(n)]


def brute(rows, parts=16, entries=64, rounds=2):
    kept = [r for r in rows if r[1] is not None and all(v is not None and math.isfinite(v) for v in r[1])]
    ints = [[math.floor(256 * float(np.float32(v))) for v in r[1]] for r in kept]
    width = -(-max((len(x) for x in ints), default=0) // parts) * parts
    d = width // parts
    ints = [x + [0] * (width - len(x)) for x in ints]
    first = {}
    for r, x in zip(kept, ints):
        if r[0] is not None:
            first[r[0]] = min(first.get(r[0], x), x)
    start = [first[i] for i in sorted(first)[:entries]]
    books = [[x[p * d : (p + 1) * d] for x in start] for p in range(parts)]

    def assign():
        out = []
        for x in ints:
            code = []
            for p in range(parts):
                piece = x[p * d : (p + 1) * d]
                found = [sum((a - b) ** 2 for a, b in zip(piece, e)) for e in books[p]]
                code.append((found.index(min(found)), min(found)))
            out.append(code)
        return out

    for _ in range(rounds):
        codes = assign()
        for p in range(parts):
            for e in range(len(books[p])):
                mine = [x[p * d : (p + 1) * d] for x, c in zip(ints, codes) if c[p][0] == e]
                if mine:
                    books[p][e] = [sum(v) // len(mine) for v in zip(*mine)]
    codes = assign()
    digest = hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()
    errors = [sum(c[1] for c in code) for code in codes]
    of = {}
    for r, e in zip(kept, errors):
        of[r[2]] = of.get(r[2], 0) + e
    return sorted(((r[0], "".join(f"{c[0]:02x}" for c in code), e, of[r[2]], digest) for r, code, e in zip(kept, codes, errors)), key=str)


def compressed(spark, rows, **how):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return sorted((tuple(r) for r in C.compress(df, **how).collect()), key=str)


def test_equals_brute_force(spark):
    rows = clustered(400)
    assert compressed(spark, rows) == brute(rows)


def test_more_rounds_skip_scans(spark):
    rows = clustered(600, width=8)
    how = dict(parts=4, entries=24, rounds=6)
    assert compressed(spark, rows, **how) == brute(rows, **how)
    _, history, scanned = C.encode(spark.createDataFrame(rows, SCHEMA), **how)
    assert len(history) == 7 and scanned[0] == 600 * 4
    # bounds settle most parts without a look at the entries
    assert scanned[-1] < scanned[0] / 2


def test_net_displacement_is_tighter_than_drift():
    # an entry that goes and comes back costs nothing
    there, away = np.zeros((1, 2, 2), np.int64), np.full((1, 2, 2), 100)
    assert (C.falls([there, away, there])[0] == 0).all()
    assert (C.falls([there, away])[0] > 141).all()
    # the fall for an entry is that of the others
    moved = there.copy()
    moved[0, 1] = [3, 4]
    assert C.falls([there, moved])[0, 0].round(6).tolist() == [5.0, 0.0]


def test_ties_go_to_the_lower_entry(spark):
    rows = [(i, [float(i % 3)] * 4, 0) for i in range(40)]
    assert compressed(spark, rows, parts=2, entries=8) == brute(rows, parts=2, entries=8)


def test_edge_cases(spark):
    rows = clustered(90, width=10, seed=5)  # no multiple of 16
    rows += [(200, None, 1), (201, [1.0, None], 1), (202, [float("nan")] * 10, 1), (203, [float("-inf")] * 10, 0)]
    rows += [(None, rows[2][1], None), (-5, rows[3][1][:7], None), (204, [], 2), (7, [0.5] * 10, 2), rows[9]]
    assert compressed(spark, rows) == brute(rows)
    few = clustered(5)
    assert compressed(spark, few) == brute(few)
    assert compressed(spark, []) == []
    assert [r[1:3] for r in compressed(spark, [(None, [1.0] * 16, 1)])] == [(None, None)]
    clash = spark.createDataFrame(few, SCHEMA).selectExpr("*", "1 AS code", "2 AS x", "3 AS error", "4 AS of")
    assert sorted((tuple(r) for r in C.compress(clash).collect()), key=str) == brute(few)
    with pytest.raises(Exception, match="too long"):
        compressed(spark, [(0, [1e30] * 16, 1)])
