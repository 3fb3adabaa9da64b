import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cohortlens.llm import mixing

from .conftest import text_of


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def test_targets():
    assert mixing.targets([("a", 10), ("b", 100), ("c", 100)], (3, 1, 2), 1.5, 2) == pytest.approx([20, 295 / 3, 200 - 10 / 3])
    assert mixing.targets([("a", 0), ("b", 10)], (3, 1, 2), 1.5, 2) == pytest.approx([0, 15])
    assert mixing.targets([], (3, 1, 2), 1.5, 2) == []
    assert mixing.targets([("a", 5)], (3, 1, 2), 3.0, 2) == [10]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 12), st.integers(0, 4)), min_size=1, max_size=6), st.integers(0, 90))
def test_knapsack_is_nearest(items, budget):
    lengths, counts = np.array([i[0] for i in items]), np.array([i[1] for i in items])
    take = mixing.knapsack(lengths, counts, budget)
    assert (take >= 0).all() and (take <= counts).all()
    sums = {0}
    for length, n in items:
        sums = {s + k * length for s in sums for k in range(n + 1)}
    assert abs(int((take * lengths).sum()) - budget) == min(abs(s - budget) for s in sums)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 500), st.integers(1, 50)), min_size=1, max_size=20, unique_by=lambda x: x[0]), st.floats(0, 1))
def test_fit_stays_in_bounds(items, part):
    lengths, counts = np.array([i[0] for i in items]), np.array([i[1] for i in items])
    budget = round(float((lengths * counts).sum()) * part)
    take = mixing.fit(lengths, counts, budget)
    assert (take >= 0).all() and (take <= counts).all()
    assert abs(int((take * lengths).sum()) - budget) <= lengths.max()


def cases(rng):
    rows = [(i, text_of(rng, rng.randint(0, 60)), "en", f"s{i % 4}", 1) for i in range(300)]
    rows += [(1000 + i, text_of(rng, 25), "en", "hot", 1) for i in range(400)]
    rows += [(2000 + i, text_of(rng, 10), "en", None, 1) for i in range(9)]
    return rows + [(3000, None, "en", "s1", None), (3001, " \n", "en", "blank", 2), (None, "a b c", "en", "s2", 5), (5, "x y", "en", "s1", 3)]


def test_mix(make, rng):
    rows = cases(rng)
    got = mixing.mix(make(rows)).collect()
    assert Counter((r.doc_id, r["size"]) for r in got) == Counter((r[0], size(r[1])) for r in rows)
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += size(r[1])
    order = sorted(sizes.items(), key=lambda x: (x[0] is None, x[0] or ""))
    want = dict(zip((s for s, _ in order), mixing.targets(order, (3, 1, 2), 1.5, 2)))
    taken = defaultdict(int)
    source = {(r[0], size(r[1])): r[3] for r in rows}
    for r in got:
        s = source[r.doc_id, r["size"]]
        assert r.target == want[s] and r.source_size == sizes[s]
        assert 0 <= r.taken <= 2 * r["size"] and (r["size"] == 0 or r.taken % r["size"] == 0)
        taken[s] += r.taken
    for s, t in want.items():
        assert abs(taken[s] - t) <= 61
    again = mixing.mix(make(rows)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_mix_is_repeated(make, rng):
    rows = cases(rng)
    docs = make(rows).withColumnRenamed("lang", "copy")
    mixed = mixing.mix(docs)
    out = mixing.repeat_documents(docs, mixed)
    assert out.columns == [*docs.columns, "_copy"]
    assert sum(size(r.text) for r in out.collect()) == sum(r.taken for r in mixed.collect())
    assert max(Counter((r.doc_id, r.text) for r in out.collect()).values()) <= 2
    unique = make([r for r in rows if r[0] not in (5,)])
    out = mixing.repeat_documents(unique, mixing.mix(unique))
    assert sum(size(r.text) for r in out.collect()) == sum(r.taken for r in mixing.mix(unique).collect())


def test_empty(make):
    assert mixing.mix(make([])).columns == ["doc_id", "size", "source_size", "target", "taken"]
    assert mixing.mix(make([])).count() == 0 and mixing.repeat_documents(make([]), mixing.mix(make([]))).count() == 0
