import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.llm import jaccard
from cohortlens.llm.components import components

from .conftest import by_id, text_of


def shingles(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if len(w) < 5:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute(rows, t=80):
    sets = {d: shingles(x) for d, x in rows}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets, key=lambda d: (d is not None, d or 0))
    rank = {d: i for i, d in enumerate(ids)}
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                if x != y:
                    parent[max(x, y, key=rank.get)] = min(x, y, key=rank.get)
    return {d: (len(sets[d]), find(d)) for d in ids}


def near(rng, text, edits):
    w = text.split()
    for _ in range(edits):
        i = rng.randrange(len(w))
        w[i : i + 1] = rng.choice(([], [f"new{rng.randint(0, 9)}"], [w[i], "more"]))
    return " ".join(w)


def cases(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, at = [], 0
    for size in (6, 12, 40, 120, 300):
        for _ in range(6):
            base = text_of(rng, size, vocabulary)
            for _ in range(rng.randint(1, 5)):
                rows.append((at, near(rng, base, rng.randint(0, max(1, size // 30)))))
                at += 1
    passage = text_of(rng, 60, vocabulary)
    rows += [(at + i, text_of(rng, rng.randint(5, 40), vocabulary) + " " + passage) for i in range(25)]
    at += 25
    chain = text_of(rng, 100, vocabulary).split()
    for i in range(8):  # each links to the next only
        rows.append((at + i, " ".join(chain)))
        chain[10 * i : 10 * i + 3] = [f"c{i}"]
    at += 8
    hot = text_of(rng, 50, vocabulary)
    rows += [(at + i, near(rng, hot, rng.randint(0, 2))) for i in range(30)]
    at += 30
    rows += [(at, None), (at + 1, ""), (at + 2, " \t"), (at + 3, "one two"), (at + 4, "One TWO"), (at + 5, "one two three"), (None, hot)]
    rows += [(at + 6, "same " * 5000), (at + 7, "same " * 300)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("frequent", [False, True])
def test_matches_brute_force(make, monkeypatch, frequent):
    if frequent:  # every class that holds a few tokens counts as frequent
        monkeypatch.setattr(jaccard, "excess_from", lambda usual: 2 - usual)  # classes of three tokens are frequent
    rows = cases(1 + frequent)
    got = by_id(jaccard.near_duplicates(make(rows)))
    assert {d: tuple(r)[1:] for d, r in got.items()} == brute(rows)


def test_combinations_are_indexed(make, monkeypatch):
    # popular passages fill the end of every short text, so few prefix tokens are frequent
    monkeypatch.setattr(jaccard, "excess_from", lambda usual: 2 - usual)  # classes of three tokens are frequent
    rng = random.Random(6)
    parts = [text_of(rng, 12, [f"p{i}" for i in range(50)]) for _ in range(4)]
    rows = [(i, " ".join(rng.sample(parts, 3)) + f" t{i % 7}") for i in range(60)]
    kinds = []
    real = jaccard.index_rows
    rows_of = [real(*_indexed(r[1]), np.full(jaccard.CLASSES, 9, np.uint8), 80)[2] for r in rows]
    kinds = {int(k) & 3 for f in rows_of for k in f}
    assert kinds & {jaccard.PAIR, jaccard.FEW, jaccard.MANY}
    got = by_id(jaccard.near_duplicates(make(rows)))
    assert {d: tuple(r)[1:] for d, r in got.items()} == brute(rows)


def _indexed(text):
    import pyarrow as pa

    from cohortlens.llm.tokens import text_buffer

    owner, value, at = jaccard.shingle_sets(*text_buffer(pa.array([text])))
    return value, owner, at


def test_keep_one(make):
    rows = cases(3)
    docs = make(rows).withColumn("n", F.lit(1)).withColumn("node", F.lit("x"))
    want = brute(rows)
    out = jaccard.keep_one(docs)
    assert out.columns == docs.columns
    assert {r.doc_id for r in out.collect()} == {d for d, (n, c) in want.items() if n == 0 or c == d}
    text = " ".join(f"w{i}" for i in range(30))
    twice = jaccard.keep_one(make([(1, text), (1, text), (2, text), (3, ""), (3, "")])).collect()
    assert sorted(r.doc_id for r in twice) == [1, 3, 3]


def test_empty_and_repeated_rows(make):
    assert jaccard.near_duplicates(make([])).count() == 0 and jaccard.keep_one(make([])).count() == 0
    text = " ".join(f"w{i}" for i in range(30))
    got = jaccard.near_duplicates(make([(4, text), (4, text), (4, "other words"), (9, text)])).collect()
    assert sorted(tuple(r) for r in got) == [(4, 1, 4), (4, 26, 4), (4, 26, 4), (9, 26, 4)]


def test_names_that_clash_are_made_anew(make, monkeypatch):
    real = jaccard.names_of

    def clashing(value, at, seed):
        node, check = real(value, at, seed)
        return (node * 0 if seed == 1 else node), check

    monkeypatch.setattr(jaccard, "names_of", clashing)
    node, check = jaccard.names_of(np.arange(6, dtype=np.uint64), np.array([0, 2, 6]), 1)
    assert node[0] == node[1] and check[0] != check[1]


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(100, 160)] + [(0, i) for i in range(1, 40)] + [(rng.randint(200, 300), rng.randint(200, 300)) for _ in range(60)]
    rng.shuffle(edges)
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: find(n) for e in edges if e[0] != e[1] for n in e}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
