import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cohortlens.llm import line_dedup

from .conftest import by_id, text_of


def distance(a, b, t=3):
    """Edit distance, or t + 1 if it is larger."""
    if abs(len(a) - len(b)) > t:
        return t + 1
    row = {j: j for j in range(min(t, len(b)) + 1)}
    for i, x in enumerate(a, 1):
        new = {}
        for j in range(max(0, i - t), min(len(b), i + t) + 1):
            options = [row.get(j, t + 1) + 1, new.get(j - 1, t + 1) + 1]
            if j:
                options.append(row.get(j - 1, t + 1) + (x != b[j - 1]))
            new[j] = min(options)
        row = new
    return min(row.get(len(b), t + 1), t + 1)


def edited(rng, line, n):
    out = list(line)
    for _ in range(n):
        i = rng.randrange(len(out))
        out[i : i + 1] = rng.choice(([], ["é"], [out[i], "x"]))
    return "".join(out)


def brute(rows, t=2, shortest=20):
    """Kept lines of each document (unique ids)."""
    seen, out = [], {}
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        kept = []
        for line in (text or "").split("\n"):
            if not line.strip(" \t\n\x0b\x0c\r"):
                kept.append(line)
                continue
            if len(line) < shortest:
                if line not in seen:
                    kept.append(line)
                seen.append(line)
                continue
            if not any(len(x) >= shortest and abs(len(line) - len(x)) <= t and distance(line, x) <= t for x in seen):
                kept.append(line)
            seen.append(line)
        out[doc] = kept
    return out


def cases(rng):
    base = [text_of(rng, rng.randint(3, 12)) for _ in range(25)]
    pool = [edited(rng, rng.choice(base), rng.randint(0, 4)) for _ in range(60)] + base
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(1, 6)))) for i in range(40)]
    rows += [(50, ""), (51, None), (52, "\n\n"), (53, "short\nshort"), (56, "short\n \t\nshort one"), (57, "shorts\n\nshort one\n \t"), (54, base[0]), (55, base[0] + "\n" + base[0])]
    rows += [(60, "z" * 20_000), (61, "z" * 19_998), (62, "z" * 19_990), (None, base[1] + "q")]
    return rows


def test_within_is_the_edit_distance(spark):
    rng = random.Random(3)
    pairs = [("".join(rng.choice("abé") for _ in range(rng.randint(0, 8))), "".join(rng.choice("abé") for _ in range(rng.randint(0, 8)))) for _ in range(400)]
    df = spark.createDataFrame(pairs, "a string, b string")
    for t in (1, 2, 3):
        got = df.select("a", "b", line_dedup.within(F.col("a"), F.col("b"), t).alias("w")).collect()
        assert all(r.w == (distance(r.a, r.b) <= t) for r in got)


@settings(max_examples=15, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 3))
def test_segments_leave_no_pair_out(spark, seed, t):
    rng = random.Random(seed)
    rows = []
    for _ in range(60):
        a = "".join(rng.choice("ab") for _ in range(rng.randint(t + 1, 14)))
        b = edited(rng, a, rng.randint(0, t))
        if len(b) > t and len(b) > 0:
            rows.append((a, b))
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, a string, b string")
    a, b = (line_dedup.keyed(df.select("id", F.col(c).alias("line"), F.char_length(c).alias("length")), t) for c in "ab")
    met = a.alias("a").join(b.alias("b"), ["id", "key"]).where("a.own OR b.own").select("id").distinct()
    # segments of the shorter line must not be empty
    near = df.where(line_dedup.within(F.col("a"), F.col("b"), t) & (F.least(F.char_length("a"), F.char_length("b")) > t))
    assert near.join(met, "id", "left_anti").count() == 0
    counts = [line_dedup._with_counts(df.select("id", F.col(c).alias("line"), F.char_length(c).alias("length"))) for c in "ab"]
    both = counts[0].select("id", F.col("counts").alias("x")).join(counts[1].select("id", F.col("counts").alias("y")), "id")
    assert near.join(both.where(line_dedup._near_counts("x", "y", t)), "id", "left_anti").count() == 0


def test_matches_brute_force(make, rng):
    rows = cases(rng)
    want = brute(rows)
    got = by_id(line_dedup.report(make(rows)))
    for doc, text in rows:
        n = len(text.split("\n")) if text else 0
        kept = "\n".join(want[doc])
        assert got[doc]["n_lines"] == n
        assert got[doc]["kept_sha256"] == hashlib.sha256(kept.encode()).hexdigest(), doc
        assert got[doc]["n_removed"] == (n - len(want[doc]) if text else 0)


def test_lines_are_removed(make, rng):
    rows = cases(rng)
    docs = make(rows).withColumn("line", F.lit("x")).withColumn("kept_lines", F.lit(1)).withColumn("stay_lines_flags", F.lit(2))
    want = brute(rows)
    out = line_dedup.remove_lines(docs, drop_emptied=False)
    assert out.columns == docs.columns and out.schema == docs.schema
    got = by_id(out)
    for doc, text in rows:
        assert got[doc]["text"] == (None if text is None else "\n".join(want[doc]))
        assert got[doc]["n_chars"] == (None if text is None else len(got[doc]["text"]))
    some = by_id(line_dedup.remove_lines(docs))
    gone = {d for d, t in rows if t and len(want[d]) < len(t.split("\n")) and not "".join(want[d]).split()}
    assert set(some) == {d for d, _ in rows} - gone and 54 in gone and {50, 51, 52, 53} <= set(some)


def test_a_template_of_many_lines(make):
    rows = [(i, f"this line is a template with a number {i:04d} in it") for i in range(150)]
    got = by_id(line_dedup.report(make(rows)))
    want = brute(rows)
    assert {d: r["n_removed"] for d, r in got.items()} == {d: 1 - len(k) for d, k in want.items()}


def test_repeated_rows_and_empty(make):
    line = "a line that is long enough to count"
    twice = line_dedup.report(make([(1, line), (1, line), (2, line)])).collect()
    assert sorted((r.doc_id, r.n_removed) for r in twice) == [(1, 0), (1, 0), (2, 1)]
    assert line_dedup.report(make([])).count() == 0 and line_dedup.remove_lines(make([])).count() == 0
    with pytest.raises(ValueError):
        line_dedup.report(make([]), max_edits=20)
    exact = by_id(line_dedup.report(make([(1, line), (2, line + "s"), (3, line)]), max_edits=0))
    assert [exact[i]["n_removed"] for i in (1, 2, 3)] == [0, 0, 1]


def test_rows_among_ids(spark, monkeypatch):
    for bits in (1 << 27, 1 << 15):
        monkeypatch.setattr(line_dedup, "MAP_BITS", bits)
        for kind in ("bigint", "decimal(31,0)"):
            rows = spark.range(-20_000, 20_000).select(F.col("id").cast(kind).alias("id"), F.lit("x").alias("line"))
            ids = rows.where("id % 7 = 0").select("id")
            got = line_dedup.among(rows, ids)
            assert got.columns == rows.columns
            assert got.count() == ids.count() and got.where("id % 7 <> 0").count() == 0
            assert line_dedup.among(rows, ids.limit(0)).count() == 0


def test_ids_too_far_apart_for_64_bits(make, rng):
    rows = [(None if d is None else d * (1 << 56) - (1 << 62), t) for d, t in cases(rng)]
    assert line_dedup.Places.of(make(rows)).wide and not line_dedup.Places.of(make(rows[:1])).wide
    want = brute(rows)
    got = by_id(line_dedup.report(make(rows)))
    assert all(got[d]["kept_sha256"] == hashlib.sha256("\n".join(want[d]).encode()).hexdigest() for d, _ in rows)
