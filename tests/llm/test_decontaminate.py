import hashlib
import re

import pyarrow as pa
from pyspark.sql import functions as F

from cohortlens.llm import decontaminate
from cohortlens.llm.tokens import text_buffer

from .conftest import by_id, text_of


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def shout(text):
    """Upper case of a-z only."""
    return "".join(c.upper() if "a" <= c <= "z" else c for c in text)


def brute(docs, items, n=10):
    out = {}
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for item, t in items:
            iw = words(t)
            size = min(n, len(iw))
            if not size or item is None:
                continue
            grams = {tuple(iw[i : i + size]) for i in range(len(iw) - size + 1)}
            for i in range(len(w) - size + 1):
                if tuple(w[i : i + size]) in grams:
                    hit.update(range(i, i + size))
                    found.add(str(item))
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out[doc] = (len(w), len(hit), len(found), digest, bool(hit))
    return out


def bench(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def cases(rng):
    items = [(i, text_of(rng, 14 + i)) for i in range(8)] + [(20, "One two, THREE"), (21, ""), (22, None), (23, "  ,, ")]
    items += [(3, items[3][1]), (30, items[4][1][: len(items[4][1]) // 2] + " extra"), (100, "ömega")]
    docs = [(i, text_of(rng, rng.randint(0, 80))) for i in range(30)]
    docs += [(100, None), (101, ""), (102, "one Two three"), (103, "x " + shout(items[0][1]).replace(" ", " -- ") + " y")]
    docs += [(104, items[1][1] + " " + items[2][1]), (105, "Ömega ömega")]
    docs += [(106, " ".join(items[5][1].split()[3:14])), (107, "a" * 3_000_000 + " " + items[6][1])]
    return docs, items


def test_matches_brute_force(spark, make, rng):
    docs, items = cases(rng)
    got = by_id(decontaminate.contamination(make(docs), bench(spark, items)))
    want = brute(docs, items)
    assert {k: tuple(v)[1:] for k, v in got.items()} == want
    assert got[103]["contaminated"] and got[104]["n_items"] >= 2 and got[107]["contaminated"]


def test_blocks_give_the_same(spark, make, rng):
    docs, items = cases(rng)
    whole = by_id(decontaminate.contamination(make(docs), bench(spark, items)))
    parts = by_id(decontaminate.contamination(make(docs), bench(spark, items), block_bytes=150))
    assert whole == parts


def test_removal_and_spans(spark, make, rng):
    docs, items = cases(rng)
    table = make(docs).withColumn("hit", F.lit(1)).withColumn("n_words", F.lit("x"))
    clean = {k for k, v in brute(docs, items).items() if not v[4]}
    kept = decontaminate.remove_documents(table, bench(spark, items))
    assert kept.columns == table.columns and {r.doc_id for r in kept.collect()} == clean
    cut = by_id(decontaminate.remove_spans(table, bench(spark, items)))
    before = dict(docs)
    assert all(cut[k]["text"] == before[k] for k in clean)
    assert cut[103]["text"] == "x  y" and words(cut[104]["text"]) == []
    assert not any(v[4] for v in brute([(k, r["text"]) for k, r in cut.items() if k not in (105,)], items[:8]).values())


def test_removal_does_not_depend_on_blocks(spark, make, rng):
    docs, items = cases(rng)
    # two items of different blocks overlap in the text: what one cuts must not hide the other
    long = text_of(rng, 40).split()
    items = [(500, " ".join(long[:24])), *items, (501, " ".join(long[16:]))]
    docs += [(200, "before " + " ".join(long) + " after"), (200, "before " + " ".join(long) + " after"), (None, items[0][1] + " z")]
    table = make(docs).selectExpr("*", "7 AS hit_words", "'x' AS marks")
    for remove in (decontaminate.remove_documents, decontaminate.remove_spans):
        whole, parts = (remove(table, bench(spark, items), block_bytes=size) for size in (1 << 20, 150))
        assert whole.columns == parts.columns == table.columns
        assert whole.count() == parts.count() and whole.exceptAll(parts).isEmpty()
    assert {r.text for r in parts.where("doc_id = 200").collect()} == {"before  after"}


def test_empty_tables_and_repeated_rows(spark, make, rng):
    docs, items = cases(rng)
    none = decontaminate.contamination(make([]), bench(spark, items))
    assert none.columns == ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"] and not none.collect()
    assert not any(r.contaminated for r in decontaminate.contamination(make(docs), bench(spark, [])).collect())
    twice = [(1, items[0][1]), (1, items[0][1]), (None, items[0][1])]
    assert [r.contaminated for r in decontaminate.contamination(make(twice), bench(spark, items)).collect()] == [True] * 3


def test_equal_hashes_are_verified():
    table = decontaminate.build([("a", "one two three"), ("b", "four five six")])
    data, off = text_buffer(pa.array(["one two three", "four five six", "other"]))
    # both windows under one hash: only the words decide
    t = table.tables[3]
    t.keys[:] = t.keys[0]
    hits = decontaminate.scan(data, off, table)
    assert sum(hits.hit) in (3, 6) and set(hits.items) <= {0, 1}
