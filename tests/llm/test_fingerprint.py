import hashlib
import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from cohortlens.llm import fingerprint
from cohortlens.llm.fingerprint import ATTEMPTS, BINS, BIN_BITS, BITS

from .conftest import by_id, text_of


def signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


def h_text(text, seed=42):
    return xxhash.xxh64_intdigest(text.encode(), seed)


def h_long(value, seed=42):
    return xxhash.xxh64_intdigest((value & (2**64 - 1)).to_bytes(8, "little"), seed)


def h_int(value, seed=42):
    """Spark hashes a 32-bit number by a rule of its own."""
    p1, p2, p3, p5 = 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5
    m = 2**64 - 1
    x = (seed + p5 + 4) & m
    x ^= ((value & 0xFFFFFFFF) * p1) & m
    x = (((x << 23 | x >> 41) & m) * p2 + p3) & m
    x = ((x ^ x >> 33) * p2) & m
    x = ((x ^ x >> 29) * p3) & m
    return x ^ x >> 32


def shingles(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if len(w) < 5:
        return {h_text(" ".join(w))} if w else set()
    hashes = [signed(h_text(x)) for x in w]
    out = set()
    for i in range(len(w) - 4):
        seed = 42
        for x in hashes[i : i + 5]:
            seed = h_long(x, seed)
        out.add(seed)
    return out


def brute(text):
    """Bin by bin, with the loop of attempts."""
    found = {}
    for x in map(signed, shingles(text)):
        b = (x >> (64 - BIN_BITS)) + BINS // 2
        found[b] = min(x, found.get(b, x))
    if not found:
        return ""
    out = []
    for b in range(BINS):
        value = found.get(b)
        for t in range(ATTEMPTS):
            if value is None:
                value = found.get(signed(h_int(b, h_int(t))) % BINS)
        if value is None:
            value = found[min(found, key=lambda x: signed(h_int(x, h_int(b, h_int(-1)))))]
        out.append(f"{value & ((1 << BITS) - 1):x}")
    return "".join(out)


def test_matches_brute_force(make, rng):
    rows = [(i, text_of(rng, n)) for i, n in enumerate([0, 1, 4, 5, 6, 12, 40, 300, 3000])] + [(20, None), (21, " \n"), (22, "A Bé c D e F")]
    got = by_id(fingerprint.fingerprints(make(rows).withColumn("f_words", F.lit(1))))
    for doc, text in rows:
        assert got[doc]["fingerprint"] == brute(text), doc


def test_edited_pairs(make, rng):
    rows = [(i * 7, text_of(rng, rng.randint(0, 50))) for i in range(60)] + [(1000, None), (-3, "é" * 9), (8, ""), (500, "x" * 200_000)]
    got = by_id(fingerprint.edited_pairs(make(rows).withColumn("range", F.lit(1)).withColumn("bits", F.lit(2))))
    order = sorted(rows, reverse=True)
    for (doc, text), (_, after) in zip(order, order[1:] + order[:1]):
        text, after, r = text or "", after or "", got[doc]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["fingerprint"] == brute(text) and r["edited_fingerprint"] == brute(edited)
        for near, other in (("near_edited", brute(edited)), ("near_next", brute(after))):
            a, b = r["fingerprint"], other
            same = sum(x == y for x, y in zip(a, b)) / BINS
            want = 1.0 if not a and not b else 0.0 if not a or not b else max(0.0, (same - 2**-BITS) / (1 - 2**-BITS))
            assert abs(r[near] - want) < 1e-12


def test_likeness_estimates_jaccard(make):
    rng = random.Random(8)
    rows, truth = [], []
    for i in range(60):
        n = rng.choice((15, 60, 400))
        words = [f"w{rng.random()}" for _ in range(n)]
        other = words[: n - n // rng.choice((2, 3, 5))]
        other += [f"v{rng.random()}" for _ in range(n - len(other))]
        rows += [(2 * i + 1, " ".join(words)), (2 * i, " ".join(other))]
        a, b = shingles(rows[-2][1]), shingles(rows[-1][1])
        truth.append(len(a & b) / len(a | b))
    got = by_id(fingerprint.edited_pairs(make(rows)))
    errors = np.array([got[2 * i + 1]["near_next"] for i in range(60)]) - truth
    assert np.abs(errors).mean() < 0.06 and abs(errors.mean()) < 0.03


def test_ties_nulls_and_empty(make):
    rows = [(1, "a b c"), (1, "a b c"), (1, "d e f"), (None, "x y"), (2, "a b c")]
    got = fingerprint.edited_pairs(make(rows)).collect()
    assert len(got) == 5 and len({r.fingerprint for r in got if r.n_chars == 5}) == 2
    assert len(fingerprint.edited_pairs(make([(5, "one only here")])).collect()) == 1
    assert fingerprint.edited_pairs(make([(5, "one only here")])).first().near_next == 1.0
    assert fingerprint.edited_pairs(make([])).count() == 0
