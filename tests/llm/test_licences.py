import pytest
from pyspark.sql import functions as F

from cohortlens.llm import licences

from .conftest import by_id, text_of

MIT = dict((i, t) for i, t in licences.TEXTS if t.startswith("Permission is hereby"))["MIT"]


def variants():
    header = "The MIT License (MIT)\n\nCopyright (c) 2019-2021 Some One <some@example.com>\nAll rights reserved.\n\n"
    wrapped = " ".join(MIT.split())
    return [
        (1, MIT),
        (2, header + MIT),
        (3, wrapped.upper()),
        (4, MIT.replace('"', "“").replace("sublicense", "sub-license").replace("\n", "\r\n   * ")),
        (5, "© 2020 X\n" + MIT),
        (6, MIT + " and more"),
        (7, MIT.replace("free of charge", "at a charge")),
    ]


def test_whole_texts(make):
    got = by_id(licences.scan(make(variants())))
    assert [got[i]["licence"] for i in range(1, 8)] == ["MIT"] * 5 + [None, None]
    assert len({got[i]["digest"] for i in (1, 3, 4, 5)}) == 1


def test_every_known_text_is_found(make):
    rows = [(i, t) for i, (_, _, t) in enumerate(licences.known_texts())]
    got = by_id(licences.scan(make(rows)))
    for i, (unit, licence, _) in enumerate(licences.known_texts()):
        assert got[i]["licence"] == licence, (unit, licence)


def test_notices(make, rng):
    rows = [
        (1, f"{text_of(rng, 9)}\nLicensed under CC BY-NC 4.0.\n{text_of(rng, 9)}\nReleased under the MIT Licence"),
        (2, f"{text_of(rng, 9)} Licensed under CC BY-NC 4.0."),
        (3, None),
        (4, ""),
        (5, "This work is licensed under the GNU General Public License, version 3."),
        (6, "\n".join(["released under the mit license"] * 500)),
        (7, "word " * 300_000),
        (None, "Released under the MIT License."),
        (1, "Licensed under the Apache License, Version 2.0."),
    ]
    docs = make(rows).withColumn("digest", F.lit(1)).withColumn("licence", F.lit("x")).withColumn("of", F.lit(1))
    got = licences.scan(docs).collect()
    notices = {(r.doc_id, r.notices, r.licence) for r in got}
    assert notices == {
        (1, "Apache-2.0,CC-BY-NC-4.0,MIT", None),
        (1, "Apache-2.0,CC-BY-NC-4.0,MIT", "Apache-2.0"),
        (2, "", None),
        (3, "", None),
        (4, "", None),
        (5, "GPL-3.0", "GPL-3.0"),
        (6, "MIT", None),
        (7, "", None),
        (None, "MIT", "MIT"),
    }
    assert all(r.n_notices == len([x for x in r.notices.split(",") if x]) for r in got)


def test_own_licences(spark, make):
    own = spark.createDataFrame([("House", "Use it as you like,\nbut wisely."), (None, "x"), ("Empty", " ")], "licence string, text string")
    got = by_id(licences.scan(make([(1, "use it as you like but wisely"), (2, ""), (3, "x")]), own))
    assert [got[i]["licence"] for i in (1, 2, 3)] == ["House", None, None]
    assert licences.scan(make([]), own).count() == 0


@pytest.mark.parametrize("text", ["copyright notice, this list of conditions", "The above copyright notice"])
def test_sentences_about_copyright_stay(spark, text):
    df = spark.createDataFrame([(text,)], "t string").select(licences.canonical_lines(F.col("t")).alias("c"))
    assert "copyright notice" in df.first().c


WITHOUT_TEXT = {"AGPL-3.0", "CC-BY-4.0", "CC-BY-NC-4.0"}


def test_whole_licences_of_all_names(make):
    files = licences.file_texts()
    assert {i for i, _ in licences.NAMES} - {i for i, _ in (*licences.TEXTS, *files)} == WITHOUT_TEXT
    header_only = {"Apache-2.0": 9_000, "MPL-2.0": 16_000}
    assert all(any(i == x and len(t) > n for i, t in files) for x, n in header_only.items())
    rows = [(n, "\n * ".join(t.split("\n"))) for n, (_, t) in enumerate(files)]
    got = by_id(licences.scan(make(rows)))
    assert [got[n]["licence"] for n in range(len(files))] == [i for i, _ in files]


HOLDERS = (
    "Copyright (c) Jane Doe",
    "Copyright Jane Doe 2019",
    "Copyright (c) The Regents of the University of California. All rights reserved.",
    "Copyright <YYYY> <HOLDER>",
    "Copyright The Regents of the University",
    "Copyright by Émile Zola",
    "Copyright: Noti",
    "(c) Jane Doe",
    "© Jane Doe",
    "(C) Copyright Jane Doe",
    "Copyright [yyyy] [name of copyright owner]",
)


@pytest.mark.parametrize("licence", ["MIT", "BSD-3-Clause"])
def test_copyright_lines_of_any_holder(make, licence):
    text = next(t for i, t in licences.TEXTS if i == licence)
    got = by_id(licences.scan(make([(n, f"{line}\n * {line}\r\n\n{text}") for n, line in enumerate(HOLDERS)])))
    assert {HOLDERS[n]: r["licence"] for n, r in got.items()} == dict.fromkeys(HOLDERS, licence)


SENTENCES = (
    "copyright notice, this list", "Copyright holders be liable", "COPYRIGHT OWNER OR", "copyright license to reproduce",
    "copyright the software, and", "copyright law", "copyright", "copyright, patent", "copyrighted by", "copyright on the",
    "(c) You must retain", "(c) under Patent Claims", "(c) the name", "copyright permission", "Copyright and Related Rights",
)


def test_sentence_lines_stay_in_both_engines(spark):
    duckdb = pytest.importorskip("duckdb")
    files = [t for _, t in licences.file_texts()]
    # the known texts wrapped so that each "copyright" starts a line
    broken = [" ".join(t.lower().split()).replace("copyright", "\ncopyright") for t in files]
    lines = [*SENTENCES, *HOLDERS]
    df = spark.createDataFrame([(x.lower(),) for x in [*lines, *broken]], "t string")
    cut = df.select("t", F.regexp_replace("t", licences.COPYRIGHT_LINE, "\n").alias("c")).collect()
    assert {r.t for r in cut if r.c.strip()} & {x.lower() for x in lines} == {x.lower() for x in SENTENCES}
    for r in cut:
        assert duckdb.execute("SELECT regexp_replace(?, ?, chr(10), 'g')", [r.t, licences.COPYRIGHT_LINE]).fetchone()[0] == r.c


def test_digest_of_a_line_is_made_once(make):
    """Not again in the tests on the key that the optimizer infers for the join."""
    docs = make([(1, "MIT License\nsome words"), (2, None), (3, "\n\n")])
    plan = licences.scan(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert not [step for step in plan.split("\n") if "Filter" in step and "sha2" in step and "line" in step]
    assert [r["n_notices"] for _, r in sorted(by_id(licences.scan(docs)).items())][1:] == [0, 0]
