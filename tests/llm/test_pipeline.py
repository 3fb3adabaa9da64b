import re
from collections import Counter

import corpus_pipeline
from cohortlens.llm import mixing

from .test_decontaminate import brute as contaminated
from .test_jaccard import brute as components
from .test_line_dedup import brute as kept_lines

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    columns, before = docs.columns, docs.collect()
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        after = docs.collect()
        texts = {r.doc_id: r.text for r in before}
        if name != "mix":
            assert docs.columns == columns and all(r.n_chars == len(r.text) for r in after)
        if name == "quality":
            known = [(r.doc_id in {x.doc_id for x in after}, labels[r.doc_id]) for r in before if r.doc_id in labels]
            assert sum(k == bool(q) for k, q in known) >= 0.95 * len(known)
            assert all(r.text == texts[r.doc_id] for r in after)
        elif name == "line dedup":
            want = kept_lines([(r.doc_id, r.text) for r in before])
            gone = {r.doc_id for r in before if len(want[r.doc_id]) < len(r.text.split("\n")) and not "".join(want[r.doc_id]).split()}
            assert {r.doc_id: r.text for r in after} == {d: "\n".join(k) for d, k in want.items() if d not in gone}
        elif name == "near duplicates":
            want = components([(r.doc_id, r.text) for r in before])
            assert {r.doc_id for r in after} == {d for d, (n, c) in want.items() if not n or c == d}
        elif name == "decontamination":
            want = contaminated([(r.doc_id, r.text) for r in before], items)
            assert {r.doc_id for r in after} == {d for d, v in want.items() if not v[4]}
        else:
            taken = {r.doc_id: r.taken for r in mixing.mix(spark.createDataFrame(before)).collect()}
            passes = Counter(r.doc_id for r in after)
            for d, text in texts.items():
                assert passes[d] * len(re.findall(r"[^\x20\x09-\x0D]+", text)) == taken[d]
        before = after
    assert before


def test_run_agrees_with_itself(spark):
    a, b = (corpus_pipeline.run(spark, SF) for _ in range(2))
    assert a.columns == ["doc_id", "text", "lang", "source", "n_chars", "copy"]
    rows = sorted(a.collect())
    assert rows and rows == sorted(b.collect())
    assert corpus_pipeline.ORACLE_SQL is None


def test_empty_table(spark, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
