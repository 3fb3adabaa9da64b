"""The text operators as registered queries."""

from __future__ import annotations

from cohortlens.llm import (
    decontaminate,
    fingerprint,
    hard_negatives,
    jaccard,
    licences,
    line_dedup,
    mixing,
    quality,
    substring_dedup,
    suffix_dedup,
    surrogates,
    toxicity,
    vector_codes,
)
from cohortlens.llm.common import table


def op1_quality(spark, sf_dir):
    return quality.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_mix(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents"))


def op3_line_dedup(spark, sf_dir):
    return line_dedup.report(table(spark, sf_dir, "documents"))


def op4_substring_dedup(spark, sf_dir):
    return substring_dedup.repeats(table(spark, sf_dir, "documents"))


def op5_fingerprint(spark, sf_dir):
    return fingerprint.edited_pairs(table(spark, sf_dir, "documents"))


def op6_decontaminate(spark, sf_dir):
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_surrogates(spark, sf_dir):
    return surrogates.report(table(spark, sf_dir, "documents"))


def op8_licences(spark, sf_dir):
    return licences.scan(table(spark, sf_dir, "documents"))


def op9_suffix_dedup(spark, sf_dir):
    return suffix_dedup.repeats(table(spark, sf_dir, "documents"))


def op10_jaccard(spark, sf_dir):
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


def op11_hard_negatives(spark, sf_dir):
    relabel = "CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END"
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), relabel=relabel, anchor="vec_id % 50 = 0")


def op12_vector_codes(spark, sf_dir):
    return vector_codes.compress(table(spark, sf_dir, "embeddings"))


def op13_toxicity(spark, sf_dir):
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {
    "op1_quality": op1_quality,
    "op2_mix": op2_mix,
    "op3_line_dedup": op3_line_dedup,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_fingerprint": op5_fingerprint,
    "op6_decontaminate": op6_decontaminate,
    "op7_surrogates": op7_surrogates,
    "op8_licences": op8_licences,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_jaccard": op10_jaccard,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_vector_codes": op12_vector_codes,
    "op13_toxicity": op13_toxicity,
}
