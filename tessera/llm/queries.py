"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from . import bpe, divergence, exact_dedup, hard_negatives, html_extraction, langid, mixing, pii, simhash, substring_dedup, suffix_dedup, topk, toxicity


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_substring_dedup": substring_dedup.op1,
    "op2_language_id": langid.op2,
    "op3_exact_dedup": exact_dedup.op3,
    "op4_source_mixing": mixing.op4,
    "op5_toxicity": toxicity.op5,
    "op6_exact_top_k": topk.op6,
    "op7_byte_bpe": bpe.op7,
    "op8_pii": pii.op8,
    "op9_suffix_array_dedup": suffix_dedup.op9,
    "op10_simhash_near_dedup": simhash.op10,
    "op11_html_extraction": html_extraction.op11,
    "op12_hard_negatives": hard_negatives.op12,
    "op13_source_divergence": divergence.op13,
    "pipeline": pipeline,
}

ORACLES = {
    "op1_substring_dedup": substring_dedup.ORACLE,
    "op3_exact_dedup": exact_dedup.ORACLE,
    "op4_source_mixing": mixing.ORACLE,
    "op6_exact_top_k": topk.ORACLE,
    "op11_html_extraction": html_extraction.ORACLE,
    "op12_hard_negatives": hard_negatives.ORACLE,
    "op13_source_divergence": divergence.ORACLE,
}
