"""Registered queries of the training-data operators: name -> callable(spark, sf_dir)."""

from __future__ import annotations

from . import byte_bpe, direct_codes, line_templates, lsh_forest, packing, paragraph_sketch, progressive_jpeg, quality, token_counts, toxicity

QUERIES = {
    "op10_toxicity": toxicity.op10_toxicity,
    "op1_line_templates": line_templates.op1_line_templates,
    "op2_token_counts": token_counts.op2_token_counts,
    "op3_direct_codes": direct_codes.op3_direct_codes,
    "op4_quality": quality.op4_quality,
    "op5_packing": packing.op5_packing,
    "op6_near_duplicates": lsh_forest.op6_near_duplicates,
    "op7_paragraph_sketch": paragraph_sketch.op7_paragraph_sketch,
    "op8_progressive_jpeg": progressive_jpeg.op8_progressive_jpeg,
    "op9_byte_bpe": byte_bpe.op9_byte_bpe,
}
#: None of these can be written in SQL (tokenizers, trained models, exact Jaccard graphs, sketches); tests hold them against brute force.
ORACLE_SQL: dict[str, str] = {}
