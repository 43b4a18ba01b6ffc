"""Queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from skein.llm import op01_token_planes, op02_mixing, op03_jaccard_join, op04_substring_dedup, op05_quality, op06_suffix_array_dedup, op07_pii, op08_permutation_ann, op09_line_dedup, op10_packing

QUERIES = {
    "op1_token_planes": op01_token_planes.op1_token_planes,
    "op2_mixing": op02_mixing.op2_mixing,
    "op3_jaccard_join": op03_jaccard_join.op3_jaccard_join,
    "op4_substring_dedup": op04_substring_dedup.op4_substring_dedup,
    "op5_quality": op05_quality.op5_quality,
    "op6_suffix_array_dedup": op06_suffix_array_dedup.op6_suffix_array_dedup,
    "op7_pii": op07_pii.op7_pii,
    "op8_permutation_ann": op08_permutation_ann.op8_permutation_ann,
    "op9_line_dedup": op09_line_dedup.op9_line_dedup,
    "op10_packing": op10_packing.op10_packing,
}
ORACLE_SQL = {
    "op2_mixing": op02_mixing.OP2_SQL,
    "op3_jaccard_join": op03_jaccard_join.OP3_SQL,
    "op4_substring_dedup": op04_substring_dedup.OP4_SQL,
    "op6_suffix_array_dedup": op06_suffix_array_dedup.OP6_SQL,
    "op9_line_dedup": op09_line_dedup.OP9_SQL,
}
