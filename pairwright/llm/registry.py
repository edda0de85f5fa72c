"""Queries of the subpackage and the SQL that states their results, where SQL can."""
from __future__ import annotations

import corpus_pipeline

from . import op1_wavelet, op2_chat, op3_secrets, op4_bpe, op5_ann, op6_exact, op7_toxicity, op8_sharding, op9_simhash, op10_packing, op11_negatives, op12_substrings, op13_spelling

QUERIES = {
    "op1_wavelet_matrix": op1_wavelet.query,
    "op2_chat_role_repair": op2_chat.query,
    "op3_secret_automata": op3_secrets.query,
    "op4_byte_bpe_duckdb": op4_bpe.query,
    "op5_posting_lists_ann": op5_ann.query,
    "op6_exact_dedup_index": op6_exact.query,
    "op7_toxicity_subwords": op7_toxicity.query,
    "op8_sharding_best_fit": op8_sharding.query,
    "op9_simhash_blocks": op9_simhash.query,
    "op10_vector_packing": op10_packing.query,
    "op11_hyperplane_negatives": op11_negatives.query,
    "op12_suffix_substrings": op12_substrings.query,
    "op13_kd_spelling": op13_spelling.query,
    "pipeline": corpus_pipeline.run,
}

ORACLE_SQL = {
    "op6_exact_dedup_index": op6_exact.ORACLE_SQL,
    "op11_hyperplane_negatives": op11_negatives.ORACLE_SQL,
    "op12_suffix_substrings": op12_substrings.ORACLE_SQL,
}
if corpus_pipeline.ORACLE_SQL:
    ORACLE_SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
