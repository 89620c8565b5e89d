"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from evgraph.llm import (
    chat,
    cross_polytope,
    divergence,
    exact_dedup,
    hard_negatives,
    html_extract,
    language_id,
    line_dedup,
    mixing,
    packing,
    sharding,
    simhash,
    token_files,
)

QUERIES = {
    "op1_sharding": sharding.op1_sharding,
    "op2_simhash_near_dedup": simhash.op2_simhash_near_dedup,
    "op3_html_extraction": html_extract.op3_html_extraction,
    "op4_chat_formatting": chat.op4_chat_formatting,
    "op5_line_dedup": line_dedup.op5_line_dedup,
    "op6_packing": packing.op6_packing,
    "op7_mixing": mixing.op7_mixing,
    "op8_language_id": language_id.op8_language_id,
    "op9_embedding_near_dedup": cross_polytope.op9_embedding_near_dedup,
    "op10_exact_dedup": exact_dedup.op10_exact_dedup,
    "op11_hard_negative_mining": hard_negatives.op11_hard_negative_mining,
    "op12_source_divergence_audit": divergence.op12_source_divergence_audit,
    "op13_token_files": token_files.op13_token_files,
}

ORACLE_SQL = {
    "op4_chat_formatting": chat.OP4_SQL,
    "op5_line_dedup": line_dedup.OP5_SQL,
    "op10_exact_dedup": exact_dedup.OP10_SQL,
    "op11_hard_negative_mining": hard_negatives.OP11_SQL,
    "op12_source_divergence_audit": divergence.OP12_SQL,
}
