"""The registered queries of the text operators and the SQL they are held against."""

from __future__ import annotations

from lumenarc.llm import brown, exact_dedup, filter_audit, imatch, jaccard_join, language_id, line_dedup, mixing, packing, prefix_trie, quality, sharding, url_filter

QUERIES = {
    "op1_imatch": imatch.op1_imatch,
    "op2_url_filter": url_filter.op2_url_filter,
    "op3_quality": quality.op3_quality,
    "op4_brown": brown.op4_brown,
    "op5_jaccard_join": jaccard_join.op5_jaccard_join,
    "op6_mixing": mixing.op6_mixing,
    "op7_packing": packing.op7_packing,
    "op8_exact_dedup": exact_dedup.op8_exact_dedup,
    "op9_line_dedup": line_dedup.op9_line_dedup,
    "op10_language_id": language_id.op10_language_id,
    "op11_filter_audit": filter_audit.op11_filter_audit,
    "op12_sharding": sharding.op12_sharding,
    "op13_prefix_trie": prefix_trie.op13_prefix_trie,
}

ORACLES = {"op2_url_filter": url_filter.ORACLE, "op8_exact_dedup": exact_dedup.ORACLE, "op11_filter_audit": filter_audit.ORACLE, "op13_prefix_trie": prefix_trie.ORACLE}
