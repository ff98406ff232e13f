"""The dealt operators as registered queries, and DuckDB SQL where SQL can express them."""

from __future__ import annotations

from . import (bpe, host_rules, line_dedup, near_dedup, norm_buckets, perspectives, prefix_trie, repair, rff_classifier,
               source_mix, token_files, trie_bpe, xent_difference)

QUERIES = {
    "op1_xent_difference": xent_difference.query,
    "op2_norm_bucketed_topk": norm_buckets.query,
    "op3_superminhash_near_dedup": near_dedup.query,
    "op4_line_dedup": line_dedup.query,
    "op5_perspective_rotation": perspectives.query,
    "op6_byte_bpe": bpe.query,
    "op7_host_rules": host_rules.query,
    "op8_source_mix": source_mix.query,
    "op9_rff_quality": rff_classifier.query,
    "op10_plane_token_files": token_files.query,
    "op11_prefix_trie": prefix_trie.query,
    "op12_integer_repair": repair.query,
    "op13_trie_bpe": trie_bpe.query,
}

ORACLE: dict[str, str] = {
    "op1_xent_difference": xent_difference.ORACLE,
    "op2_norm_bucketed_topk": norm_buckets.ORACLE,
    "op5_perspective_rotation": perspectives.ORACLE,
    "op7_host_rules": host_rules.ORACLE,
    "op11_prefix_trie": prefix_trie.ORACLE,
    "op12_integer_repair": repair.ORACLE,
}
