"""The operators as named queries over whole tables, with SQL where SQL can say it."""

from __future__ import annotations

from revsieve.llm import (
    bpe, byte_bpe, decontaminate, filter_audit, hard_negatives, language, line_rules, near_copies, ppm, ranking_quality, sharding, substring,
    surrogates,
)

QUERIES = {
    "op1_rendezvous_shards": sharding.op1_rendezvous_shards,
    "op2_keyed_surrogates": surrogates.op2_keyed_surrogates,
    "op3_partial_matching": ppm.op3_partial_matching,
    "op4_prefix_bpe": bpe.op4_prefix_bpe,
    "op5_bradley_terry": ranking_quality.op5_bradley_terry,
    "op6_containment_search": decontaminate.op6_containment_search,
    "op7_order_min_hash": near_copies.op7_order_min_hash,
    "op8_relative_lempel_ziv": substring.op8_relative_lempel_ziv,
    "op9_marginal_unigrams": language.op9_marginal_unigrams,
    "op10_line_frequency_rules": line_rules.op10_line_frequency_rules,
    "op11_tiktoken_bytes": byte_bpe.op11_tiktoken_bytes,
    "op12_hilbert_zone_maps": hard_negatives.op12_hilbert_zone_maps,
    "op13_filter_interactions": filter_audit.op13_filter_interactions,
}
ORACLE = {
    "op1_rendezvous_shards": sharding.OP1_SQL,
    "op6_containment_search": decontaminate.OP6_SQL,
    "op8_relative_lempel_ziv": substring.OP8_SQL,
    "op12_hilbert_zone_maps": hard_negatives.OP12_SQL,
    "op13_filter_interactions": filter_audit.OP13_SQL,
}
