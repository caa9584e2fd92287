"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from ledgerfield.llm import chat, counts, decontaminate, graph, merkle, packing, periods, quality, \
    repeats, sharding, simhash, substrings, topk

QUERIES = {
    "op1_resharding": sharding.op1_resharding,
    "op2_chat_formatting": chat.op2_chat_formatting,
    "op3_exact_topk": topk.op3_exact_topk,
    "op4_suffix_array_dedup": repeats.op4_suffix_array_dedup,
    "op5_substring_dedup": substrings.op5_substring_dedup,
    "op6_quality_classifier": quality.op6_quality_classifier,
    "op7_packing": packing.op7_packing,
    "op8_simhash": simhash.op8_simhash,
    "op9_benchmark_decontamination": decontaminate.op9_benchmark_decontamination,
    "op10_token_counts": counts.op10_token_counts,
    "op11_merkle_manifest": merkle.op11_merkle_manifest,
    "op12_graph_search": graph.op12_graph_search,
    "op13_periodic_runs": periods.op13_periodic_runs,
}
ORACLES = {
    "op2_chat_formatting": chat.SQL,
    "op3_exact_topk": topk.SQL,
    "op11_merkle_manifest": merkle.SQL,
}
