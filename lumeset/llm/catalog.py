"""Queries of the pipeline operators and their DuckDB counterparts."""

from __future__ import annotations

from lumeset.llm import anisotropic_search, best_fit_packing, flat_blocks, hard_negatives, lookup_clusters, risk_controlled_quality, simhash_tiles, slot_shards, source_mix, subword_quality, suffix_repeats, url_reputation, warc_zstd

QUERIES = {
    "op1_slot_shards": slot_shards.op1_slot_shards,
    "op2_anisotropic_search": anisotropic_search.op2_anisotropic_search,
    "op3_source_mix": source_mix.op3_source_mix,
    "op4_warc_zstd": warc_zstd.op4_warc_zstd,
    "op5_best_fit_packing": best_fit_packing.op5_best_fit_packing,
    "op6_flat_blocks": flat_blocks.op6_flat_blocks,
    "op7_simhash_tiles": simhash_tiles.op7_simhash_tiles,
    "op8_risk_controlled_quality": risk_controlled_quality.op8_risk_controlled_quality,
    "op9_url_reputation": url_reputation.op9_url_reputation,
    "op10_suffix_repeats": suffix_repeats.op10_suffix_repeats,
    "op11_hard_negatives": hard_negatives.op11_hard_negatives,
    "op12_subword_quality": subword_quality.op12_subword_quality,
    "op13_lookup_clusters": lookup_clusters.op13_lookup_clusters,
}

ORACLES = {
    "op3_source_mix": source_mix.ORACLE_SQL,
    "op4_warc_zstd": warc_zstd.ORACLE_SQL,
    "op8_risk_controlled_quality": risk_controlled_quality.oracle_sql(),
    "op9_url_reputation": url_reputation.ORACLE_SQL,
    "op11_hard_negatives": hard_negatives.ORACLE_SQL,
    "op13_lookup_clusters": lookup_clusters.ORACLE_SQL,
}
