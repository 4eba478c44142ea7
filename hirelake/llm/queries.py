"""The operators' registered queries and, where SQL can express them, their DuckDB oracles."""

from . import byte_bpe, decontaminate, edit_prints, hard_negatives, language_id, lm_scoring, quality, sharding, simhash, substring_dedup, toxicity, url_filter, whitening

QUERIES = {
    "op1_quality_rules": quality.op1_quality_rules,
    "op2_simhash_near_dedup": simhash.op2_simhash_near_dedup,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_decontamination": decontaminate.op4_decontamination,
    "op5_lm_scoring": lm_scoring.op5_lm_scoring,
    "op6_substring_dedup": substring_dedup.op6_substring_dedup,
    "op7_url_filter": url_filter.op7_url_filter,
    "op8_extendible_sharding": sharding.op8_extendible_sharding,
    "op9_byte_bpe": byte_bpe.op9_byte_bpe,
    "op10_language_id": language_id.op10_language_id,
    "op11_edit_fingerprints": edit_prints.op11_edit_fingerprints,
    "op12_hard_negatives": hard_negatives.op12_hard_negatives,
    "op13_embedding_whitening": whitening.op13_embedding_whitening,
}
ORACLES = {"op4_decontamination": decontaminate.OP4_SQL, "op6_substring_dedup": substring_dedup.OP6_SQL, "op8_extendible_sharding": sharding.OP8_SQL, "op12_hard_negatives": hard_negatives.OP12_SQL}
