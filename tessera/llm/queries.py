"""The registered queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from tessera.llm import chat, decontaminate, importance, lm_scoring, ngram_join, packing, quality, sharding, syncmers, token_files, url_filter, vector_codes, warc

QUERIES = {
    "op1_consistent_hash_sharding": sharding.op1,
    "op2_warc_archives": warc.op2,
    "op3_best_fit_packing": packing.op3,
    "op4_perspective_rotation": chat.op4,
    "op5_closed_syncmer_fingerprints": syncmers.op5,
    "op6_ngram_jaccard_join": ngram_join.op6,
    "op7_latent_decontamination": decontaminate.op7,
    "op8_token_id_files": token_files.op8,
    "op9_additive_quality_classifier": quality.op9,
    "op10_cross_entropy_difference": lm_scoring.op10,
    "op11_url_filters": url_filter.op11,
    "op12_importance_resampling": importance.op12,
    "op13_vector_codes": vector_codes.op13,
}

ORACLE_SQL = {
    "op2_warc_archives": warc.ORACLE,
    "op4_perspective_rotation": chat.ORACLE,
    "op6_ngram_jaccard_join": ngram_join.ORACLE,
    "op11_url_filters": url_filter.ORACLE,
    "op13_vector_codes": vector_codes.ORACLE,
}
