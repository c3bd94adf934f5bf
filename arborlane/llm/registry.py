"""The registered queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import bpe, context_tree, fingerprints, infill, language, packing, quality, repair, resampling, secrets, sharding, simhash, urlfilter

QUERIES = {
    "op1_secret_ownership": secrets.query,
    "op2_context_tree": context_tree.query,
    "op3_bk_tree_simhash": simhash.query,
    "op4_kneser_ney_bands": quality.query,
    "op5_importance_resampling": resampling.query,
    "op6_viterbi_language": language.query,
    "op7_multiset_hash": fingerprints.query,
    "op8_minimum_bin_slack": packing.query,
    "op9_maglev_sharding": sharding.query,
    "op10_tree_bpe": bpe.query,
    "op11_distinct_text_infill": infill.query,
    "op12_grammar_repair": repair.query,
    "op13_blocked_bloom_urls": urlfilter.query,
}

ORACLES: dict[str, str] = {
    "op11_distinct_text_infill": infill.SQL,
    "op12_grammar_repair": repair.SQL,
    "op13_blocked_bloom_urls": urlfilter.SQL,
}
