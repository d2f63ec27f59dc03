"""The queries of the text operators: ``name -> (query, SQL or None)``."""

from __future__ import annotations

from crossfactor.llm import (
    decontaminate, filter_audit, html_text, importance, language, mixing, quality, sharding, simhash, token_prefix, toxicity, url_lists, vector_lsh,
)

ENTRIES = {
    "op1_language": (language.query, None),
    "op2_main_text": (html_text.query, None),
    "op3_url_lists": (url_lists.query, url_lists.SQL),
    "op4_simhash_groups": (simhash.query, None),
    "op5_toxicity": (toxicity.query, None),
    "op6_mix_sources": (mixing.query, mixing.SQL),
    "op7_shards": (sharding.query, None),
    "op8_token_counts": (token_prefix.query, None),
    "op9_benchmark_passages": (decontaminate.query, None),
    "op10_vector_groups": (vector_lsh.query, None),
    "op11_filter_audit": (filter_audit.query, filter_audit.SQL),
    "op12_importance": (importance.query, None),
    "op13_quality": (quality.query, None),
}
