"""The queries of the training-data operators."""

from __future__ import annotations

from sightline.llm import chunk_recipes, decontaminate, language_id, lexical_search, license_scan, line_dedup, near_duplicates, packing, quality, suffix_dedup, url_filter, warc_revisit, whitening

QUERIES = {
    "op1_quality_rules": quality.op1_quality_rules,
    "op2_suffix_dedup": suffix_dedup.op2_suffix_dedup,
    "op3_ngram_jaccard_join": near_duplicates.op3_ngram_jaccard_join,
    "op4_warc_revisits": warc_revisit.op4_warc_revisits,
    "op5_license_scan": license_scan.op5_license_scan,
    "op6_best_fit_packing": packing.op6_best_fit_packing,
    "op7_language_id": language_id.op7_language_id,
    "op8_url_filter": url_filter.op8_url_filter,
    "op9_line_dedup": line_dedup.op9_line_dedup,
    "op10_decontaminate": decontaminate.op10_decontaminate,
    "op11_lexical_search": lexical_search.op11_lexical_search,
    "op12_embedding_whitening": whitening.op12_embedding_whitening,
    "op13_exact_dedup": chunk_recipes.op13_exact_dedup,
}
ORACLES: dict[str, str] = {
    "op4_warc_revisits": warc_revisit.OP4_SQL,
    "op5_license_scan": license_scan.OP5_SQL,
    "op9_line_dedup": line_dedup.OP9_SQL,
    "op11_lexical_search": lexical_search.OP11_SQL,
    "op13_exact_dedup": chunk_recipes.OP13_SQL,
}
