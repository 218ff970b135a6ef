"""The corpus queries by name, and the SQL of those that SQL can express on whole tables."""

from __future__ import annotations

from . import bpe_stream, decontaminate, language, licenses, lm_score, ngram_join, quality, token_files, topk_search, toxicity

QUERIES = {
    "op1_quality_gbt": quality.op1_quality_gbt,
    "op2_decontaminate_cgk": decontaminate.op2_decontaminate_cgk,
    "op3_language_crossparse": language.op3_language_crossparse,
    "op4_masked_lm": lm_score.op4_masked_lm,
    "op5_ngram_jaccard": ngram_join.op5_ngram_jaccard,
    "op6_token_files": token_files.op6_token_files,
    "op7_bpe_stream": bpe_stream.op7_bpe_stream,
    "op8_license_scan": licenses.op8_license_scan,
    "op9_toxicity_subword": toxicity.op9_toxicity_subword,
    "op10_topk_maxscore": topk_search.op10_topk_maxscore,
}

ORACLES = {
    "op5_ngram_jaccard": ngram_join.ORACLE_SQL,
    "op10_topk_maxscore": topk_search.ORACLE_SQL,
}
