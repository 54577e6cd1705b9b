"""Registered queries of the corpus operators, and their SQL."""

from __future__ import annotations

from strandlake.llm import html_extract, imatch, jaccard, language, lm_score, mixing, pieces, pii, quality, url_filter

QUERIES = {
    "op1_html_extract": html_extract.op1_html_extract,
    "op2_jaccard": jaccard.op2_jaccard,
    "op3_quality": quality.op3_quality,
    "op4_imatch": imatch.op4_imatch,
    "op5_lm_score": lm_score.op5_lm_score,
    "op6_pieces": pieces.op6_pieces,
    "op7_url_filter": url_filter.op7_url_filter,
    "op8_pii": pii.op8_pii,
    "op9_language": language.op9_language,
    "op10_mixing": mixing.op10_mixing,
}
ORACLES = {
    "op2_jaccard": jaccard.ORACLE,
    "op3_quality": quality.ORACLE,
    "op7_url_filter": url_filter.ORACLE,
    "op10_mixing": mixing.ORACLE,
}
