"""The queries of the text operators and the SQL of those that SQL can state."""

from __future__ import annotations

from quillon.llm import bpe, html, jaccard, langid, lattice, licenses, linededup, mixing, quality, urls

QUERIES = {
    "op1_language_id": langid.op1_language_id,
    "op2_license_scans": licenses.op2_license_scans,
    "op3_quality_rules": quality.op3_quality_rules,
    "op4_line_dedup": linededup.op4_line_dedup,
    "op5_bpe": bpe.op5_bpe,
    "op6_embedding_near_dedup": lattice.op6_embedding_near_dedup,
    "op7_html_extraction": html.op7_html_extraction,
    "op8_ngram_jaccard": jaccard.op8_ngram_jaccard,
    "op9_mixing": mixing.op9_mixing,
    "op10_url_filters": urls.op10_url_filters,
}

ORACLE = {"op2_license_scans": licenses.ORACLE, "op10_url_filters": urls.ORACLE}
