"""Registered queries of this subpackage and the SQL of those that SQL expresses."""

from __future__ import annotations

from . import decontaminate, html_text, language, mixing, ngram_join, quality_rules, resampling, toxicity, url_lists, warc

QUERIES = {
    "op1_html_extraction": html_text.op1,
    "op2_benchmark_decontamination": decontaminate.op2,
    "op3_url_filter": url_lists.op3,
    "op4_source_mixing": mixing.op4,
    "op5_warc_transactions": warc.op5,
    "op6_ngram_jaccard_join": ngram_join.op6,
    "op7_language_id": language.op7,
    "op8_quality_rules": quality_rules.op8,
    "op9_importance_resampling": resampling.op9,
    "op10_toxicity_chain": toxicity.op10,
}

ORACLE: dict[str, str] = {
    "op2_benchmark_decontamination": decontaminate.OP2_SQL,
    "op3_url_filter": url_lists.OP3_SQL,
    "op4_source_mixing": mixing.OP4_SQL,
    "op5_warc_transactions": warc.OP5_SQL,
    "op6_ngram_jaccard_join": ngram_join.OP6_SQL,
}
