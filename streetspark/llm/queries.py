"""The queries of the training-data operators, and their SQL for DuckDB."""

from __future__ import annotations

from . import fingerprints, line_dedup, mixing, ngram_jaccard, pii, quality_rules, sentencepieces, toxicity, url_filters, warc

QUERIES = {
    "op1_warc": warc.op1,
    "op2_sentencepiece": sentencepieces.op2,
    "op3_quality_rules": quality_rules.op3,
    "op4_mixing": mixing.op4,
    "op5_line_dedup": line_dedup.op5,
    "op6_fingerprints": fingerprints.op6,
    "op7_toxicity": toxicity.op7,
    "op8_pii": pii.op8,
    "op9_url_filters": url_filters.op9,
    "op10_ngram_jaccard": ngram_jaccard.op10,
}
ORACLE_SQL = {
    "op1_warc": warc.op1_sql(),
    "op4_mixing": mixing.op4_sql(),
    "op9_url_filters": url_filters.op9_sql(),
}
