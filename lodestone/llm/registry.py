"""Queries of the training-data operators and, where SQL can express them, their DuckDB statements."""

from __future__ import annotations

from . import chat, decontamination, fingerprints, licenses, mixing, ngram_join, search, spelling, substring, token_counts, toxicity, warc, whitening

QUERIES = {
    "op1_toxicity": toxicity.query,
    "op2_mixing": mixing.query,
    "op3_ngram_join": ngram_join.query,
    "op4_chat": chat.query,
    "op5_decontamination": decontamination.query,
    "op6_warc": warc.query,
    "op7_search": search.query,
    "op8_token_counts": token_counts.query,
    "op9_licenses": licenses.query,
    "op10_substring": substring.query,
    "op11_fingerprints": fingerprints.query,
    "op12_whitening": whitening.query,
    "op13_spelling": spelling.query,
}
ORACLES = {"op2_mixing": mixing.SQL, "op3_ngram_join": ngram_join.SQL, "op4_chat": chat.SQL, "op5_decontamination": decontamination.SQL, "op6_warc": warc.SQL, "op7_search": search.SQL, "op10_substring": substring.SQL}
