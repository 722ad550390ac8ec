"""Queries and SQL of the operators, for the entry module."""

from __future__ import annotations

from quietcount.llm import bpe, exact_dedup, mixing, ngram_join, packing, periodic, pii, quality_rules, secrets, spelling, toxicity, url_filter, warc

MODULES = (quality_rules, secrets, ngram_join, bpe, warc, url_filter, exact_dedup, mixing, pii, toxicity, packing, periodic, spelling)

QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLES = {k: s for m in MODULES for k, s in m.ORACLES.items()}
