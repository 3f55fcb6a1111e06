"""Queries of the text operators and their SQL checks."""

from __future__ import annotations

from larkspur.llm import bpe, byte_bpe, centroid_clustering, exact_dedup, jaccard_join, lexical_search, license_scan, line_dedup, lm_score, mixing, quality, substring_dedup, toxicity

MODULES = (exact_dedup, quality, jaccard_join, toxicity, line_dedup, bpe, license_scan, mixing, lm_score, substring_dedup, centroid_clustering, lexical_search, byte_bpe)
QUERIES = {name: fn for module in MODULES for name, fn in module.QUERY.items()}
ORACLES = {name: sql for module in MODULES for name, sql in module.ORACLE.items()}
