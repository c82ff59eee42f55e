"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from quillon.llm import chat, decontaminate, dedup, language, packing, pii, quality, resample, rules, toxicity, trie, urls, wavelet

MODULES = [pii, chat, urls, wavelet, quality, rules, packing, decontaminate, language, dedup, resample, trie, toxicity]
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
