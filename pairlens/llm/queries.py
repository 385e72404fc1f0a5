"""Queries and SQL of this subpackage."""

from __future__ import annotations

from . import alignment, byte_bpe, fingerprints, lm_scores, media, mixing, near_dedup, packing, pii, prefix_trie, quality, token_counts, token_store

MODULES = (near_dedup, packing, token_store, media, token_counts, pii, quality, lm_scores, byte_bpe, fingerprints, mixing, alignment, prefix_trie)


def queries() -> dict:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for module in MODULES for name, sql in getattr(module, "SQL", {}).items()}
