"""Queries of this subpackage and their SQL, gathered from its modules."""

from __future__ import annotations

from docloom.llm import decontaminate, exactdedup, language, mixing, pages, phrases, pii, quality, records, search, shinglejoin, urls, vectors

_MODULES = (shinglejoin, decontaminate, pii, mixing, records, vectors, pages, urls, quality, language, search, phrases, exactdedup)
QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
ORACLES = {k: s for m in _MODULES for k, s in m.ORACLES.items()}
