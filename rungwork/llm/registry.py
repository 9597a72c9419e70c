"""Queries of the llm operators and their SQL."""

from __future__ import annotations

from rungwork.llm import consensus, keep_together, leak, mixing, overlap, pii, reading, similar_sets, transcripts

_MODULES = (consensus, pii, keep_together, overlap, similar_sets, transcripts, leak, mixing, reading)


def queries():
    return {name: f for m in _MODULES for name, f in m.QUERIES.items()}


def oracle_sql():
    return {name: sql for m in _MODULES for name, sql in m.ORACLE.items()}
