"""Registered queries: the operators applied to the supplied tables, each with its SQL."""

from __future__ import annotations

from lodestream.plans import dialogue_queries, retrieval_queries, session_queries, store_queries, text_queries

QUERIES: dict = {}
ORACLES: dict = {}
for _module in (text_queries, retrieval_queries, store_queries, dialogue_queries, session_queries):
    if _twice := QUERIES.keys() & _module.QUERIES.keys():
        raise ValueError(f"queries of two modules have the same name: {sorted(_twice)}")
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
