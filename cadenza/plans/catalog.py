"""All queries of the core library and their SQL."""

from __future__ import annotations

from cadenza.plans import join_queries, problems, record_queries, sequence_queries, signal_queries, stream_queries, text_queries

MODULES = [problems, text_queries, join_queries, sequence_queries, record_queries, signal_queries, stream_queries]


def queries():
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql():
    return {k: s for m in MODULES for k, s in m.ORACLE.items()}
