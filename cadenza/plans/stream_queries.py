"""Streaming extensions over the events table, run to completion."""

from __future__ import annotations

from cadenza.plans.registry import Registry
from cadenza.streaming import events

query = Registry()
QUERIES, ORACLE = query.queries, query.oracle


@query(
    """WITH m AS (SELECT *, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 30 MINUTE AS same FROM events),
    g AS (SELECT *, sum(CASE WHEN same THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS r FROM m)
    SELECT user_id, min(ts) AS "start", max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM g GROUP BY user_id, r"""
)
def stream_sessions(spark, d):
    return events.run_to_table(events.sessions(events.table_stream(spark, d, "events"), "user_id", "ts", late=None), "sessions", "complete")


@query(
    """WITH e AS (SELECT value, epoch_us(ts) // 900000000 AS q FROM events), w AS (SELECT value, unnest([q - 3, q - 2, q - 1, q]) AS q FROM e)
    SELECT make_timestamp(q * 900000000) AS "start", count(*) AS n, sqrt(avg(value * value)) AS rms FROM w GROUP BY q"""
)
def stream_sliding_rms(spark, d):
    return events.run_to_table(events.sliding(events.table_stream(spark, d, "events"), "ts", "value", late=None), "sliding", "complete")
