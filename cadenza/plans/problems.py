"""Queries of the general data problems (1 and 5)."""

from __future__ import annotations

from cadenza.operators.drift import consistent_table, schema_changes
from cadenza.operators.timelines import periods_and_gaps
from cadenza.sources.tables import spread, table

USABLE = """usable AS (
  SELECT DISTINCT workspace_id, idx, seg_uid,
         'speaker_' || lpad(regexp_extract(lower(speaker), '([0-9]+)', 1), 2, '0') AS speaker,
         CAST(round(start_s * 1000) AS BIGINT) AS start_ms, CAST(round(end_s * 1000) AS BIGINT) AS end_ms
  FROM timeline_segment WHERE trim(speaker) <> '' AND end_s > start_s)"""


def p1_found(spark, sf_dir):
    return periods_and_gaps(table(spark, sf_dir, "timeline_segment"))


P1_FOUND = f"""WITH {USABLE},
marked AS (SELECT *, max(end_ms) OVER (PARTITION BY workspace_id, speaker ORDER BY start_ms, end_ms, idx
                                       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM usable),
numbered AS (SELECT *, sum(CASE WHEN prev IS NULL OR start_ms > prev THEN 1 ELSE 0 END)
                       OVER (PARTITION BY workspace_id, speaker ORDER BY start_ms, end_ms, idx ROWS UNBOUNDED PRECEDING) AS g FROM marked),
period AS (SELECT workspace_id, speaker, g, min(start_ms) AS s, max(end_ms) AS e, count(*) AS n FROM numbered GROUP BY ALL),
following AS (SELECT *, lead(s) OVER (PARTITION BY workspace_id, speaker ORDER BY s) AS nxt FROM period)
SELECT workspace_id, speaker, 'merged' AS kind, s AS start_ms, e AS end_ms FROM period WHERE n >= 2
UNION ALL SELECT workspace_id, speaker, 'gap', e, nxt FROM following WHERE nxt IS NOT NULL"""

def p5_found(spark, sf_dir):
    return schema_changes(spread(table(spark, sf_dir, "raw_record")))


def p5_history(spark, sf_dir):
    return consistent_table(table(spark, sf_dir, "raw_record"), "history")


def p5_timeline(spark, sf_dir):
    return consistent_table(table(spark, sf_dir, "raw_record"), "timeline")


def p5_manifest(spark, sf_dir):
    return consistent_table(table(spark, sf_dir, "raw_record"), "manifest")


QUERIES = {"p1_found": p1_found, "p5_found": p5_found, "p5_history": p5_history, "p5_timeline": p5_timeline, "p5_manifest": p5_manifest}
ORACLE = {"p1_found": P1_FOUND}
