"""Queries of the training-data problems that are about language."""

from __future__ import annotations

from cadenza.llm.encodings import repaired_documents
from cadenza.llm.language import language_faults, text_languages
from cadenza.llm.leakage import leaked_items, reparameterised_items
from cadenza.llm.packing import container_fill, fill_containers
from cadenza.llm.pairs import main_defect, pair_defects
from cadenza.llm.runs import event_runs, repeated_runs
from cadenza.llm.transcripts import clean_turns, turn_bounds
from cadenza.sources.tables import spread, table


def p6_found(spark, sf_dir):
    return repeated_runs(table(spark, sf_dir, "timeline_segment")).select("workspace_id", "first_idx", "last_idx")


SEGMENT = ["seg_uid", "language_pair", "source_text", "target_text", "target_lang", "is_non_speech"]


def segments(spark, sf_dir):
    return spread(table(spark, sf_dir, "timeline_segment").select(*SEGMENT))


def documents(spark, sf_dir):
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


def p2_found(spark, sf_dir):
    return turn_bounds(table(spark, sf_dir, "transcript_segment"), table(spark, sf_dir, "speaker_profile"))


def p2_clean_turns(spark, sf_dir):
    return clean_turns(table(spark, sf_dir, "transcript_segment"), table(spark, sf_dir, "speaker_profile"))


def p3_found(spark, sf_dir):
    return language_faults(segments(spark, sf_dir)).select("seg_uid", "kind", "lang")


def p3_languages(spark, sf_dir):
    return text_languages(segments(spark, sf_dir))


def p4_found(spark, sf_dir):
    return main_defect(segments(spark, sf_dir))


def p4_defects(spark, sf_dir):
    return pair_defects(segments(spark, sf_dir))


def p7_containers(spark, sf_dir):
    return fill_containers(documents(spark, sf_dir), table(spark, sf_dir, "container_spec"))


def p7_fill(spark, sf_dir):
    return container_fill(p7_containers(spark, sf_dir), table(spark, sf_dir, "container_spec"))


def p8_found(spark, sf_dir):
    return leaked_items(documents(spark, sf_dir), table(spark, sf_dir, "eval_item")).select("doc_id", "item_id")


def p8_reparameterised(spark, sf_dir):
    return reparameterised_items(documents(spark, sf_dir), table(spark, sf_dir, "eval_item"))


def p9_found(spark, sf_dir):
    return repaired_documents(documents(spark, sf_dir)).select("doc_id").distinct()


def p9_restored(spark, sf_dir):
    return repaired_documents(documents(spark, sf_dir))


P6_FOUND = """WITH usable AS (
  SELECT DISTINCT workspace_id, idx, seg_uid,
         'speaker_' || lpad(regexp_extract(lower(speaker), '([0-9]+)', 1), 2, '0') AS speaker,
         CAST(round(start_s * 1000) AS BIGINT) AS s, CAST(round(end_s * 1000) AS BIGINT) AS e
  FROM timeline_segment WHERE trim(speaker) <> '' AND end_s > start_s),
marked AS (SELECT *, speaker = lag(speaker) OVER w AND abs((e - s) - lag(e - s) OVER w) <= 50 AND s - lag(e) OVER w <= 250 AS same
           FROM usable WINDOW w AS (PARTITION BY workspace_id ORDER BY s, idx)),
numbered AS (SELECT *, sum(CASE WHEN same THEN 0 ELSE 1 END) OVER (PARTITION BY workspace_id ORDER BY s, idx ROWS UNBOUNDED PRECEDING) AS g FROM marked)
SELECT workspace_id, arg_min(idx, s * 1000000 + idx) AS first_idx, arg_max(idx, s * 1000000 + idx) AS last_idx
FROM numbered GROUP BY workspace_id, g HAVING count(*) >= 2"""

QUERIES = {"p2_found": p2_found, "p2_clean_turns": p2_clean_turns, "p3_found": p3_found, "p3_languages": p3_languages, "p4_found": p4_found, "p4_defects": p4_defects, "p6_found": p6_found, "p7_containers": p7_containers, "p7_fill": p7_fill, "p8_found": p8_found, "p8_reparameterised": p8_reparameterised, "p9_found": p9_found, "p9_restored": p9_restored}
ORACLE = {"p6_found": P6_FOUND}


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLE)
