"""Queries over records, settings, states and assembled timelines, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadenza.functions import text
from cadenza.operators import lineage, quality, records
from cadenza.operators.segments import millis, usable_segments
from cadenza.operators.sequences import continuous_periods, exact_quantiles
from cadenza.plans.join_queries import LATEST, LINES, latest, lines
from cadenza.plans.problems import USABLE
from cadenza.plans.registry import Registry
from cadenza.sources.tables import table

query = Registry()
QUERIES, ORACLE = query.queries, query.oracle
STAGE_ORDER = "o(stage_name, pos) AS (VALUES " + ", ".join(f"('{s}', {i})" for i, s in enumerate(lineage.STAGES)) + ")"


@query(
    """SELECT DISTINCT row_id, workspace_id, round(start_s, 3) AS start_s, round(end_s, 3) AS end_s FROM transcript_segment
    WHERE CAST(round((end_s - start_s) * 1000) AS BIGINT) >= 300 AND trim(source_text) <> ''"""
)
def fil_turns(spark, d):
    rows = table(spark, d, "transcript_segment").where(millis(F.col("end_s") - F.col("start_s")) >= 300).where(~text.is_blank(F.col("source_text")))
    return rows.select("row_id", "workspace_id", F.round("start_s", 3).alias("start_s"), F.round("end_s", 3).alias("end_s")).distinct()


@query(
    f"""WITH {LATEST} SELECT seg_uid, CASE WHEN coalesce(is_non_speech, false) OR target_text IS NULL OR trim(target_text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) = '' THEN target_text ELSE '> ' || target_text END AS target_text FROM latest"""
)
def fil_bypass(spark, d):
    rows = latest(spark, d, "target_text", "is_non_speech")
    return records.bypass(rows, F.col("is_non_speech") | text.is_blank(F.col("target_text")), "target_text", lambda c: F.concat(F.lit("> "), c)).select("seg_uid", "target_text")


@query(
    """WITH p AS (SELECT user_id, quantile_cont(value, 0.95) AS p95 FROM events GROUP BY user_id)
    SELECT user_id, avg(CASE WHEN value > 0.15 * p95 THEN 1.0 ELSE 0.0 END) AS voiced, count(*) AS frames FROM events JOIN p USING (user_id) WHERE value >= 1 GROUP BY user_id"""
)
def arr_voiced_share(spark, d):
    e = table(spark, d, "events").select("user_id", "value")
    top = exact_quantiles(e, ["user_id"], "value", {"p95": 0.95}, 1.0)
    loud = e.where("value >= 1").join(top, "user_id")
    return loud.groupBy("user_id").agg(F.avg((F.col("value") > 0.15 * F.col("p95")).cast("double")).alias("voiced"), F.count(F.lit(1)).alias("frames"))


@query(
    """WITH r AS (SELECT DISTINCT run_id, iteration, unnest(map_entries(parameters)) AS e FROM iteration_record),
    s AS (SELECT run_id, iteration, CASE split_part(e.key, '.', 1) WHEN 'omnivoice' THEN 'generate' ELSE split_part(e.key, '.', 1) END AS stage, split_part(e.key, '.', 2) AS name, e.value AS value FROM r WHERE e.key LIKE '%.%')
    SELECT run_id, iteration, stage, name, value FROM s"""
)
def prj_nested_settings(spark, d):
    rows = table(spark, d, "iteration_record").select("run_id", "iteration", F.explode(records.nested_settings(F.col("parameters"), {"omnivoice": "generate"})).alias("stage", "settings"))
    return rows.select("run_id", "iteration", "stage", F.explode("settings").alias("name", "value")).distinct()


@query(
    """WITH n(code, name) AS (VALUES """
    + ", ".join(f"('{k}', '{v}')" for k, v in records.LANGUAGE_NAMES.items())
    + """), c AS (SELECT DISTINCT target_lang FROM timeline_segment WHERE target_lang IS NOT NULL)
    SELECT target_lang, coalesce(a.name, b.name, target_lang) AS language FROM c LEFT JOIN n a ON a.code = lower(trim(target_lang)) LEFT JOIN n b ON b.code = regexp_extract(lower(trim(target_lang)), '^([^-_]*)', 1)"""
)
def prj_language_names(spark, d):
    codes = table(spark, d, "timeline_segment").where("target_lang is not null").select("target_lang").distinct()
    return codes.select("target_lang", records.language_name(F.col("target_lang")).alias("language"))


@query(
    f"""WITH {USABLE}, {LINES}, u AS (SELECT workspace_id, start_ms AS s, end_ms AS e, 1 AS speech FROM usable UNION ALL SELECT workspace_id, a, b, 0 FROM lines),
    m AS (SELECT *, max(e) OVER (PARTITION BY workspace_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM u),
    g AS (SELECT *, sum(CASE WHEN prev IS NULL OR s > prev THEN 1 ELSE 0 END) OVER (PARTITION BY workspace_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS r FROM m)
    SELECT workspace_id, min(s) AS "start", max(e) AS "end", count(*) AS n FROM g GROUP BY workspace_id, r"""
)
def set_union_of_spans(spark, d):
    speech = usable_segments(table(spark, d, "timeline_segment")).select("workspace_id", F.col("start_ms").alias("s"), F.col("end_ms").alias("e"))
    heard = lines(spark, d).select("workspace_id", F.col("l_start").alias("s"), F.col("l_end").alias("e"))
    return continuous_periods(speech.unionByName(heard), ["workspace_id"], "s", "e").select("workspace_id", "start", "end", "n")


@query(
    """WITH w AS (SELECT row_id, unnest(string_split(source_text, ' ')) AS word, generate_subscripts(string_split(source_text, ' '), 1) - 1 AS pos FROM (SELECT DISTINCT row_id, source_text FROM transcript_segment))
    SELECT lower(word) AS word, count(*) AS n, min(pos) AS first_pos FROM w WHERE word <> '' GROUP BY lower(word)"""
)
def set_flat_words(spark, d):
    rows = table(spark, d, "transcript_segment").groupBy("row_id").agg(F.min("source_text").alias("source_text"))
    words = rows.select(F.posexplode(F.split("source_text", " ")).alias("pos", "word")).where("word <> ''")
    return words.groupBy(F.lower("word").alias("word")).agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first_pos"))


@query(
    """WITH s AS (SELECT DISTINCT workspace_id, unnest(glossary_hits) AS term FROM timeline_segment) SELECT workspace_id, list(term ORDER BY term) AS terms FROM s GROUP BY workspace_id"""
)
def set_distinct_append(spark, d):
    rows = table(spark, d, "timeline_segment").select("workspace_id", F.explode("glossary_hits").alias("term")).distinct()
    return rows.groupBy("workspace_id").agg(F.array_sort(F.collect_list("term")).alias("terms"))  # terms of a glossary: distinct and few


@query(
    f"""WITH {LATEST}, h AS (SELECT workspace_id, split_part(language_pair, '->', 2) AS tgt FROM timeline)
    SELECT seg_uid, CASE WHEN target_lang IS NULL OR target_lang = '' THEN coalesce(tgt, target_lang) ELSE target_lang END AS target_lang FROM latest LEFT JOIN h USING (workspace_id)"""
)
def inc_hydrated(spark, d):
    header = table(spark, d, "timeline").select("workspace_id", F.split_part("language_pair", F.lit("->"), F.lit(2)).alias("target_lang"))
    return records.hydrated(latest(spark, d, "workspace_id", "target_lang"), header, ["workspace_id"], {"target_lang": ""}).select("seg_uid", "target_lang")


@query(
    f"""WITH {STAGE_ORDER}, l AS (SELECT workspace_id, stage_name, arg_max(status, (coalesce(started_at, ''), status)) AS status FROM stage_record WHERE status IS NOT NULL GROUP BY ALL),
    w AS (SELECT DISTINCT workspace_id FROM l), n AS (SELECT workspace_id, o.stage_name, pos FROM w CROSS JOIN o WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.workspace_id = w.workspace_id AND l.stage_name = o.stage_name AND status = 'done'))
    SELECT w.workspace_id, (SELECT min_by(n.stage_name, pos) FROM n WHERE n.workspace_id = w.workspace_id) AS stage_name FROM w"""
)
def inc_resume_points(spark, d):
    rows = table(spark, d, "stage_record").where("status is not null").withColumn("started_at", F.coalesce("started_at", F.lit("")))
    return records.resume_points(records.last_states(rows, ["workspace_id", "stage_name"], "started_at", "status"), "workspace_id")


@query(
    f"""WITH {STAGE_ORDER}, c AS (SELECT DISTINCT workspace_id, stage_name, started_at, unnest(map_entries(config)) AS e FROM stage_record WHERE started_at IS NOT NULL AND len(map_keys(config)) > 0),
    b AS (SELECT workspace_id, stage_name, min(started_at) AS first_at, max(started_at) AS last_at FROM c GROUP BY ALL HAVING min(started_at) < max(started_at)),
    k AS (SELECT c.workspace_id, c.stage_name, c.e.key AS key, min(CASE WHEN started_at = first_at THEN c.e.value END) AS recorded, min(CASE WHEN started_at = last_at THEN c.e.value END) AS current FROM c JOIN b USING (workspace_id, stage_name) GROUP BY ALL),
    s AS (SELECT workspace_id, min(pos) AS p FROM k JOIN o USING (stage_name) WHERE current IS NOT NULL AND recorded IS DISTINCT FROM current GROUP BY ALL)
    SELECT workspace_id, stage_name FROM s JOIN o ON o.pos >= s.p"""
)
def inc_stale_after_config(spark, d):
    """Stages to run again because the settings of a stage, or of one before it, are not those of its first run."""
    rows = table(spark, d, "stage_record").where("started_at is not null and size(config) > 0").select("workspace_id", "stage_name", "started_at", F.explode("config").alias("key", "value"))
    ends = rows.groupBy("workspace_id", "stage_name").agg(F.min("started_at").alias("first_at"), F.max("started_at").alias("last_at")).where("first_at < last_at")
    told = rows.join(ends, ["workspace_id", "stage_name"])
    side = lambda at, name: told.where(F.col("started_at") == F.col(at)).groupBy("workspace_id", "stage_name", "key").agg(F.min("value").alias(name))
    diff = lineage.config_diff(side("first_at", "recorded"), side("last_at", "current"), ["workspace_id", "stage_name", "key"])
    seeds = diff.where("changed").select("workspace_id", "stage_name").distinct()
    return lineage.stale_stages(seeds, list(zip(lineage.STAGES, lineage.STAGES[1:], strict=False)))


@query(
    f"""WITH {LATEST}, t AS (SELECT workspace_id, idx, min(source_text) AS transcript FROM transcript_segment GROUP BY ALL), h AS (SELECT workspace_id, language_pair FROM timeline),
    a AS (SELECT workspace_id, arg_max(duration_s, (started_at, duration_s)) AS aligned_s FROM stage_record WHERE stage_name = 'align' AND started_at IS NOT NULL AND duration_s IS NOT NULL GROUP BY ALL),
    g AS (SELECT workspace_id, arg_max(duration_s, (started_at, duration_s)) AS generated_s FROM stage_record WHERE stage_name = 'generate' AND started_at IS NOT NULL AND duration_s IS NOT NULL GROUP BY ALL)
    SELECT l.seg_uid, coalesce(h.language_pair, l.language_pair) AS language_pair, coalesce(t.transcript, l.source_text) AS source, coalesce(l.target_text, '') AS target, coalesce(aligned_s, generated_s) AS stage_s,
      CASE WHEN aligned_s IS NOT NULL THEN 'aligned' WHEN generated_s IS NOT NULL THEN 'generated' ELSE 'pending' END AS state, coalesce(l.timing.score < 0.6, false) AS low_confidence
    FROM latest l LEFT JOIN t ON l.workspace_id = t.workspace_id AND l.idx = t.idx LEFT JOIN h ON l.workspace_id = h.workspace_id LEFT JOIN a ON l.workspace_id = a.workspace_id LEFT JOIN g ON l.workspace_id = g.workspace_id"""
)
def join_timeline(spark, d):
    """A timeline put together from segments, transcript, header and the records of two stages, of which the later one counts."""
    transcript = table(spark, d, "transcript_segment").groupBy("workspace_id", "idx").agg(F.min("source_text").alias("transcript"))
    header = table(spark, d, "timeline").select("workspace_id", F.col("language_pair").alias("header_pair"))
    ran = table(spark, d, "stage_record").where("started_at is not null and duration_s is not null")
    took = lambda stage, name: ran.where(F.col("stage_name") == stage).groupBy("workspace_id").agg(F.max_by("duration_s", F.struct("started_at", "duration_s")).alias(name))
    rows = latest(spark, d, "workspace_id", "idx", "language_pair", "source_text", "target_text", "timing").join(transcript, ["workspace_id", "idx"], "left")
    rows = rows.join(header, "workspace_id", "left").join(took("align", "aligned_s"), "workspace_id", "left").join(took("generate", "generated_s"), "workspace_id", "left")
    state = F.when(F.col("aligned_s").isNotNull(), "aligned").when(F.col("generated_s").isNotNull(), "generated").otherwise("pending")
    return rows.select(
        "seg_uid", F.coalesce("header_pair", "language_pair").alias("language_pair"), F.coalesce("transcript", "source_text").alias("source"), F.coalesce("target_text", F.lit("")).alias("target"),
        F.coalesce("aligned_s", "generated_s").alias("stage_s"), state.alias("state"), F.coalesce(F.col("timing.score") < 0.6, F.lit(False)).alias("low_confidence"),
    )


def _keys_sql(kind: str, keys: list[str]) -> str:
    return f"""SELECT record_id, 'error' AS severity, '$' AS path FROM p WHERE kind = '{kind}' AND k IS NULL
    UNION ALL SELECT record_id, 'error', '$.' || name FROM (SELECT record_id, k, unnest({keys}) AS name FROM p WHERE kind = '{kind}' AND k IS NOT NULL) WHERE NOT list_contains(k, name)"""


@query(
    f"""WITH p AS (SELECT record_id, kind, payload, CASE WHEN json_valid(payload) AND json_type(payload) = 'OBJECT' THEN json_keys(payload) END AS k FROM raw_record),
    i AS ({_keys_sql("manifest", ["workspace_id", "stages", "schema_version"])} UNION ALL {_keys_sql("history", ["iteration", "parameters", "metrics"])}
      UNION ALL SELECT record_id, 'warning', '$.schema_version' FROM p WHERE kind = 'manifest' AND k IS NOT NULL AND json_type(payload, '$.schema_version') IN ('UBIGINT', 'BIGINT') AND CAST(json_extract(payload, '$.schema_version') AS BIGINT) < 2)
    SELECT severity, path, count(*) AS n, count(DISTINCT record_id) AS records FROM i GROUP BY ALL"""
)
def dq_documents(spark, d):
    """The issues of all documents together: keys of manifests and of history lines, versions of manifests."""
    raw = table(spark, d, "raw_record")
    keys = lambda kind, names: quality.key_issues(raw.where(F.col("kind") == kind), ["record_id"], "payload", names)
    version = F.get_json_object("payload", "$.schema_version")
    number = F.col("payload").rlike(r'"schema_version"\s*:\s*-?\d+\s*[,}]')
    old = quality.issues(raw.where("kind = 'manifest'").where(F.json_object_keys("payload").isNotNull()), ["record_id"], [quality.Rule("warning", "$.schema_version", "version is old", number & (version.try_cast("bigint") < 2))])
    found = keys("manifest", ["workspace_id", "stages", "schema_version"]).unionByName(keys("history", ["iteration", "parameters", "metrics"])).unionByName(old)
    return found.groupBy("severity", "path").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("record_id").alias("records"))
