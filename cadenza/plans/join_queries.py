"""Interval joins, lookups, semi and anti joins, diffs, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadenza.functions import arrays
from cadenza.operators import intervals, lineage, vectors
from cadenza.operators.segments import millis, usable_segments
from cadenza.operators.sequences import continuous_periods
from cadenza.plans.problems import USABLE
from cadenza.plans.registry import Registry
from cadenza.sources.tables import table

query = Registry()
QUERIES, ORACLE = query.queries, query.oracle

LINES = """lines AS (SELECT DISTINCT row_id, workspace_id, CAST(round(start_s * 1000) AS BIGINT) AS a, CAST(round(end_s * 1000) AS BIGINT) AS b FROM transcript_segment
  WHERE start_s IS NOT NULL AND end_s IS NOT NULL AND end_s > start_s)"""
W = ["workspace_id"]


def lines(spark, d):
    rows = table(spark, d, "transcript_segment").where("end_s > start_s")
    return rows.select("row_id", "workspace_id", millis(F.col("start_s")).alias("l_start"), millis(F.col("end_s")).alias("l_end")).distinct()


def turns(spark, d):
    return usable_segments(table(spark, d, "timeline_segment")).select("workspace_id", "speaker", F.col("seg_uid").alias("turn"), F.col("start_ms").alias("r_start"), F.col("end_ms").alias("r_end"))


@query(
    f"""WITH {USABLE}, {LINES}, m AS (SELECT row_id, speaker, least(b, end_ms) - greatest(a, start_ms) AS ov, row_number() OVER (PARTITION BY row_id ORDER BY least(b, end_ms) - greatest(a, start_ms) DESC, seg_uid) AS k
      FROM lines l JOIN usable u ON l.workspace_id = u.workspace_id AND a < end_ms AND start_ms < b)
    SELECT l.row_id, coalesce(speaker, 'speaker_unknown') AS speaker, coalesce(ov, 0) AS overlap FROM lines l LEFT JOIN m ON l.row_id = m.row_id AND k = 1"""
)
def join_max_overlap(spark, d):
    return intervals.max_overlap(lines(spark, d), turns(spark, d), W, "row_id", "speaker", "turn")


@query(
    f"""WITH {USABLE}, {LINES}, m AS (SELECT row_id, speaker, row_number() OVER (PARTITION BY row_id ORDER BY least(b, end_ms) - greatest(a, start_ms) DESC, seg_uid) AS k
      FROM lines l JOIN usable u ON l.workspace_id = u.workspace_id AND a < end_ms AND start_ms < b),
    n AS (SELECT row_id, speaker, row_number() OVER (PARTITION BY row_id ORDER BY CASE WHEN end_ms <= (a + b) // 2 THEN (a + b) // 2 - end_ms ELSE start_ms - (a + b) // 2 END, seg_uid) AS k
      FROM lines l JOIN usable u ON l.workspace_id = u.workspace_id WHERE row_id NOT IN (SELECT row_id FROM m))
    SELECT l.row_id, coalesce(m.speaker, n.speaker, 'speaker_unknown') AS speaker, m.speaker IS NOT NULL AS direct FROM lines l LEFT JOIN m ON l.row_id = m.row_id AND m.k = 1 LEFT JOIN n ON l.row_id = n.row_id AND n.k = 1"""
)
def join_overlap_else_nearest(spark, d):
    return intervals.overlap_else_nearest(lines(spark, d), turns(spark, d), W, "row_id", "speaker", "turn")


@query(
    f"""WITH {USABLE}, {LINES} SELECT l.row_id, coalesce(min_by(speaker, seg_uid), '-1') AS speaker FROM lines l LEFT JOIN usable u ON l.workspace_id = u.workspace_id AND (a + b) // 2 BETWEEN start_ms AND end_ms GROUP BY l.row_id"""
)
def join_point_in_interval(spark, d):
    points = lines(spark, d).select("row_id", "workspace_id", F.floor((F.col("l_start") + F.col("l_end")) / 2).cast("bigint").alias("at"))
    return intervals.containing(points, turns(spark, d), W, "row_id", "at", "speaker", "turn")


@query(
    f"""WITH {USABLE}, {LINES}, c AS (SELECT row_id, speaker, count(*) AS n FROM lines l JOIN usable u ON l.workspace_id = u.workspace_id AND (start_ms + end_ms) // 2 >= a AND (start_ms + end_ms) // 2 < b GROUP BY ALL),
    w AS (SELECT row_id, speaker, n, sum(n) OVER (PARTITION BY row_id) AS t, row_number() OVER (PARTITION BY row_id ORDER BY n DESC, speaker) AS k FROM c)
    SELECT l.row_id, coalesce(speaker, 'UNK') AS speaker, coalesce(n / t, 0.0) AS confidence, CAST(coalesce(t, 0) AS BIGINT) AS votes FROM lines l LEFT JOIN w ON l.row_id = w.row_id AND k = 1"""
)
def join_midpoint_vote(spark, d):
    return intervals.midpoint_vote(lines(spark, d), turns(spark, d), W, "row_id", "speaker")


@query(
    f"""WITH {USABLE}, {LINES}, m AS (SELECT seg_uid, max(least(b, end_ms) - greatest(a, start_ms)) AS ov FROM usable u JOIN lines l ON l.workspace_id = u.workspace_id AND a < end_ms AND start_ms < b GROUP BY ALL)
    SELECT u.workspace_id, count(*) AS n_original, count_if(coalesce(ov, 0) > 100) AS n_matched, count_if(coalesce(ov, 0) > 100) / count(*) AS occurrence FROM usable u LEFT JOIN m USING (seg_uid) GROUP BY ALL"""
)
def join_event_match(spark, d):
    t = turns(spark, d)
    left = t.select("workspace_id", F.col("turn").alias("event"), F.col("r_start").alias("l_start"), F.col("r_end").alias("l_end"))
    right = lines(spark, d).select("workspace_id", F.lit("x").alias("speaker"), F.col("row_id").alias("turn"), F.col("l_start").alias("r_start"), F.col("l_end").alias("r_end"))
    best = intervals.max_overlap(left, right, W, "event", "speaker", "turn")
    hit = F.count_if(F.col("overlap") > 100)
    return left.join(best, "event").groupBy("workspace_id").agg(F.count(F.lit(1)).alias("n_original"), hit.alias("n_matched"), (hit / F.count(F.lit(1))).alias("occurrence"))


LATEST = "latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY seg_uid ORDER BY ingested_at DESC, idx) AS k FROM timeline_segment) WHERE k = 1)"


def latest(spark, d, *cols):
    """The last delivery of each segment, as an aggregate."""
    rows = table(spark, d, "timeline_segment")
    return rows.groupBy("seg_uid").agg(F.max_by(F.struct(*cols), F.struct("ingested_at", -F.col("idx"))).alias("r")).select("seg_uid", "r.*")


@query(
    f"""WITH {LATEST}, t AS (SELECT DISTINCT workspace_id, idx, min(source_text) OVER (PARTITION BY workspace_id, idx) AS transcript FROM transcript_segment)
    SELECT l.seg_uid, printf('seg_%04d', l.idx + 1) AS seg_name, coalesce(t.transcript, l.source_text) AS source, t.transcript IS NOT NULL AS found, coalesce(l.timing.score < 0.6, false) AS low_confidence
    FROM latest l LEFT JOIN t ON l.workspace_id = t.workspace_id AND l.idx = t.idx"""
)
def join_positional(spark, d):
    left = latest(spark, d, "workspace_id", "idx", "source_text", "timing")
    right = table(spark, d, "transcript_segment").groupBy("workspace_id", "idx").agg(F.min("source_text").alias("transcript"))
    return left.join(right, ["workspace_id", "idx"], "left").select(
        "seg_uid", F.format_string("seg_%04d", F.col("idx") + 1).alias("seg_name"), F.coalesce("transcript", "source_text").alias("source"), F.col("transcript").isNotNull().alias("found"),
        F.coalesce(F.col("timing.score") < 0.6, F.lit(False)).alias("low_confidence"),
    )


@query(
    f"""WITH {LATEST}, m AS (SELECT (min(epoch_us(ingested_at)) + max(epoch_us(ingested_at))) // 2 AS mid FROM timeline_segment),
    old AS (SELECT DISTINCT render_key FROM timeline_segment, m WHERE epoch_us(ingested_at) <= mid AND render_key IS NOT NULL)
    SELECT l.seg_uid, o.render_key IS NOT NULL AS reused FROM latest l LEFT JOIN old o ON l.render_key = o.render_key"""
)
def join_reuse(spark, d):
    """Segments as last delivered whose rendering was there when half of the time of deliveries had passed."""
    at = F.unix_micros(F.col("ingested_at").cast("timestamp"))
    rows = table(spark, d, "timeline_segment")
    middle = rows.agg(F.floor((F.min(at) + F.max(at)) / 2).alias("mid"))  # one row
    then = rows.select("render_key", at.alias("at")).join(F.broadcast(middle), F.col("at") <= F.col("mid"))
    return lineage.reuse(latest(spark, d, "render_key"), then, "render_key").select("seg_uid", "reused")


@query(
    f"""WITH {USABLE}, p AS (SELECT workspace_id, speaker, min(profile_id) AS profile FROM speaker_profile GROUP BY ALL), f AS (SELECT workspace_id, min_by(profile, speaker) AS first_profile FROM p GROUP BY ALL)
    SELECT seg_uid, coalesce(p.profile, f.first_profile) AS profile, p.profile IS NOT NULL AS own FROM usable u LEFT JOIN p ON u.workspace_id = p.workspace_id AND u.speaker = p.speaker LEFT JOIN f ON u.workspace_id = f.workspace_id"""
)
def join_lookup_fallback(spark, d):
    p = table(spark, d, "speaker_profile").groupBy("workspace_id", "speaker").agg(F.min("profile_id").alias("profile"))
    first = p.groupBy("workspace_id").agg(F.min_by("profile", "speaker").alias("first_profile"))
    rows = usable_segments(table(spark, d, "timeline_segment")).join(p, ["workspace_id", "speaker"], "left").join(first, "workspace_id", "left")
    return rows.select("seg_uid", F.coalesce("profile", "first_profile").alias("profile"), F.col("profile").isNotNull().alias("own"))


@query(
    f"""WITH {USABLE}, p AS (SELECT DISTINCT workspace_id, speaker FROM speaker_profile)
    SELECT workspace_id, speaker, count(*) AS n FROM usable u WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.workspace_id = u.workspace_id AND p.speaker = u.speaker) GROUP BY ALL"""
)
def join_undeclared_speakers(spark, d):
    known = table(spark, d, "speaker_profile").select("workspace_id", "speaker").distinct()
    rows = usable_segments(table(spark, d, "timeline_segment")).join(known, ["workspace_id", "speaker"], "left_anti")
    return rows.groupBy("workspace_id", "speaker").agg(F.count(F.lit(1)).alias("n"))


@query(
    """WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), u AS (SELECT vec_id, label, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y*y)))) AS n FROM e)
    SELECT a.label, count(*) AS pairs, avg(list_sum(list_transform(list_zip(a.n, b.n), lambda p: p[1]*p[2]))) AS cohesion FROM u a JOIN u b ON a.label = b.label AND a.vec_id < b.vec_id GROUP BY a.label"""
)
def join_pair_cohesion(spark, d):
    return vectors.mean_pair_cosine(table(spark, d, "embeddings"), "label", "embedding")


@query(
    """WITH e AS (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) , m AS (SELECT label, i, avg(CAST(x AS DOUBLE)) AS x FROM e GROUP BY ALL)
    SELECT label, list(x ORDER BY i)[1:4] AS head, sqrt(sum(x * x)) AS length FROM m GROUP BY label"""
)
def agg_vector_mean(spark, d):
    c = vectors.centroids(table(spark, d, "embeddings"), "label", "embedding")
    return c.select("label", F.slice("centroid", 1, 4).alias("head"), arrays.norm(F.col("centroid")).alias("length"))


@query()
def join_gated_merge(spark, d):
    return vectors.gated_merge(table(spark, d, "embeddings"), "label", "embedding", least=60, limit=0.9)


@query()
def clu_select_k(spark, d):
    return vectors.select_k(table(spark, d, "embeddings"), "embedding", range(2, 9))


@query(
    f"""WITH {USABLE}, marked AS (SELECT *, max(end_ms) OVER (PARTITION BY workspace_id ORDER BY start_ms, end_ms, seg_uid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM usable)
    SELECT workspace_id, prev AS start_ms, start_ms AS end_ms FROM marked WHERE start_ms > prev"""
)
def join_speech_complement(spark, d):
    p = continuous_periods(usable_segments(table(spark, d, "timeline_segment")), ["workspace_id"], "start_ms", "end_ms")
    return p.where("prev_end is not null").select("workspace_id", F.col("prev_end").alias("start_ms"), F.col("start").alias("end_ms"))


@query(
    f"""WITH {USABLE}, f AS (SELECT DISTINCT workspace_id, CAST(round(end_s * 1000) AS BIGINT) AS t FROM transcript_segment WHERE end_s IS NOT NULL)
    SELECT workspace_id, t FROM f WHERE NOT EXISTS (SELECT 1 FROM usable u WHERE u.workspace_id = f.workspace_id AND f.t >= start_ms AND f.t < end_ms)"""
)
def join_frames_outside_speech(spark, d):
    frames = table(spark, d, "transcript_segment").where("end_s is not null").select("workspace_id", millis(F.col("end_s")).alias("t")).distinct()
    return intervals.frames_outside(frames, turns(spark, d), W)


@query(
    """WITH c AS (SELECT DISTINCT workspace_id, stage_name, config FROM stage_record WHERE config IS NOT NULL AND stage_name IN ('generate', 'align')),
    k AS (SELECT workspace_id, stage_name, unnest(map_keys(config)) AS key, unnest(map_values(config)) AS value FROM c), o AS (SELECT workspace_id, key, min(value) AS recorded FROM k WHERE stage_name = 'generate' GROUP BY ALL),
    n AS (SELECT workspace_id, key, min(value) AS current FROM k WHERE stage_name = 'align' GROUP BY ALL)
    SELECT coalesce(o.workspace_id, n.workspace_id) AS workspace_id, coalesce(o.key, n.key) AS key, recorded, current, current IS NOT NULL AND recorded IS DISTINCT FROM current AS changed, coalesce(current, recorded) AS effective
    FROM o FULL JOIN n ON o.workspace_id = n.workspace_id AND o.key = n.key"""
)
def join_config_diff(spark, d):
    rows = table(spark, d, "stage_record").where("config is not null")
    side = lambda stage, name: rows.where(F.col("stage_name") == stage).select("workspace_id", F.explode("config").alias("key", "value")).groupBy("workspace_id", "key").agg(F.min("value").alias(name))
    return lineage.config_diff(side("generate", "recorded"), side("align", "current"), ["workspace_id", "key"])


@query(
    """WITH s AS (SELECT DISTINCT workspace_id, stage_name, status FROM stage_record), o(stage_name, pos) AS (VALUES """
    + ", ".join(f"('{s}', {i})" for i, s in enumerate(lineage.STAGES))
    + """), bad AS (SELECT workspace_id, min(pos) AS p FROM s JOIN o USING (stage_name) WHERE status = 'failed' GROUP BY ALL)
    SELECT workspace_id, stage_name FROM bad JOIN o ON o.pos >= bad.p"""
)
def inc_stale_stages(spark, d):
    failed = table(spark, d, "stage_record").where("status = 'failed'").select("workspace_id", "stage_name").distinct()
    chain = [(a, b) for a, b in zip(lineage.STAGES, lineage.STAGES[1:], strict=False)]
    return lineage.stale_stages(failed, chain)


@query(
    """WITH s AS (SELECT DISTINCT workspace_id, stage_name, status FROM stage_record), o(stage_name, pos) AS (VALUES """
    + ", ".join(f"('{s}', {i})" for i, s in enumerate(lineage.STAGES))
    + """) SELECT workspace_id, min_by(stage_name, pos) AS first_failed FROM s JOIN o USING (stage_name) WHERE status = 'failed' GROUP BY ALL"""
)
def top_earliest_stage(spark, d):
    return lineage.earliest_stage(table(spark, d, "stage_record").where("status = 'failed'").select("workspace_id", "stage_name"), "workspace_id", "first_failed")
