"""Signal queries over the events table, whose values stand for frame levels."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadenza.operators import signals
from cadenza.operators.segments import millis, usable_segments
from cadenza.plans.problems import USABLE
from cadenza.plans.registry import Registry
from cadenza.sources.tables import table

query = Registry()
QUERIES, ORACLE = query.queries, query.oracle
DAY = 86_400_000_000


def frames(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.col("value").alias("level"))
    return signals.numbered(e, "user_id", ["us", "event_id"], DAY)


FRAMES = "f AS (SELECT user_id, value AS level, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame FROM events)"


@query(
    f"""WITH {FRAMES}, a AS (SELECT f.user_id, f.level, n.level AS nxt, l.level AS later FROM f JOIN f n ON n.user_id = f.user_id AND n.frame = f.frame + 1 JOIN f l ON l.user_id = f.user_id AND l.frame = f.frame + 15)
    SELECT user_id, median(greatest(0.0, least(1.0, later / level))) AS reverb, count(*) AS n FROM a WHERE level >= 20 AND nxt < 20 GROUP BY user_id"""
)
def agg_reverb(spark, d):
    return signals.reverberation(frames(spark, d), "user_id", 20.0)


@query(
    """WITH p AS (SELECT user_id, max(value) AS p, count(*) AS s FROM events GROUP BY user_id), v AS (SELECT e.user_id, value, CASE WHEN value > 0.2 * p THEN 1.0 ELSE 0.0 END AS v, s FROM events e JOIN p USING (user_id)),
    d AS (SELECT user_id, sqrt(avg(value * value)) AS rms, avg(v) AS voiced_ratio, max(s) AS s FROM v GROUP BY user_id)
    SELECT user_id, rms, 20 * log10(rms) AS db, voiced_ratio, 1 - voiced_ratio AS pause_ratio, s / (voiced_ratio * 60.0) AS rate FROM d"""
)
def agg_delivery(spark, d):
    e = table(spark, d, "events").select("user_id", F.col("value").alias("level"))
    n = e.groupBy("user_id").agg(F.count(F.lit(1)).alias("syllables"))
    return signals.delivery(e.join(n, "user_id").withColumn("seconds", F.lit(60.0)), "user_id", "syllables", "seconds")


@query(
    f"""WITH {USABLE}, t AS (SELECT DISTINCT row_id, workspace_id, CAST(round(start_s * 1000) AS BIGINT) AS t FROM transcript_segment WHERE start_s IS NOT NULL),
    g AS (SELECT row_id, min(CASE WHEN t.t >= start_ms AND t.t < end_ms THEN 0.0 WHEN t.t < start_ms AND start_ms - t.t < 500 THEN 0.5 - 0.5 * cos((start_ms - t.t) / 500 * pi()) WHEN t.t >= end_ms AND t.t - end_ms < 500 THEN 0.5 - 0.5 * cos((t.t - end_ms) / 500 * pi()) ELSE 1.0 END) AS gain
      FROM t JOIN usable u ON u.workspace_id = t.workspace_id GROUP BY row_id)
    SELECT t.row_id, round(coalesce(gain, 1.0), 9) AS gain FROM t LEFT JOIN g USING (row_id)"""
)
def win_gate_envelope(spark, d):
    points = table(spark, d, "transcript_segment").where("start_s is not null").select("row_id", "workspace_id", millis(F.col("start_s")).alias("t")).distinct()
    speech = usable_segments(table(spark, d, "timeline_segment")).select("workspace_id", F.col("start_ms").alias("r_start"), F.col("end_ms").alias("r_end"))
    return signals.gate_envelope(points, speech, ["workspace_id"], "row_id", "t", 500).select("row_id", F.round("gain", 9).alias("gain"))


@query(
    """WITH p AS (SELECT user_id, CAST(floor(epoch_us(ts) / 3600000000) AS BIGINT) AS t, min(value) AS a, max(value) AS b FROM events GROUP BY ALL),
    s AS (SELECT DISTINCT user_id, CAST(floor(epoch_us(ts) / 3600000000) AS BIGINT) AS t FROM events WHERE event_type = 'purchase'),
    q AS (SELECT * FROM p WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.user_id = p.user_id AND p.t >= s.t AND p.t < s.t + 2))
    SELECT user_id, CASE WHEN count(*) >= 3 AND least(stddev_pop(a), stddev_pop(b)) >= 1e-9 THEN (covar_pop(a, b) / (stddev_pop(a) * stddev_pop(b)) + 1) / 2 END AS score, count(*) AS n FROM q GROUP BY user_id"""
)
def agg_ambience(spark, d):
    """The least and the greatest value of an hour stand for two signals, the two hours from a purchase for speech."""
    e = table(spark, d, "events").withColumn("t", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3_600_000_000).cast("bigint"))
    level = lambda f: e.groupBy("user_id", "t").agg(f("value").alias("level"))
    speech = e.where("event_type = 'purchase'").select("user_id", F.col("t").alias("r_start"), (F.col("t") + 2).alias("r_end")).distinct()
    return signals.ambience(level(F.min), level(F.max), speech, "user_id")


@query(
    """WITH e AS (SELECT user_id, value, CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) - 1704067200 AS s FROM events), w AS (SELECT user_id, value, unnest(generate_series(CAST(greatest(0, ceil((s - 7199) / 3600)) AS BIGINT), CAST(floor(s / 3600) AS BIGINT))) AS w FROM e)
    SELECT user_id, w AS "window", count(*) AS n, avg(value) AS mean FROM w GROUP BY ALL"""
)
def win_sliding_windows(spark, d):
    e = table(spark, d, "events").select("user_id", "value", (F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).cast("bigint") - 1_704_067_200).alias("s"))
    return signals.windows_over(e, "user_id", "s", 7200, 3600).groupBy("user_id", "window").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"))


@query("SELECT DISTINCT u.seg_uid, coalesce(p.duration_s, 0.0) AS seconds, coalesce(p.status, 'pending') AS status FROM (SELECT DISTINCT seg_uid, workspace_id FROM timeline_segment) u LEFT JOIN (SELECT workspace_id, arg_max(duration_s, (started_at, duration_s)) AS duration_s, arg_max(status, (started_at, duration_s)) AS status FROM stage_record WHERE stage_name = 'align' AND started_at IS NOT NULL AND duration_s IS NOT NULL AND status IS NOT NULL GROUP BY ALL) p USING (workspace_id)")
def join_merge_update(spark, d):
    rows = table(spark, d, "timeline_segment").select("seg_uid", "workspace_id").distinct()
    done = table(spark, d, "stage_record").where("stage_name = 'align' and started_at is not null and duration_s is not null and status is not null")
    last = done.groupBy("workspace_id").agg(F.max_by(F.struct("duration_s", "status"), F.struct("started_at", "duration_s")).alias("p"))
    return rows.join(last, "workspace_id", "left").select("seg_uid", F.coalesce("p.duration_s", F.lit(0.0)).alias("seconds"), F.coalesce("p.status", F.lit("pending")).alias("status"))
