"""Window, sequence, ranking, aggregate and quality queries with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cadenza.functions import scores
from cadenza.operators import quality, utterances
from cadenza.operators.segments import millis, usable_segments
from cadenza.operators.sequences import chunked_runs, continuous_periods, evenly_spaced, exact_quantiles, ordered_rank, running_max, with_previous
from cadenza.plans.join_queries import LATEST, latest
from cadenza.plans.problems import USABLE
from cadenza.plans.registry import Registry
from cadenza.sources.tables import table

query = Registry()
QUERIES, ORACLE = query.queries, query.oracle
BUCKET = 900_000
ORDER = ["start_ms", "idx", "seg_uid"]


def usable(spark, d):
    return usable_segments(table(spark, d, "timeline_segment"))


@query(f"WITH {USABLE} SELECT seg_uid, start_ms - lag(end_ms) OVER (PARTITION BY workspace_id ORDER BY start_ms, idx, seg_uid) AS gap_ms FROM usable")
def win_gaps(spark, d):
    rows = with_previous(usable(spark, d), ["workspace_id"], ORDER, ["end_ms"], BUCKET)
    return rows.select("seg_uid", (F.col("start_ms") - F.col("previous.end_ms")).alias("gap_ms"))


@query(
    f"""WITH {USABLE}, m AS (SELECT *, coalesce(speaker = lag(speaker) OVER w, false) AS same FROM usable WINDOW w AS (PARTITION BY workspace_id ORDER BY start_ms, idx, seg_uid)),
    g AS (SELECT *, sum(CASE WHEN same THEN 0 ELSE 1 END) OVER (PARTITION BY workspace_id ORDER BY start_ms, idx, seg_uid ROWS UNBOUNDED PRECEDING) AS r FROM m)
    SELECT workspace_id, min(speaker) AS speaker, count(*) AS n, min(start_ms) AS start_ms, max(end_ms) AS end_ms FROM g GROUP BY workspace_id, r"""
)
def win_speaker_runs(spark, d):
    rows = chunked_runs(usable(spark, d), ["workspace_id"], ORDER, ["speaker"], lambda p, c: p["speaker"] == c["speaker"], BUCKET)
    return rows.groupBy("workspace_id", "run").agg(F.min("speaker").alias("speaker"), F.count(F.lit(1)).alias("n"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms")).drop("run")


@query(
    f"""WITH {USABLE}, m AS (SELECT *, coalesce(start_ms - lag(end_ms) OVER w <= 800, false) AS same FROM usable WINDOW w AS (PARTITION BY workspace_id ORDER BY start_ms, idx, seg_uid)),
    g AS (SELECT *, sum(CASE WHEN same THEN 0 ELSE 1 END) OVER (PARTITION BY workspace_id ORDER BY start_ms, idx, seg_uid ROWS UNBOUNDED PRECEDING) AS r FROM m)
    SELECT workspace_id, count(*) AS n, min(start_ms) AS start_ms, max(end_ms) AS end_ms FROM g GROUP BY workspace_id, r"""
)
def win_sessions(spark, d):
    rows = chunked_runs(usable(spark, d), ["workspace_id"], ORDER, ["end_ms"], lambda p, c: c["start_ms"] - p["end_ms"] <= 800, BUCKET)
    return rows.groupBy("workspace_id", "run").agg(F.count(F.lit(1)).alias("n"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms")).drop("run")


@query()
def win_utterances(spark, d):
    rows = table(spark, d, "transcript_segment").select("workspace_id", "row_id", millis(F.col("start_s")).alias("start"), millis(F.col("end_s")).alias("end"), F.col("source_text").alias("text"))
    return utterances.utterances(rows, "workspace_id")


@query(
    """WITH p AS (SELECT quantile_cont(value, 0.95) AS p95 FROM events), f AS (SELECT user_id, ts, event_id, value, value > 0.3 * p95 AS loud FROM events, p),
    m AS (SELECT *, coalesce(loud = lag(loud) OVER w, false) AS same FROM f WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    g AS (SELECT *, sum(CASE WHEN same THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS r FROM m)
    SELECT user_id, count(*) AS frames, min(event_id) AS first_event, least(1.0, avg(value) / max(p95)) AS intensity FROM g, p WHERE loud GROUP BY user_id, r HAVING count(*) >= 2"""
)
def win_threshold_islands(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), "value")
    level = exact_quantiles(e, [], "value", {"p95": 0.95}, 1.0).first()  # one row
    rows = e.withColumn("p95", F.lit(level.p95 if level else None).cast("double")).withColumn("loud", F.col("value") > 0.3 * F.col("p95"))
    runs = chunked_runs(rows, ["user_id"], ["t", "event_id"], ["loud"], lambda p, c: p["loud"] == c["loud"], 86_400_000_000)
    found = runs.where("loud").groupBy("user_id", "run").agg(F.count(F.lit(1)).alias("frames"), F.min("event_id").alias("first_event"), F.least(F.lit(1.0), F.avg("value") / F.max("p95")).alias("intensity"))
    return found.where("frames >= 2").drop("run")


@query(
    f"""WITH {USABLE}, f AS (SELECT workspace_id, speaker, min(start_ms * 100000000 + idx) AS first FROM usable GROUP BY ALL)
    SELECT workspace_id, speaker, dense_rank() OVER (PARTITION BY workspace_id ORDER BY first) AS number FROM f"""
)
def win_first_appearance(spark, d):
    first = usable(spark, d).groupBy("workspace_id", "speaker").agg(F.min(F.col("start_ms") * 100000000 + F.col("idx")).alias("first"))
    return first.select("workspace_id", "speaker", F.dense_rank().over(Window.partitionBy("workspace_id").orderBy("first")).alias("number"))


@query(
    f"""WITH {USABLE}, m AS (SELECT *, max(end_ms) OVER (PARTITION BY workspace_id, speaker ORDER BY start_ms, end_ms, seg_uid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM usable),
    g AS (SELECT *, sum(CASE WHEN prev IS NULL OR start_ms > prev + 300 THEN 1 ELSE 0 END) OVER (PARTITION BY workspace_id, speaker ORDER BY start_ms, end_ms, seg_uid ROWS UNBOUNDED PRECEDING) AS r FROM m)
    SELECT workspace_id, speaker, min(start_ms) AS start_ms, max(end_ms) AS end_ms, count(*) AS n FROM g GROUP BY workspace_id, speaker, r"""
)
def win_bridge_gaps(spark, d):
    rows = usable(spark, d).withColumn("reach", F.col("end_ms") + 300)
    p = continuous_periods(rows, ["workspace_id", "speaker"], "start_ms", "reach", BUCKET)
    return p.select("workspace_id", "speaker", F.col("start").alias("start_ms"), (F.col("end") - 300).alias("end_ms"), "n")


@query(
    """WITH r AS (SELECT DISTINCT run_id, iteration, max(score) OVER (PARTITION BY run_id, iteration) AS score FROM iteration_record),
    b AS (SELECT *, max(score) OVER (PARTITION BY run_id ORDER BY iteration ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM r),
    i AS (SELECT *, coalesce(score > before, score IS NOT NULL) AS better FROM b), l AS (SELECT *, max(CASE WHEN better THEN iteration END) OVER (PARTITION BY run_id ORDER BY iteration ROWS UNBOUNDED PRECEDING) AS last FROM i)
    SELECT run_id, iteration, greatest(before, score) AS best_so_far, better, iteration - last AS stale_for FROM l"""
)
def win_running_best(spark, d):
    rows = table(spark, d, "iteration_record").groupBy("run_id", "iteration").agg(F.max("score").alias("score"))
    rows = running_max(rows, ["run_id"], ["iteration"], F.col("score"), "before", 10_000, included=False)
    rows = rows.withColumn("better", F.coalesce(F.col("score") > F.col("before"), F.col("score").isNotNull()))
    rows = running_max(rows, ["run_id"], ["iteration"], F.when(F.col("better"), F.col("iteration")), "last", 10_000)
    return rows.select("run_id", "iteration", F.greatest("before", "score").alias("best_so_far"), "better", (F.col("iteration") - F.col("last")).alias("stale_for"))


@query(
    """WITH r AS (SELECT DISTINCT run_id, iteration, max(score) OVER (PARTITION BY run_id, iteration) AS score, max(status = 'failed') OVER (PARTITION BY run_id, iteration) AS failed FROM iteration_record)
    SELECT run_id, count(*) AS n, count(score) AS n_ok, count_if(score IS NULL) AS n_failed, arg_min(iteration, (-score, iteration)) FILTER (WHERE score IS NOT NULL) AS best_iteration, max(score) AS best_score, coalesce(max(iteration), -1) + 1 AS next_iteration FROM r GROUP BY run_id"""
)
def agg_history_summary(spark, d):
    rows = table(spark, d, "iteration_record").groupBy("run_id", "iteration").agg(F.max("score").alias("score"))
    best = F.min_by("iteration", F.when(F.col("score").isNotNull(), F.struct(-F.col("score"), F.col("iteration"))))
    return rows.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("n"), F.count("score").alias("n_ok"), F.count_if(F.col("score").isNull()).alias("n_failed"), best.alias("best_iteration"), F.max("score").alias("best_score"),
        (F.coalesce(F.max("iteration"), F.lit(-1)) + 1).alias("next_iteration"),
    )


@query(
    f"""WITH {USABLE}, s AS (SELECT workspace_id, speaker, end_ms - start_ms AS dur, start_ms FROM usable), r AS (SELECT workspace_id, speaker, sum(dur) AS dur, count(*) AS n, min(start_ms) AS first_ms, max(start_ms + dur) AS last_ms FROM s GROUP BY ALL),
    b AS (SELECT workspace_id, arg_min(speaker, (-dur, speaker)) AS main FROM r GROUP BY ALL)
    SELECT r.*, CASE WHEN dur < 20000 OR n < 8 THEN main ELSE speaker END AS merged FROM r JOIN b USING (workspace_id)"""
)
def agg_merge_tiny_speakers(spark, d):
    dur = F.col("end_ms") - F.col("start_ms")
    r = usable(spark, d).groupBy("workspace_id", "speaker").agg(F.sum(dur).alias("dur"), F.count(F.lit(1)).alias("n"), F.min("start_ms").alias("first_ms"), F.max("end_ms").alias("last_ms"))
    main = r.groupBy("workspace_id").agg(F.min_by("speaker", F.struct(-F.col("dur"), "speaker")).alias("main"))
    return r.join(main, "workspace_id").withColumn("merged", F.when((F.col("dur") < 20000) | (F.col("n") < 8), F.col("main")).otherwise(F.col("speaker"))).drop("main")


@query(
    f"""WITH {LATEST}, s AS (SELECT workspace_id, speaker, idx, seg_uid, CAST(round(start_s * 1000) AS BIGINT) AS a, timing.slot_duration_s AS slot, timing.estimated_duration_s AS est FROM latest WHERE timing IS NOT NULL AND timing.slot_duration_s > 0 AND timing.estimated_duration_s IS NOT NULL AND start_s IS NOT NULL),
    n AS (SELECT *, lead(a) OVER (PARTITION BY workspace_id ORDER BY a, idx, seg_uid) - a - CAST(round(est * 1000) AS BIGINT) AS gap FROM s),
    m AS (SELECT workspace_id, avg(greatest(0.0, least(1.0, 1 - (abs(est - slot) / slot) / 0.5))) AS timing_accuracy, avg(1 - greatest(0.0, least(1.0, (greatest(0.0, est - slot) / slot) / 0.3))) AS slot_fit, count_if(est > slot * 1.05) AS n_overrunning,
      1 - greatest(0.0, least(1.0, avg(CASE WHEN gap < 0 THEN least(1.0, (-gap / 1000) / greatest(0.2, est)) WHEN gap IS NOT NULL THEN 0.0 END) / 0.2)) AS continuity, count_if(coalesce(gap, 0) < 0) AS n_collisions,
      CASE WHEN count(*) >= 3 AND stddev_pop(est) >= 1e-9 AND stddev_pop(slot) >= 1e-9 THEN (covar_pop(est, slot) / (stddev_pop(est) * stddev_pop(slot)) + 1) / 2 END AS prosodic_similarity FROM n GROUP BY workspace_id)
    SELECT *, (0.15 * timing_accuracy + 0.10 * slot_fit + coalesce(0.10 * continuity, 0) + coalesce(0.09 * prosodic_similarity, 0)) / (0.25 + CASE WHEN continuity IS NULL THEN 0 ELSE 0.10 END + CASE WHEN prosodic_similarity IS NULL THEN 0 ELSE 0.09 END) AS composite FROM m"""
)
def agg_workspace_metrics(spark, d):
    rows = latest(spark, d, "workspace_id", "speaker", "idx", "start_s", "timing").where("timing.slot_duration_s > 0 and timing.estimated_duration_s is not null and start_s is not null")
    rows = rows.select("seg_uid", "workspace_id", "idx", millis(F.col("start_s")).alias("a"), F.col("timing.slot_duration_s").alias("slot"), F.col("timing.estimated_duration_s").alias("est"))
    rows = with_previous(rows, ["workspace_id"], ["a", "idx", "seg_uid"], ["est"], BUCKET)  # the pair (before, this one) belongs to the one before
    gap = F.col("a") - F.col("previous.a") - F.round(F.col("previous.est") * 1000).cast("bigint")
    over = F.when(gap < 0, F.least(F.lit(1.0), (-gap / 1000) / F.greatest(F.lit(0.2), F.col("previous.est")))).when(gap.isNotNull(), 0.0)
    est, slot = F.col("est"), F.col("slot")
    spread = F.stddev_pop(est) * F.stddev_pop(slot)
    m = rows.groupBy("workspace_id").agg(
        F.avg(scores.clamp(1 - (F.abs(est - slot) / slot) / 0.5)).alias("timing_accuracy"), F.avg(1 - scores.clamp((F.greatest(F.lit(0.0), est - slot) / slot) / 0.3)).alias("slot_fit"),
        F.count_if(est > slot * 1.05).alias("n_overrunning"), F.avg(over).alias("_o"), F.count_if(gap < 0).alias("n_collisions"), F.count(F.lit(1)).alias("_n"),
        F.try_divide(F.covar_pop(est, slot), spread).alias("_r"), F.stddev_pop(est).alias("_e"), F.stddev_pop(slot).alias("_s"),
    )
    m = m.withColumn("continuity", 1 - scores.clamp(F.col("_o") / 0.2))
    m = m.withColumn("prosodic_similarity", F.when((F.col("_n") >= 3) & (F.col("_e") >= 1e-9) & (F.col("_s") >= 1e-9), (F.col("_r") + 1) / 2))
    names = ["timing_accuracy", "slot_fit", "continuity", "prosodic_similarity"]
    return m.withColumn("composite", scores.weighted_mean({n: scores.METRIC_WEIGHTS[n] for n in names})).select("workspace_id", "timing_accuracy", "slot_fit", "n_overrunning", "continuity", "n_collisions", "prosodic_similarity", "composite")


@query(
    f"""WITH {LATEST}, s AS (SELECT seg_uid, workspace_id, speaker, timing.estimated_duration_s AS est FROM latest WHERE timing.estimated_duration_s > 0), m AS (SELECT workspace_id, speaker, median(est) AS mid FROM s GROUP BY ALL)
    SELECT seg_uid, mid, greatest(0.85, least(1.15, est / mid)) AS speed FROM s JOIN m ON s.workspace_id = m.workspace_id AND s.speaker IS NOT DISTINCT FROM m.speaker"""
)
def win_ratio_to_median(spark, d):
    s = latest(spark, d, "workspace_id", "speaker", "timing").where("timing.estimated_duration_s > 0").select("seg_uid", "workspace_id", "speaker", F.col("timing.estimated_duration_s").alias("est"))
    m = exact_quantiles(s, ["workspace_id", "speaker"], "est", {"mid": 0.5}, 0.5).withColumnsRenamed({"workspace_id": "w", "speaker": "p"})
    joined = s.join(m, F.col("workspace_id").eqNullSafe(F.col("w")) & F.col("speaker").eqNullSafe(F.col("p")))
    return joined.select("seg_uid", "mid", scores.relative(F.col("est"), F.col("mid"), 0.85, 1.15).alias("speed"))


@query("SELECT event_type, quantile_cont(value, 0.95) AS p95, quantile_cont(value, 0.1) AS p10, median(value) AS mid, count(DISTINCT user_id) AS users FROM events GROUP BY event_type")
def agg_percentiles(spark, d):
    e = table(spark, d, "events")
    users = e.groupBy("event_type").agg(F.countDistinct("user_id").alias("users"))
    return exact_quantiles(e, ["event_type"], "value", {"p95": 0.95, "p10": 0.1, "mid": 0.5}, 1.0).join(users, "event_type")


@query(
    f"""WITH {LATEST} SELECT workspace_id, count(*) AS segments, count_if(render_key IS NOT NULL) AS generated, count_if(timing.score < 0.6) AS flagged, avg(timing.score) AS mean_score, max(coalesce(end_s, start_s, 0)) + 0.5 AS extent, count(DISTINCT lower(trim(speaker))) AS speakers FROM latest GROUP BY workspace_id"""
)
def agg_timeline_summary(spark, d):
    rows = latest(spark, d, "workspace_id", "render_key", "timing", "start_s", "end_s", "speaker")
    return rows.groupBy("workspace_id").agg(
        F.count(F.lit(1)).alias("segments"), F.count("render_key").alias("generated"), F.count_if(F.col("timing.score") < 0.6).alias("flagged"), F.avg("timing.score").alias("mean_score"),
        (F.max(F.coalesce("end_s", "start_s", F.lit(0.0))) + 0.5).alias("extent"), F.countDistinct(F.lower(F.trim("speaker"))).alias("speakers"),
    )


@query(
    """WITH x AS (SELECT user_id, ts, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events),
    f AS (SELECT user_id, unnest(generate_series(CAST(greatest(0, ceil((i - 24) / 10)) AS BIGINT), CAST(least(floor(i / 10), greatest(0, floor((n - 25) / 10))) AS BIGINT))) AS frame, value FROM x)
    SELECT user_id, frame, sqrt(avg(value * value)) AS rms, count(*) AS n FROM f GROUP BY ALL"""
)
def win_frame_rms(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), "value")
    x = ordered_rank(e, ["user_id"], ["t", "event_id"], 86_400_000_000, "i", "n")
    last = F.greatest(F.lit(0), F.floor((F.col("n") - 25) / 10))
    low, high = F.greatest(F.lit(0), F.ceil((F.col("i") - 24) / 10)), F.least(F.floor(F.col("i") / 10), last)
    frames = x.where(low <= high).select("user_id", F.explode(F.sequence(low.cast("bigint"), high.cast("bigint"))).alias("frame"), "value")
    return frames.groupBy("user_id", "frame").agg(F.sqrt(F.avg(F.col("value") * F.col("value"))).alias("rms"), F.count(F.lit(1)).alias("n"))


@query("SELECT event_type, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS pos, greatest(-1000.0, least(1000.0, sum(value))) AS mixed FROM events GROUP BY ALL")
def agg_overlay(spark, d):
    e = table(spark, d, "events").withColumn("pos", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3_600_000_000).cast("bigint"))
    return e.groupBy("event_type", "pos").agg(scores.clamp(F.sum("value"), -1000.0, 1000.0).alias("mixed"))


@query(
    """WITH c AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS k FROM events) SELECT user_id, event_id, value, k FROM c WHERE k <= 5"""
)
def top_chunks(spark, d):
    w = Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id")
    return table(spark, d, "events").select("user_id", "event_id", "value", F.row_number().over(w).alias("k")).where("k <= 5")


@query()
def top_greedy_fill(spark, d):
    p = table(spark, d, "speaker_profile").where("score is not null and reference_duration is not null")
    ranked = p.groupBy("workspace_id").agg(F.array_sort(F.collect_set(F.struct((-F.col("score")).alias("o"), "speaker", "profile_id", "reference_duration"))).alias("c"))
    start = F.struct(F.lit(0.0).alias("total"), F.array().cast("array<string>").alias("taken"))

    def step(acc, c):
        grown = acc["total"] + c["reference_duration"]
        take = (acc["total"] < 30.0) & ((F.size(acc["taken"]) == 0) | (grown <= 45.0))
        return F.when(take, F.struct(grown.alias("total"), F.concat(acc["taken"], F.array(F.concat_ws("/", c["speaker"], c["profile_id"]))).alias("taken"))).otherwise(acc)

    return ranked.select("workspace_id", F.aggregate("c", start, step).alias("a")).select("workspace_id", "a.total", "a.taken")


@query(
    """WITH r AS (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events)
    SELECT event_type, event_id FROM r WHERE n <= 20 OR (floor(ceil(i * 19 / (n - 1)) * (n - 1) / 19) = i AND ceil(i * 19 / (n - 1)) < 20)"""
)
def top_stratified_sample(spark, d):
    e = table(spark, d, "events").select("event_type", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    return evenly_spaced(e, ["event_type"], ["t", "event_id"], 20, 86_400_000_000).select("event_type", "event_id")


@query(
    f"""WITH {LATEST}, r AS (SELECT seg_uid, unnest([CASE WHEN start_s IS NULL THEN 'error:start is missing' END, CASE WHEN end_s IS NULL THEN 'error:end is missing' END, CASE WHEN end_s <= start_s THEN 'error:end is not after start' END,
      CASE WHEN speaker IS NULL OR trim(speaker) = '' THEN 'error:speaker is missing' END, CASE WHEN source_text IS NULL THEN 'warning:no source text' END, CASE WHEN target_text IS NULL THEN 'warning:no target text' END]) AS i FROM latest)
    SELECT seg_uid, split_part(i, ':', 1) AS severity, split_part(i, ':', 2) AS message FROM r WHERE i IS NOT NULL"""
)
def dq_segments(spark, d):
    rows = latest(spark, d, "start_s", "end_s", "speaker", "source_text", "target_text")
    return quality.issues(rows, ["seg_uid"], quality.segment_rules()).select("seg_uid", "severity", "message")


@query(
    """WITH p AS (SELECT DISTINCT workspace_id, speaker, profile_id, score, reference_duration FROM speaker_profile)
    SELECT 'error' AS severity, count_if(score IS NULL) + count_if(reference_duration < 3) AS n FROM p HAVING count_if(score IS NULL) + count_if(reference_duration < 3) > 0 UNION ALL SELECT 'warning', count_if(reference_duration > 15) FROM p HAVING count_if(reference_duration > 15) > 0"""
)
def dq_profile_severity(spark, d):
    rows = table(spark, d, "speaker_profile").select("workspace_id", "speaker", "profile_id", "score", "reference_duration").distinct()
    return quality.by_severity(quality.issues(rows, ["workspace_id", "speaker", "profile_id"], quality.profile_rules()))


@query(
    """WITH p AS (SELECT record_id, CASE WHEN json_valid(payload) AND json_type(payload) = 'OBJECT' THEN json_keys(payload) END AS k FROM raw_record WHERE kind = 'timeline'),
    q AS (SELECT record_id, k, unnest(['schema_version', 'language_pair', 'workspace_id', 'segments']) AS name FROM p WHERE k IS NOT NULL)
    SELECT record_id, 'error' AS severity, '$' AS path, 'expected object' AS message FROM p WHERE k IS NULL
    UNION ALL SELECT record_id, 'error', '$.' || name, 'missing required key ' || name FROM q WHERE NOT list_contains(k, name)"""
)
def dq_required_keys(spark, d):
    rows = table(spark, d, "raw_record").where("kind = 'timeline'")
    return quality.key_issues(rows, ["record_id"], "payload", ["schema_version", "language_pair", "workspace_id", "segments"])


@query(
    """WITH s AS (SELECT DISTINCT workspace_id, stage_name, status, duration_s FROM stage_record) SELECT stage_name, count(*) AS n, count_if(status = 'done') AS n_done, count_if(status = 'failed') AS n_failed, sum(duration_s) AS seconds, max(duration_s) AS longest FROM s GROUP BY stage_name"""
)
def agg_stage_counters(spark, d):
    s = table(spark, d, "stage_record").select("workspace_id", "stage_name", "status", "duration_s").distinct()
    return s.groupBy("stage_name").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "done").alias("n_done"), F.count_if(F.col("status") == "failed").alias("n_failed"), F.sum("duration_s").alias("seconds"), F.max("duration_s").alias("longest"))


@query(
    """WITH l AS (SELECT DISTINCT workspace_id, row_id, avg_logprob, source_text FROM transcript_segment WHERE avg_logprob IS NOT NULL)
    SELECT workspace_id, avg(avg_logprob) AS mean_logprob, count_if(avg_logprob < -0.7) AS n_low, arg_max(row_id, (avg_logprob, -row_id)) AS best_row FROM l GROUP BY workspace_id"""
)
def top_best_decode(spark, d):
    rows = table(spark, d, "transcript_segment").where("avg_logprob is not null").select("workspace_id", "row_id", "avg_logprob").distinct()
    return rows.groupBy("workspace_id").agg(
        F.avg("avg_logprob").alias("mean_logprob"), F.count_if(F.col("avg_logprob") < -0.7).alias("n_low"), F.max_by("row_id", F.struct("avg_logprob", -F.col("row_id"))).alias("best_row")
    )


@query("SELECT e AS entity, count(*) AS n FROM (SELECT DISTINCT seg_uid, unnest(glossary_hits) AS e FROM timeline_segment) GROUP BY e")
def set_glossary_hits(spark, d):
    rows = table(spark, d, "timeline_segment").select("seg_uid", F.explode("glossary_hits").alias("entity")).distinct()
    return rows.groupBy("entity").agg(F.count(F.lit(1)).alias("n"))


@query(
    """SELECT source, count(*) AS n, sum(octet_length(CAST(encode(coalesce(text, '')) AS BLOB))) AS bytes, min(created_at) AS first_at, max(created_at) AS last_at, count_if(date_diff('day', CAST(created_at AS DATE), DATE '2032-01-01') > 7) AS n_old FROM documents GROUP BY source"""
)
def agg_cache_stats(spark, d):
    docs = table(spark, d, "documents")
    old = F.date_diff(F.lit("2032-01-01").cast("date"), F.to_date("created_at")) > 7
    return docs.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(F.coalesce("text", F.lit("")))).alias("bytes"), F.min("created_at").alias("first_at"), F.max("created_at").alias("last_at"), F.count_if(old).alias("n_old"))
