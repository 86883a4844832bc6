"""Frame-level aggregates of signals: envelopes, reverberation, delivery, ambience. Frames are rows (key, frame, t, level)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.functions import scores
from cadenza.operators.intervals import frames_outside, nearest_neighbours, overlap_pairs
from cadenza.operators.sequences import exact_quantiles, ordered_rank


def gate_envelope(points: DataFrame, speech: DataFrame, keys: list[str], point_id: str, at: str, fade: int) -> DataFrame:
    """1 away from speech, 0 inside it, a cosine ramp of ``fade`` between; the least where ramps overlap: point_id, gain.

    ``speech`` has r_start and r_end (half-open). Only the nearest bound on either side matters, so no span is looped over.
    """
    turns = speech.select(*keys, "r_start", "r_end", F.lit("s").alias("label"), F.monotonically_increasing_id().alias("turn"))
    left = points.select(*keys, point_id, F.col(at).alias("l_start"), (F.col(at) + 1).alias("l_end"))
    inside = overlap_pairs(left, turns.select(*keys, "r_start", "r_end"), keys).select(point_id).distinct().withColumn("_in", F.lit(True))
    near = nearest_neighbours(points, turns, keys, point_id, at, "label", "turn")
    ramp = lambda d: F.when(d < fade, 0.5 - 0.5 * F.cos(d / fade * math.pi)).otherwise(1.0)
    either = F.least(F.coalesce(ramp(F.col("_at") - F.col("before.t")), F.lit(1.0)), F.coalesce(ramp(F.col("after.t") - F.col("_at")), F.lit(1.0)))
    return near.join(inside, point_id, "left").select(point_id, F.when(F.col("_in"), 0.0).otherwise(either).alias("gain"))


def reverberation(frames: DataFrame, key: str, voiced: float, lag: int = 15) -> DataFrame:
    """Median over ends of voiced stretches of the level ``lag`` frames later to the level at the end, in [0, 1]: key, reverb, n.

    ``frames`` has key, frame (0, 1, ... per key) and level. The later frames come by equi-joins on the frame number.
    """
    rows = frames.select(key, "frame", "level")
    ahead = lambda n, name: rows.select(key, (F.col("frame") - n).alias("frame"), F.col("level").alias(name))
    ends = rows.where(F.col("level") >= voiced).join(ahead(1, "next"), [key, "frame"]).where(F.col("next") < voiced)
    tails = ends.join(ahead(lag, "later"), [key, "frame"]).select(key, scores.clamp(F.try_divide(F.col("later"), F.col("level"))).alias("_x"))
    return exact_quantiles(tails, [key], "_x", {"reverb": 0.5}, 0.01).join(tails.groupBy(key).agg(F.count(F.lit(1)).alias("n")), key)


def delivery(frames: DataFrame, key: str, syllables: str, seconds: str) -> DataFrame:
    """Level, voiced and pause share (frames over a fifth of the peak) and syllables a voiced second per key."""
    peak = frames.groupBy(F.col(key).alias("_k")).agg(F.max("level").alias("_p"))
    rows = frames.join(peak, F.col(key).eqNullSafe(F.col("_k"))).withColumn("_v", (F.col("level") > 0.2 * F.col("_p")).cast("double"))
    d = rows.groupBy(key).agg(F.sqrt(F.avg(F.col("level") * F.col("level"))).alias("rms"), F.avg("_v").alias("voiced_ratio"), F.max(syllables).alias("_s"), F.max(seconds).alias("_d"))
    return d.select(key, "rms", scores.decibels(F.col("rms")).alias("db"), "voiced_ratio", (1 - F.col("voiced_ratio")).alias("pause_ratio"), F.try_divide(F.col("_s"), F.col("voiced_ratio") * F.col("_d")).alias("rate"))


def ambience(original: DataFrame, final: DataFrame, speech: DataFrame, key: str, least: int = 3) -> DataFrame:
    """Correlation of the two levels over frames outside speech, mapped to [0, 1]; null under ``least`` frames or without spread: key, score, n."""
    quiet = frames_outside(original.select(key, "t", F.col("level").alias("a")), speech, [key])
    pairs = quiet.join(final.select(key, "t", F.col("level").alias("b")), [key, "t"])
    spread = F.stddev_pop("a") * F.stddev_pop("b")
    told = pairs.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.try_divide(F.covar_pop("a", "b"), spread).alias("_r"), F.least(F.stddev_pop("a"), F.stddev_pop("b")).alias("_s"))
    return told.select(key, F.when((F.col("n") >= least) & (F.col("_s") >= 1e-9), (F.col("_r") + 1) / 2).alias("score"), "n")


def windows_over(frames: DataFrame, key: str, at: str, width: int, hop: int) -> DataFrame:
    """Rows listed under every sliding window [k * hop, k * hop + width) that holds them: key, window, row columns."""
    last = F.floor(F.col(at) / hop)
    first = F.greatest(F.lit(0), F.ceil((F.col(at) - width + 1) / hop))
    return frames.where(first <= last).select("*", F.explode(F.sequence(first.cast("bigint"), last.cast("bigint"))).alias("window"))


def numbered(df: DataFrame, key: str, order: list[str], width: int) -> DataFrame:
    return ordered_rank(df, [key], order, width, "frame")
