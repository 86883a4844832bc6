"""Scores and decisions as column expressions. Nulls stay null unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cadenza.functions.text import stripped

# Weights, bands and saturations of the scores.
FIT, RATE, FIDELITY, GLOSSARY = 0.45, 0.20, 0.20, 0.15
BAND = (0.90, 1.15)
RATE_SATURATION = 0.60
FIDELITY_WINDOW, FIDELITY_SATURATION = (0.7, 1.8), 1.2
METRIC_WEIGHTS = {
    "timing_accuracy": 0.15, "slot_fit": 0.10, "speaker_similarity": 0.15, "speaker_consistency": 0.08, "ending_quality": 0.08,
    "continuity": 0.10, "prosodic_similarity": 0.09, "reconstruction_quality": 0.08, "ambience_preservation": 0.09, "reaction_preservation": 0.08,
}


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """``greatest`` and ``least`` skip nulls, so a null has to be kept apart."""
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def decibels(x: Column) -> Column:
    return F.when(x > 1e-9, 20 * F.log10(x)).otherwise(F.lit(-120.0))


def falsy(*values: Column) -> Column:
    """First value that is neither null nor 0, else 0."""
    return F.coalesce(*[F.nullif(v, F.lit(0.0)) for v in values], F.lit(0.0))


def fidelity(source: Column, target: Column) -> Column:
    s, t = F.length(stripped(F.coalesce(source, F.lit("")))), F.length(stripped(F.coalesce(target, F.lit(""))))
    ratio = F.try_divide(t, s)
    low, high = FIDELITY_WINDOW
    off = F.when(ratio < low, low - ratio).otherwise(ratio - high)
    return F.when(s == 0, (t > 0).cast("double")).when(ratio.between(low, high), 1.0).otherwise(clamp(1 - off / FIDELITY_SATURATION))


def rate_penalty(factor: Column) -> Column:
    low, high = BAND
    return F.when(factor.between(low, high), 0.0).otherwise(clamp(F.when(factor < low, low - factor).otherwise(factor - high) / RATE_SATURATION))


def candidate_score(estimated: Column, slot: Column, source: Column, text: Column, compliance: Column) -> Column:
    """Weighted sum of duration fit, natural rate, fidelity and glossary compliance; the slot is 1 ms at least."""
    room = F.greatest(slot, F.lit(1e-3))
    fit = clamp(1 - F.abs(estimated - room) / room)
    return FIT * fit + RATE * (1 - rate_penalty(estimated / room)) + FIDELITY * fidelity(source, text) + GLOSSARY * compliance


def needs_correction(now: Column, target: Column, tol: float = 0.10, least: float = 0.12, under_tol: float = 0.25, under_least: float = 0.35) -> Column:
    """Overruns are corrected at tight limits, underruns only when large; each needs a relative and an absolute excess."""
    off = F.abs(now - target)
    share = off / F.greatest(target, F.lit(0.05))
    return F.when(target <= 0, F.lit(False)).when(now > target, (share > tol) & (off > least)).otherwise((share > under_tol) & (off > under_least))


def next_speed(measured: Column, slot: Column, now: Column, top: float = 1.35, tol: float = 0.10) -> Column:
    """Speed to try next, or null when the speech fits, nothing was measured or the cap is reached."""
    aim = F.least(now * F.try_divide(measured, slot), F.lit(top))
    return F.when((slot > 0) & (measured > slot * (1 + tol)) & (aim > now + 1e-3), aim)


def fit_speed(natural: Column, slot: Column, rounds: int = 2, top: float = 1.35, tol: float = 0.10) -> Column:
    """Speed after at most ``rounds`` fittings when length is inversely proportional to speed."""
    speed: Column = F.lit(1.0)
    for _ in range(rounds):
        speed = F.coalesce(next_speed(natural / speed, slot, speed, top, tol), speed)
    return speed


def relative(value: Column, centre: Column, low: float, high: float) -> Column:
    """Ratio to a centre inside a band; 1 if either is missing or not positive."""
    return F.coalesce(F.when((value > 0) & (centre > 0), clamp(value / centre, low, high)), F.lit(1.0))


def chunk_quality(snr: Column, seconds: Column, rms: Column, voiced: Column) -> Column:
    """Fitness as a voice reference: up to 40 for noise, 30 for length, 10 for level, 20 for continuity, 25 for speech density."""
    length = F.when(seconds < 1, 0.0).when(seconds < 8, seconds / 8 * 30).when(seconds <= 12, 30.0).otherwise(F.greatest(F.lit(0.0), 30 - (seconds - 12) * 2))
    dense = F.when(voiced >= 0.7, 25.0).when(voiced >= 0.4, 25 * (voiced - 0.4) / 0.3).otherwise(-20.0)
    return clamp(snr / 40) * 40 + length + clamp(rms * 10) * 10 + F.when(seconds > 5, 20.0).otherwise(0.0) + dense


def reaction_class(centroid: Column, bandwidth: Column, crossings: Column) -> Column:
    return (
        F.when((centroid > 2500) & (crossings > 0.1), "applause").when((centroid > 2000) & (bandwidth > 2000), "cheers")
        .when((centroid > 300) & (centroid < 2000) & (crossings < 0.15), "laughter").otherwise("reaction")
    )


def memory_tier(free_gb: Column) -> Column:
    return F.when(free_gb >= 3.0, "large").when(free_gb >= 1.5, "medium").otherwise("small")


def coerce_parameter(value: Column, low: float, high: float, whole: bool = False) -> Column:
    inside = clamp(value, low, high)
    return F.round(inside) if whole else inside


def low_confidence(score: Column, limit: float = 0.6) -> Column:
    return F.coalesce(score < limit, F.lit(False))


def duration_ratio(a: Column, b: Column) -> Column:
    """Shorter to longer; null unless both are positive."""
    return F.when((a > 0) & (b > 0), F.least(a, b) / F.greatest(a, b))


def weighted_mean(parts: dict[str, float]) -> Column:
    """Mean of the named columns by weight over those that are not null; null if none is."""
    there = lambda n, x: F.when(F.col(n).isNotNull() & F.lit(parts[n] > 0), x).otherwise(F.lit(0.0))
    top = sum((there(n, F.lit(w) * F.coalesce(F.col(n), F.lit(0.0))) for n, w in parts.items()), F.lit(0.0))
    weight = sum((there(n, F.lit(w)) for n, w in parts.items()), F.lit(0.0))
    return F.when(weight > 0, F.try_divide(top, weight))
