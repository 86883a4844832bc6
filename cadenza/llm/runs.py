"""Repeated consecutive events of a sequence, collapsed into runs (problem 6)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.operators.segments import usable_segments
from cadenza.operators.sequences import chunked_runs


def event_runs(segments: DataFrame, length_tolerance_ms: int = 50, max_pause_ms: int = 250, bucket_ms: int = 900_000) -> DataFrame:
    """One row per run of nearly equal consecutive events of a workspace, single events included.

    Order is by start, then ``idx``. An event continues the run of the one before if the speaker is the same, the lengths
    differ by ``length_tolerance_ms`` at most and it starts ``max_pause_ms`` at most after the other's end. Output:
    workspace_id, first_idx, last_idx, speaker, n, start_ms, end_ms, duration_ms.

    Unusable rows (blank speaker, null or NaN times, no positive length) are left out; repeated deliveries count once;
    ties in start and ``idx`` are broken by seg_uid; extra columns are ignored; an empty table gives an empty result.
    """
    def same(prev, cur):
        apart = F.abs((cur["end_ms"] - cur["start_ms"]) - (prev["end_ms"] - prev["start_ms"]))
        return (cur["speaker"] == prev["speaker"]) & (apart <= length_tolerance_ms) & (cur["start_ms"] - prev["end_ms"] <= max_pause_ms)

    rows = chunked_runs(usable_segments(segments), ["workspace_id"], ["start_ms", "idx", "seg_uid"], ["end_ms", "speaker"], same, bucket_ms)
    order = F.struct("start_ms", "idx", "seg_uid")
    return (
        rows.groupBy("workspace_id", "run")
        .agg(
            F.min_by("idx", order).alias("first_idx"), F.max_by("idx", order).alias("last_idx"), F.min("speaker").alias("speaker"),
            F.count(F.lit(1)).alias("n"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"),
        )
        .withColumn("duration_ms", F.col("end_ms") - F.col("start_ms"))
        .drop("run")
    )


def repeated_runs(segments: DataFrame, **options) -> DataFrame:
    """The runs of two events or more."""
    return event_runs(segments, **options).where("n >= 2")
