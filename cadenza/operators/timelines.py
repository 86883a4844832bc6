"""Continuous periods and gaps of overlapping, nested or gapped intervals per entity (problem 1)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.operators.segments import usable_segments
from cadenza.operators.sequences import continuous_periods


def speaker_periods(segments: DataFrame, bucket_ms: int = 900_000) -> DataFrame:
    """All continuous periods per workspace and speaker: workspace_id, speaker, start, end (ms), n, prev_end.

    Null or NaN times, blank speakers and non-positive lengths are left out; a redelivered segment counts once; ties and
    equal segments under several ids count each; extra columns are ignored; an empty table gives an empty result.
    """
    return continuous_periods(usable_segments(segments), ["workspace_id", "speaker"], "start_ms", "end_ms", bucket_ms)


def periods_and_gaps(segments: DataFrame, bucket_ms: int = 900_000) -> DataFrame:
    """Periods to which two or more segments contribute (``merged``) and the gaps between periods (``gap``)."""
    periods = speaker_periods(segments, bucket_ms)
    row = lambda kind, a, b: F.struct(F.lit(kind).alias("kind"), F.col(a).alias("start_ms"), F.col(b).alias("end_ms"))
    both = F.array_compact(
        F.array(F.when(F.col("n") >= 2, row("merged", "start", "end")), F.when(F.col("prev_end").isNotNull(), row("gap", "prev_end", "start")))
    )
    return periods.select("workspace_id", "speaker", F.inline(both))
