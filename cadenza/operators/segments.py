"""Cleaning rules shared by operators over segments: speaker labels, usable rows, repeated deliveries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def canonical_speaker(label: Column) -> Column:
    """``speaker_NN`` for labels that differ in case, outer blanks or separator; other labels lower-cased; blank is null."""
    bare = F.regexp_replace(F.lower(label), r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")
    number = F.regexp_extract(bare, r"^speaker[\s\p{Z}_\-]*0*([0-9]+)$", 1)
    return (
        F.when((bare == "") | bare.isNull(), F.lit(None).cast("string"))
        .when(number != "", F.concat(F.lit("speaker_"), F.when(F.length(number) < 2, F.lpad(number, 2, "0")).otherwise(number)))
        .otherwise(F.regexp_replace(bare, r"[\s\p{Z}_\-]+", "_"))
    )


def millis(seconds: Column) -> Column:
    return F.round(seconds * 1000).cast("bigint")


def usable_segments(df: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """Segments with a non-blank speaker, both times and ``end_s > start_s``, each once however often delivered.

    NaN times are unusable. Output: workspace_id, idx, seg_uid, speaker, start_ms, end_ms and ``extra``.
    """
    rows = df.select(
        "workspace_id", "idx", "seg_uid", canonical_speaker(F.col("speaker")).alias("speaker"),
        millis(F.col("start_s")).alias("start_ms"), millis(F.col("end_s")).alias("end_ms"), *(extra or []),
        (~F.isnan("start_s") & ~F.isnan("end_s") & (F.col("end_s") > F.col("start_s"))).alias("_ok"),
    )
    return rows.where("_ok and speaker is not null").drop("_ok").dropDuplicates(["workspace_id", "idx", "seg_uid", "speaker", "start_ms", "end_ms"])
