"""Data-quality rules that return issues as rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    severity: str  # error or warning
    path: str
    message: str
    broken: Column


def issues(df: DataFrame, keys: list[str], rules: list[Rule]) -> DataFrame:
    """One row per broken rule: keys, severity, path, message. A rule whose condition is null is not broken."""
    found = [F.when(r.broken, F.struct(F.lit(r.severity).alias("severity"), F.lit(r.path).alias("path"), F.lit(r.message).alias("message"))) for r in rules]
    return df.select(*keys, F.inline(F.array_compact(F.array(*found))))


def missing_keys(payload: Column, required: list[str]) -> Column:
    """Required keys that an object's text lacks (a null value is there); null if it is no object."""
    return F.array_except(F.array(*[F.lit(k) for k in required]), F.json_object_keys(payload))


def key_issues(df: DataFrame, keys: list[str], payload: str, required: list[str]) -> DataFrame:
    """An error per missing key, or one for text that is no object."""
    names = F.json_object_keys(payload)
    row = lambda path, message: F.struct(F.lit("error").alias("severity"), path.alias("path"), message.alias("message"))
    absent = F.transform(missing_keys(F.col(payload), required), lambda k: row(F.concat(F.lit("$."), k), F.concat(F.lit("missing required key "), k)))
    return df.select(*keys, F.inline(F.when(names.isNull(), F.array(row(F.lit("$"), F.lit("expected object")))).otherwise(absent)))


def by_severity(found: DataFrame) -> DataFrame:
    return found.groupBy("severity").agg(F.count(F.lit(1)).alias("n"))


def segment_rules() -> list[Rule]:
    c = F.col
    return [
        Rule("error", "$.start", "start is missing", c("start_s").isNull()),
        Rule("error", "$.end", "end is missing", c("end_s").isNull()),
        Rule("error", "$.end", "end is not after start", c("end_s") <= c("start_s")),
        Rule("error", "$.speaker", "speaker is missing", c("speaker").isNull() | (F.trim("speaker") == "")),
        Rule("warning", "$.source_text", "no source text", c("source_text").isNull()),
        Rule("warning", "$.target_text", "no target text", c("target_text").isNull()),
    ]


def profile_rules() -> list[Rule]:
    c = F.col
    return [
        Rule("error", "$.score", "missing required key score", c("score").isNull()),
        Rule("error", "$.reference_duration_s", "reference is under 3 s", c("reference_duration") < 3.0),
        Rule("warning", "$.reference_duration_s", "reference is over 15 s", c("reference_duration") > 15.0),
    ]


def wave_rules(rate: str = "rate", channels: str = "channels", mono: str = "mono") -> list[Rule]:
    """Rules for speaker samples as ``read_waves`` gives them: readable, 16 kHz, one channel, 3 to 15 seconds."""
    seconds = F.try_divide(F.size(mono), F.col(rate))
    return [
        Rule("error", "$.file", "file can't be read", F.col(rate).isNull()),
        Rule("error", "$.rate", "sample rate is not 16000", F.col(rate) != 16000),
        Rule("error", "$.channels", "more than one channel", F.size(channels) > 1),
        Rule("error", "$.duration", "under 3 s", seconds < 3.0),
        Rule("warning", "$.duration", "over 15 s", seconds > 15.0),
    ]
