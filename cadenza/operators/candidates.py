"""Candidate texts per item: expansion, case-insensitive distinct, scoring, best one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.functions import scores, text


def expand(items: DataFrame, item: str, source: Column, lang: Column, slot: Column) -> DataFrame:
    """The whole text, its first sentence and its first half as candidates, in that order, blank and repeated ones dropped.

    Distinctness is by lower-cased, stripped text; the first stays. It is settled inside the row, without a shuffle.
    """
    option = lambda pos, name, cand: F.struct(F.lit(pos).alias("pos"), F.lit(name).alias("backend"), cand.alias("cand"), F.lower(text.stripped(cand)).alias("key"))
    rows = items.select(item, source.alias("source"), lang.alias("lang"), slot.alias("slot"))
    s = F.col("source")
    half = F.substring(s, F.lit(1), F.floor(F.length(s) / 2).cast("int"))
    rows = rows.withColumn("options", F.array(option(0, "full", s), option(1, "first_sentence", F.regexp_extract(s, r"^[^.?!]*[.?!]?", 0)), option(2, "first_half", half)))
    fresh = F.filter("options", lambda c: (c["key"] != "") & ~F.exists("options", lambda o: (o["pos"] < c["pos"]) & (o["key"] == c["key"])))
    return rows.select(item, "source", "lang", "slot", F.inline(fresh)).drop("key")


def scored(candidates: DataFrame) -> DataFrame:
    rows = candidates.withColumn("syllables", text.syllables(F.col("cand"), F.col("lang")))
    rows = rows.withColumn("seconds", text.duration(F.col("cand"), F.col("lang"), counted=F.col("syllables")))
    return rows.withColumn("score", scores.candidate_score(F.col("seconds"), F.col("slot"), F.col("source"), F.col("cand"), F.lit(1.0)))


def best_candidates(items: DataFrame, item: str, source: Column, lang: Column, slot: Column) -> DataFrame:
    """Best candidate per item by score (six places), the earlier on ties; an aggregate, so no item needs a sort."""
    rows = scored(expand(items, item, source, lang, slot))
    best = F.max_by(F.struct("backend", "cand", "syllables", "seconds", "score"), F.struct(F.round("score", 6), -F.col("pos")))
    return rows.groupBy(item).agg(best.alias("b")).select(item, "b.*")
